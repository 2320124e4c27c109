"""Groups that a third of all rows fall into: drawings of one size, hashes that share a band."""

import random
import time

from pyspark.sql import functions as F

from ledgerloom.operators import assembly as am
from ledgerloom.operators import corpus as cp


def test_drawings_of_one_size(spark):
    """200,000 rectangles of one size and style, all at different places: one drawing by their size."""
    n = 200_000
    at = F.col("id")
    d = spark.range(n).select(F.lit("d").alias("doc"), (at % 50).alias("page"), (at * 5).alias("x0"), F.lit(0).alias("y0"), (at * 5 + 3).alias("x1"), F.lit(2).alias("y1"), F.lit("s").alias("style"))
    totals = spark.createDataFrame([("d", 50)], "doc string, total int")
    began = time.time()
    got = am.repeated_drawings(d, "doc", totals, most=n).collect()
    assert [(r.x0, r.x1, r.pages) for r in got] == [(0, 3, 50)]
    assert time.time() - began < 900


def test_near_rectangles_equal_brute_force(spark):
    rng = random.Random(9)
    boxes = [(rng.randint(0, 14), rng.randint(0, 3), rng.randint(20, 34), rng.randint(5, 8), rng.choice(["s", None])) for _ in range(60)]
    rows = [("d", p, *box) for box in boxes for p in rng.sample(range(30), rng.randint(3, 12))]
    d = spark.createDataFrame(rows, "doc string, page int, x0 int, y0 int, x1 int, y1 int, style string")

    def fuse(nodes, close):
        label = {n: n for n in nodes}
        order = lambda n: (*n[:4], n[4] is not None, n[4] or "")
        changed = True
        while changed:
            changed = False
            for a in nodes:
                for b in nodes:
                    if a[4] == b[4] and close(a, b) and order(label[b]) < order(label[a]):
                        label[a], changed = label[b], True
        return label

    pages = {}
    for _, p, *box in rows:
        pages.setdefault(tuple(box), set()).add(p)
    near = fuse(list(pages), lambda a, b: all(abs(x - y) <= 2 for x, y in zip(a[:4], b[:4], strict=True)))
    first = {}
    for n, own in pages.items():
        first.setdefault(near[n], set()).update(own)
    size = lambda n: (n[2] - n[0], n[3] - n[1])
    alike = fuse(list(first), lambda a, b: all(abs(x - y) <= 2 for x, y in zip(size(a), size(b), strict=True)))
    want = {}
    for n, own in first.items():
        want.setdefault(alike[n], set()).update(own)
    got = am.repeated_drawings(d, "doc", spark.createDataFrame([("d", 30)], "doc string, total int"), min_pages=3, threshold=0.1)
    assert sorted(((r.x0, r.y0, r.x1, r.y1, r.style, r.pages) for r in got.collect()), key=str) == sorted(((*n, len(p)) for n, p in want.items() if len(p) >= 3), key=str)


def test_hot_bands_equal_all_pairs(spark):
    rng = random.Random(3)
    base = rng.getrandbits(128)
    values = [base & ~((1 << 64) - 1) | rng.getrandbits(64) for _ in range(60)]  # many share half of their bits
    values += [v ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)) for v in values[:30]] + [values[0], values[1]]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(k, signed(v >> 64), signed(v & (1 << 64) - 1)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, a long, b long")
    want = {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if 0 < (values[i] ^ values[j]).bit_count() <= 5 and values.index(values[i]) == i and values.index(values[j]) == j}
    want |= {(values.index(v), k, 0) for k, v in enumerate(values) if values.index(v) != k}
    for hot in (2_000, 3):
        assert {tuple(r) for r in cp.hamming_pairs(df, "k", ["a", "b"], 5, hot=hot).collect()} == want


def test_a_band_of_200_000_values(spark):
    n = 200_000
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("a"), F.xxhash64("id").alias("b"), F.xxhash64("id", F.lit(1)).alias("c"), F.xxhash64("id", F.lit(2)).alias("d"))
    pair = spark.range(1).select(F.lit(n).cast("long").alias("k"), F.lit(3).cast("long").alias("a"), F.xxhash64(F.lit(5).cast("long")).alias("b"), F.xxhash64(F.lit(5).cast("long"), F.lit(1)).alias("c"), F.xxhash64(F.lit(5).cast("long"), F.lit(2)).alias("d"))
    began = time.time()
    got = [tuple(r) for r in cp.hamming_pairs(df.unionByName(pair), "k", ["a", "b", "c", "d"], 12).collect()]
    assert got == [(5, n, 2)]
    assert time.time() - began < 1500
