"""Containment and packing of sections against the plain rules, and the rules on inputs that earlier forms got wrong."""

import math
import random
import time

from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import assembly as am
from ledgerloom.operators import chunks as ch
from ledgerloom.operators import corpus as cp
from ledgerloom.operators import feed as fd

SECTION = "doc string, n int, level int, line_start long, line_end long"


def random_sections(seed, n=300):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = rng.randint(-3, 90)
        out.append((rng.choice("abc"), k, rng.choice([-2, 0, 1, 2, 3, 3, 9]), a, a + rng.randint(0, 40)))
    return [*out, ("n", 900, None, 1, 5), ("n", 901, 2, None, 5), ("n", 902, 1, 1, 9), (None, 903, 1, 1, 9), (None, 904, 2, 1, 9), ("r", 905, 1, 1, 9), ("r", 906, 2, 2, 3), ("r", 905, 1, 1, 9)]


def holds(a, b):
    return None not in (a[0], b[0], a[2], b[2], a[3], b[3]) and a[0] == b[0] and b[2] > a[2] and b[3] >= a[3] and b[4] <= a[4]


def test_containment_equals_the_pair_form(spark):
    for seed, strip in ((1, 4096), (2, 7)):
        rows = random_sections(seed)
        df = spark.createDataFrame(rows, SECTION)
        want = sorted(a[1] for a in rows if any(holds(a, b) for b in rows))
        inner = {(r.doc, r.level, r.line_start): r.least_end for r in ch.least_inner_end(df, "doc", strip=strip).collect()}
        for a in rows:
            ends = [b[4] for b in rows if None not in (a[0], a[2], a[3], b[2], b[3]) and a[0] == b[0] and b[2] > a[2] and b[3] >= a[3]]
            assert inner.get((a[0], a[2], a[3])) == min(ends, default=None)
        assert sorted(r.n for r in cp.range_contains(df, "doc").collect()) == want
        large = lambda a: a[2] is not None and a[2] <= 1 or a[3] is not None and a[4] - a[3] + 1 > 250
        kept = [a for a in rows if not (large(a) and any(holds(a, b) for b in rows))]
        best = {}
        for a in kept:
            rank = (-(a[2] if a[2] is not None else -99), a[1])
            best[a[0], a[3], a[4]] = min(best.get((a[0], a[3], a[4]), (rank, a[1])), (rank, a[1]))
        assert sorted(r.n for r in am.leaf_sections(df, "doc", "n").collect()) == sorted(n for _, n in best.values())
    assert cp.range_contains(spark.createDataFrame([], SECTION), "doc").count() == 0


def test_one_document_of_200_000_sections(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").cast("int").alias("n"), (F.col("id") % 3 + 1).cast("int").alias("level"), (F.col("id") + 1).alias("line_start"), (F.col("id") + 3).alias("line_end"))
    began = time.time()
    # n holds n + 1 or n + 2 only if they end with it: none does, but the last level-1 rows' ends are their own
    assert cp.range_contains(df, "doc").count() == 0
    wide = df.withColumn("line_end", F.when(F.col("level") == 1, F.col("line_end") + 10).otherwise(F.col("line_end")))
    assert cp.range_contains(wide, "doc").filter("level = 1").count() == len(range(0, n - 1, 3))
    assert time.time() - began < 600


def sequential(ranges, target, hard, overlap):
    """The rule, one section after the other."""
    out, held = [], []

    def flush():
        if held:
            out.append((held[0][0], max(b for _, b in held), False))
            held.clear()

    for a, b in sorted(ranges):
        if b - a + 1 > hard:
            flush()
            while True:
                end = min(b, a + target - 1)
                out.append((a, end, True))
                if end == b:
                    break
                a = max(end - overlap + 1, a + 1)
            continue
        if held:
            proposed, current = max(held[-1][1], b) - held[0][0] + 1, held[-1][1] - held[0][0] + 1
            if current >= int(0.75 * target) and proposed > target or proposed > hard:
                flush()
        held.append((a, b))
    flush()
    return out


def test_packing_is_the_sequential_rule(spark):
    rng = random.Random(7)
    docs = {}
    for d in range(40):
        at, own = 1, []
        for _ in range(rng.randint(1, 25)):
            size = rng.choice([1, 5, 20, 60, 99, 140, 151, 400])
            own.append((at, at + size - 1))
            at += rng.choice([size, size, size + 3, size // 2, 0])
        docs[d] = own
    df = spark.createDataFrame([(d, a, b) for d, own in docs.items() for a, b in own], "doc int, line_start long, line_end long")
    got = {}
    for r in ch.pack_chunks(df, "doc", 100, 150, 10).orderBy("doc", "chunk").collect():
        got.setdefault(r.doc, []).append((r.line_start, r.line_end, r.split))
    assert got == {d: sequential(own, 100, 150, 10) for d, own in docs.items()}


def test_forced_cuts_overlap_and_bare_documents_get_windows(spark):
    s = spark.createDataFrame([("d", 1, 1, 1, 1200), ("x", 1, 1, 5, 2), ("g", 1, 1, 11, 20)], SECTION)
    totals = spark.createDataFrame([("d", 1200), ("x", 1001), ("y", 3), ("z", 0), ("g", 30)], "doc string, total long")
    got = {}
    for r in am.chunk_documents(s, "doc", "n", totals=totals).orderBy("doc", "chunk").collect():
        got.setdefault(r.doc, []).append((r.line_start, r.line_end, r.split, r.covered))
    assert got["d"] == [(1, 500, True, 1200), (451, 950, True, 1200), (901, 1200, True, 1200)]
    assert got["x"] == [(1, 500, False, 1001), (501, 1000, False, 1001), (1001, 1001, False, 1001)]
    assert got["y"] == [(1, 3, False, 3)] and got["g"] == [(1, 30, False, 30)] and "z" not in got
    assert [(r.line_start, r.line_end) for r in am.chunk_documents(s, "doc", "n").filter("doc = 'd'").orderBy("chunk").collect()] == [(1, 500), (451, 950), (901, 1200)]


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]


def test_numbers_marks_and_lists(spark):
    assert one(spark, tx.int_or_zero, "1,234", "12 a", "a", "", None, "  7", "9" * 30) == [1234, 12, 0, 0, 0, 7, 0]
    got = one(spark, tx.float_or_zero, "12d", "3f", " 1,234.50 ", "1e3", ".5", "5.", "1_0", "-inf", "x", None, "nan", "1 2")
    assert got[:10] == [0.0, 0.0, 1234.5, 1000.0, 0.5, 5.0, 10.0, -math.inf, 0.0, 0.0] and math.isnan(got[10]) and got[11] == 0.0
    marks = ["Hoja 3 de 9", "Sheet 2 of 9", "- Página 3 -", "PÁG.3", "page 7", "folio 3", "3", "page 3 de 9", "Página", None, "see page 3"]
    assert one(spark, tx.is_page_number, *marks) == [True] * 5 + [False] * 6
    fields = {"uuid": "", "kind": "3"}
    column = lambda c: F.to_json(tx.parse_json_list(c, fields))
    texts = ['[{"uuid": " a ", "kind": 5}, "{x", {"other": 1}, 3, null, [1], {"uuid": null}]', '{"uuid": "a"}', "[", None, "[]", '["{\\"uuid\\": 1}"]']
    assert one(spark, column, *texts) == ['[{"uuid":"a","kind":"5"},{"uuid":"","kind":"3"},{"uuid":"","kind":"3"}]', "[]", "[]", "[]", "[]", "[]"]


def test_repeated_keys_count_once(spark):
    old = spark.createDataFrame([("t", 1, "exempt"), ("t", 2, "pending"), ("t", 3, "exempt")], "tenant_id string, feed_item_id long, decision string")
    new = spark.createDataFrame(
        [("t", 1, "autorejected", 1), ("t", 1, "autorejected", 2), ("t", 2, "exempt", 1), ("t", 2, "autorejected", 2), ("t", 3, "pending", 1), ("t", 3, "autorejected", 2), ("t", 4, "autorejected", 2), ("t", 4, "exempt", 1), ("t", 5, "exempt", 1), ("t", 5, "pending", 2)],
        "tenant_id string, feed_item_id long, decision string, n int",
    )
    assert {r.feed_item_id: r.decision for r in fd.upsert_decisions(old, new, "n").collect()} == {1: "exempt", 2: "exempt", 3: "autorejected", 4: "exempt", 5: "pending"}
    assert fd.upsert_decisions(old, new, "n").count() == 5
    known = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    rows = spark.createDataFrame([(1, "x", True, 1), (1, "y", True, 2), (3, "z", True, 1), (3, "w", False, 2), (4, "u", False, 1), (4, "v", True, 2), (2, "", True, 1)], "id long, name string, active boolean, n int")
    got = sorted((r.id, r.name, r.action) for r in fd.sync_catalog(known, rows, "id", ["name"], "active", "n").collect())
    assert got == [(1, "y", "updated"), (2, "b", "updated"), (4, "v", "added")]


def test_any_of_several_deadlines_is_urgent(spark):
    rows = [(1, 60, None, 0), (2, 60, 0, None), (3, 60, None, None), (4, 60, 10**6, None), (5, 200, None, None)]
    df = spark.createDataFrame(rows, "id long, ago int, a int, b int")
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) - F.col(c) * 60)
    df = df.select("id", at("ago").alias("checked"), at("a").alias("a"), at("b").alias("b"))
    now = F.timestamp_seconds(F.lit(1_700_000_000))
    assert sorted(r.id for r in fd.due_for_refresh(df, now, "checked", ["a", "b"]).collect()) == [1, 2, 5]
    assert sorted(r.id for r in fd.due_for_refresh(df, now, "checked", "a").collect()) == [2, 5]


def test_entries_against_their_plan(spark):
    e = spark.createDataFrame([(1, "e", 1, 5, "x")], "doc int, entry string, line_start int, line_end int, evidence string")
    t = spark.createDataFrame([(1, 20), (2, 10), (3, 5)], "doc int, total int")
    plan = spark.createDataFrame([(1, 1, 10), (1, 11, 25), (2, 1, 4), (2, 1, 4), (2, 6, 10)], "doc int, line_start int, line_end int")
    read = spark.createDataFrame([(1, 1, 10), (2, 1, 4), (2, 6, 10)], "doc int, line_start int, line_end int")
    got = sorted(tuple(r) for r in am.validate_entries(e, t, "doc", "entry", plan=plan, read=read).collect())
    assert got == [(1, None, "not read: 11-25"), (2, None, "plan leaves lines out"), (3, None, "plan leaves lines out")]


def test_markdown_is_rewritten(spark):
    df = spark.createDataFrame([("d", "1", 1, "text", " oﬃce x## y"), ("d", "1", 2, "text", " oﬃce x## y"), ("d", "2", 3, "header", "h"), ("d", "3", 4, None, "b")], "doc string, id string, pos int, kind string, text string")
    assert am.assemble_markdown(df, "doc", ["id", "text"], "pos", "kind", "text", ["header"]).first().body == "office x\n\n## y\n\n---\n\nb"


def test_inheritance_over_64_levels_with_every_row_twice(spark):
    chain = [(i, i - 1 if i > 1 else None) for i in range(1, 65)] * 2
    bom = spark.createDataFrame(chain, "item_id long, parent_id long")
    began = time.time()
    got = cp.ancestors(bom)
    assert got.count() == 64 * 65 // 2 and got.filter("item_id = 64 AND source = 1").first().distance == 63
    reqs = spark.createDataFrame([(1, "a"), (1, "a")], "item_id long, text string")
    assert cp.inherit_requirements(bom, reqs).count() == 64
    assert time.time() - began < 600


def test_changed_regions_deal_lines_by_page_once(spark):
    from ledgerloom.operators import assembly as am

    a = [("p", 1, "x"), ("p", 2, "x"), ("p", 3, None), ("p", 4, "y"), ("q", 1, "z"), (None, 1, "x")]
    b = [("p", 1, "x"), ("p", 2, "w"), ("p", 3, None), ("p", 4, "y"), ("r", 1, "z"), (None, 1, "x")]
    got = am.changed_regions(*(spark.createDataFrame(rows, "page string, pos int, line string") for rows in (a, b)), "page", "pos", "line")
    assert [(r.page, r.changed_share, r.regions, r.largest_share, r.risk) for r in got.collect()] == [("p", 0.5, 2, 0.25, "high")]
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
