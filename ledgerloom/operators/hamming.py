"""Bit hashes near each other: bands where they part the values, tiles of bounded size where they do not."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import materialise

HOT_BAND = 2_000
TILE = 16_384  # values on a side of a tile
ROWS, COLUMNS = 32, 4_096  # of a tile that are compared at once
HELD = 100_000  # pairs before they go on
BANDED_COST = 4  # a pair of a band's join against one of a tile


def _varying(values: DataFrame, words: Sequence[str]) -> list[int]:
    """Places of the bits, from the first word's highest, in which the values differ."""
    row = values.agg(*[f(w).alias(f"{n}{k}") for k, w in enumerate(words) for n, f in (("a", F.bit_and), ("o", F.bit_or))]).first()
    return [64 * k + 63 - b for k in range(len(words)) for b in range(63, -1, -1) if row[f"o{k}"] is not None and (row[f"a{k}"] ^ row[f"o{k}"]) >> b & 1]


def _bands(words: Sequence[str], places: Sequence[int], bands: int) -> list[Column]:
    """The bits at the given places, as texts of nearly equal length."""
    whole = F.concat(*[F.lpad(F.bin(w), 64, "0") for w in words])
    cut = [len(places) * k // bands for k in range(bands + 1)]
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        runs: list[list[int]] = []
        for p in places[a:b]:
            if runs and runs[-1][0] + runs[-1][1] == p:
                runs[-1][1] += 1
            else:
                runs.append([p, 1])
        out.append(F.concat(*[F.substring(whole, p + 1, n) for p, n in runs]))
    return out


class _Tile:
    """What one tile's values say of each other; ``forest``: only links that connect what its pairs connect."""

    def __init__(self, most: int, places: Sequence[int], forest: bool):
        self.most, self.places, self.forest = most, np.array(places, int), forest

    def packed(self, words: np.ndarray) -> np.ndarray:
        """The bits that vary, in as few words as they fill: (words, values)."""
        bits = np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8), axis=1)[:, self.places]
        room = np.zeros((len(bits), -(-max(1, bits.shape[1]) // 64) * 64), np.uint8)
        room[:, : bits.shape[1]] = bits
        return np.ascontiguousarray(np.packbits(room, axis=1).view(np.uint64).T)

    def met(self, a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in a, place in b, distance) of near pairs, a block of them at a time."""
        for s in range(0, a.shape[1], ROWS):
            for t in range(s // COLUMNS * COLUMNS if same else 0, b.shape[1], COLUMNS):
                far = np.bitwise_count(a[0, s : s + ROWS, None] ^ b[0, t : t + COLUMNS]).astype(np.uint16 if len(a) > 3 else np.uint8, copy=False)
                for k in range(1, len(a)):
                    far += np.bitwise_count(a[k, s : s + ROWS, None] ^ b[k, t : t + COLUMNS])
                p, q = np.nonzero(far <= self.most)
                d = far[p, q]
                p, q = p + s, q + t
                if same:
                    after = q > p
                    p, q, d = p[after], q[after], d[after]
                if len(p):
                    yield p, q, d

    def pairs(self, rows) -> Iterator:
        """Batches of (left, right, distance) of one tile's rows."""
        import pyarrow as pa

        own, i, j = (rows.column(c).to_numpy() for c in ("_b", "_i", "_j"))
        keys, same = rows.column("_first").combine_chunks(), i[0] == j[0]
        words = np.stack([rows.column(c).to_numpy() for c in rows.column_names if c.startswith("_w")], 1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = self.packed(words[left]), self.packed(words[right])

        def batch(p, q, d) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys.take(pa.array(p)), keys.take(pa.array(q)), pa.array(d, pa.int32())], names=["left", "right", "distance"])

        label, held, n = np.arange(len(keys)), [], 0
        for p, q, d in self.met(a, b, same):
            held.append((left[p], right[q], d))
            n += len(p)
            if n >= HELD:
                joined = [np.concatenate(x) for x in zip(*held, strict=True)]
                held, n = [], 0
                if self.forest:
                    label = connected(label, *joined[:2])
                else:
                    yield batch(*joined)
        if held:
            joined = [np.concatenate(x) for x in zip(*held, strict=True)]
            if self.forest:
                label = connected(label, *joined[:2])
            else:
                yield batch(*joined)
        moved = np.flatnonzero(label != np.arange(len(keys)))
        if len(moved):
            yield batch(label[moved], moved, np.zeros(len(moved), np.int32))

    def __call__(self, it: Iterator) -> Iterator:
        """Rows come sorted by tile, so one tile is held at a time."""
        import pyarrow as pa

        held, name = [], None
        for rows in it:
            if not rows.num_rows:
                continue
            # ends of runs of one tile
            tiles = pd.Series(rows.column(rows.schema.get_field_index("_tile")).to_pandas())
            cuts = [0, *np.flatnonzero((tiles != tiles.shift()).to_numpy())[1:], rows.num_rows]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if tiles[x] != name and held:
                    yield from self.pairs(pa.Table.from_batches(held))
                    held = []
                name = tiles[x]
                held.append(rows.slice(x, y - x))
        if held:
            yield from self.pairs(pa.Table.from_batches(held))


def connected(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (smallest place of each component) after more links."""
    while True:
        x, y = label[p], label[q]
        apart = x != y
        if not apart.any():
            return label
        x, y = x[apart], y[apart]
        p, q = p[apart], q[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def tiled(groups: DataFrame, within: Sequence[str], words: Sequence[str], most: int, places: Sequence[int], forest: bool) -> DataFrame:
    """(left, right, distance) of near values of each group; ``groups`` has the columns ``within``, ``_first``, the words and ``_n``, the group's size.

    A group is dealt over blocks of ``TILE`` values or so; every two blocks meet in a tile.
    """
    spark = groups.sparkSession
    blocks = F.ceil(F.col("_n") / TILE).cast("int")
    dealt = groups.select(*within, "_first", *[F.col(w).alias(f"_w{k}") for k, w in enumerate(words)], F.pmod(F.xxhash64("_first"), blocks).cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_o"))
    sides = dealt.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")})
    name = F.concat_ws(",", F.col("_i").cast("string"), F.col("_j").cast("string"), F.to_json(F.struct(*within)) if within else F.lit(""))
    rows = sides.select("_first", *[f"_w{k}" for k in range(len(words))], "_b", "_i", "_j", name.alias("_tile"))
    # few bytes and much work: partitions must not be put together
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    kind = groups.schema["_first"].dataType.simpleString()
    return rows.repartition(parts, "_tile").sortWithinPartitions("_tile").mapInArrow(_Tile(most, places, forest), f"left {kind}, right {kind}, distance int")


def hamming_pairs(hashes: DataFrame, key: str, words: Sequence[str], most: int, small: Column | None = None, hot: int = HOT_BAND, by: Sequence[str] = (), forest: bool = False) -> DataFrame:
    """(left, right, distance): pairs of 64-bit-word hashes within ``most`` bits, of rows that are equal in ``by``.

    Equal hashes are one value with its smallest key, so copies make no pairs
    between themselves but one each with that key (distance 0).  Bits in which no two values differ are left out; the
    others are cut into ``most + 1`` bands, one of which two near values share.  Values of a band that at most ``hot`` of them share are
    joined by it, those of a larger one compared in tiles.  Where the bands part the values so little that this would be more work than all pairs, these
    are compared in tiles: quadratic then, as are the near pairs of such values, but no task holds more than a tile.
    ``small``: which rows take part (images of few pixels).  ``forest``: links that connect what
    the pairs connect are enough; their distances are not to be read.
    """
    rows = hashes.filter(F.coalesce(small, F.lit(False))) if small is not None else hashes
    rows = materialise(rows.select(key, *by, *words).dropna(subset=[*by, *words]), "hashes")
    values = materialise(rows.groupBy(*by, *words).agg(F.min(key).alias("_first")), "values")
    copies = rows.join(values, [*by, *words]).filter(F.col(key) != F.col("_first")).select(F.col("_first").alias("left"), F.col(key).alias("right"), F.lit(0).alias("distance"))
    places, bands = _varying(values, words), most + 1
    pairs_of = F.coalesce(F.sum(F.col("_n") * (F.col("_n") - 1) / 2), F.lit(0.0))
    sizes = values.groupBy(*by).agg(F.count("*").alias("_n"))
    every = sizes.agg(pairs_of).first()[0]
    parted = len(places) >= bands and every > TILE * TILE / 64
    if parted:
        banded = values.select("*", F.posexplode(F.array(*_bands(words, places, bands))).alias("_k", "_band"))
        within = [*by, "_k", "_band"]
        counts = materialise(banded.groupBy(*within).agg(F.count("*").alias("_n")).filter("_n > 1"), "bands")
        cold = F.col("_n") <= hot
        joined, held = (counts.filter(x).agg(pairs_of).first()[0] for x in (cold, ~cold))
        parted = BANDED_COST * joined + held < every
    ordered = lambda df: df.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "distance")
    if not parted:
        whole = values.join(sizes, list(by)) if by else values.crossJoin(F.broadcast(sizes))
        return ordered(tiled(whole, by, words, most, places, forest)).unionByName(copies)
    own = banded.join(counts.filter(cold).drop("_n"), within, "left_semi")
    a, b = own.alias("a"), own.alias("b")
    distance = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words[1:]), F.bit_count(F.col(f"a.{words[0]}").bitwiseXOR(F.col(f"b.{words[0]}"))))
    alike = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in within]
    met = a.join(b, [*alike, F.col("a._first") < F.col("b._first"), distance <= most])
    found = met.select(F.col("a._first").alias("left"), F.col("b._first").alias("right"), distance.alias("distance"))
    if held:
        found = found.unionByName(ordered(tiled(banded.join(counts.filter(~cold), within), within, words, most, places, forest)))
    return found.distinct().unionByName(copies)
