"""Components of near-equal SimHash fingerprints by vantage-point trees.

1. One scan turns each whole text into the 64-bit fingerprint of its word shingles.
   Rows with the same fingerprint are one item from here on (a partial aggregate).
2. A vantage-point tree partitions fingerprints by Hamming distance: a node has a
   vantage point v and a radius r, and what lies within r of v goes to its near
   branch.  The upper tree is fitted in one task on a sample of ``SAMPLE``
   fingerprints at most; its nodes, whose number that bounds, go with the tasks.
   Of the vantage points and radii tried, it takes those that few balls overlap.
3. Two fingerprints that differ in two bits or fewer have a common midpoint, at one
   bit or less from both.  So every fingerprint visits each shard (leaf of the tree)
   that its ball of radius 1 reaches: by the triangle inequality the near branch if
   d(v, x) <= r + 1, the far one if d(v, x) >= r.  Both of a pair then reach the
   shard of their midpoint, and all other branches are pruned.  A ball of radius 2
   around one of them would overlap twice as many boundaries.
4. A shard is a task's group: a tree of the same kind, fitted on the shard itself, is
   descended with the same bounds down to ``SMALL`` fingerprints, which are compared
   exhaustively.  Links are true distances of 2 bits or less, reported as stars.
5. Stars are joined into components of items over all shards.

The sample decides how evenly shards are filled, never what is found.

Defined results: null, empty and blank texts have the fingerprint zero, which is
linked like any other; rows that share an id share a component, which links their
fingerprints; rows with a null id take no part (component_id null); repeated rows are
each reported; very long texts are hashed whole, in stretches of bounded size; further
columns, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, tidy
from .neardup import components, star_edges

WIDTH = 3
SEED = 42
REACH = 2  # bits that linked fingerprints differ in at most
SAMPLE = 65_536
SHARD = 4_096  # fingerprints a shard should hold, before balls overlap
LEAST_SAMPLE = 16  # of the sample in a shard
SMALL = 96
TRIES = 12
STRETCH = 1 << 20

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, width: int = WIDTH, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle of a text, in parts of ``stretch`` bytes of text or so."""
    body = (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    digest, held, any_yet = xxhash.xxh64_intdigest, [], False
    at = 0
    while at < len(body):
        end = min(len(body), at + stretch)
        if end < len(body):  # up to the end of the word that reaches over it
            last = re.compile(rb"[\x20\x09-\x0D]").search(body, end)
            end = last.start() if last else len(body)
        words = held + _WORDS.findall(body, at, end)
        at = end
        if len(words) >= width:
            run = b" ".join(words)
            sizes = np.fromiter(map(len, words), "int64", len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[: len(words) - width + 1].tolist()
            yield np.array([digest(run[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "uint64")
            any_yet, held = True, words[len(words) - width + 1 :] if width > 1 else []
        else:
            held = words
    if not any_yet and held:
        yield np.array([digest(b" ".join(held), SEED)], "uint64")


def fingerprint(text: str | None, width: int = WIDTH, stretch: int = STRETCH) -> int:
    """Bits set in over half of the shingles' hashes, as a signed 64-bit number."""
    ones, n = np.zeros(64, "int64"), 0
    for hashes in shingle_hashes(text, width, stretch):
        for k in range(0, len(hashes), 8192):
            part = hashes[k : k + 8192]
            ones += np.unpackbits(part.astype(">u8").view("uint8").reshape(-1, 8), axis=1).sum(axis=0, dtype="int64")
            n += len(part)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of each row."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            found = [fingerprint(value.as_py(), width) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def distance(point: np.uint64, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ point)


@dataclass
class Tree:
    """Inner nodes: vantage point, radius, and their branches: a node, or, as -1 - k, leaf k."""

    point: np.ndarray
    radius: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def leaves(self, fps: np.ndarray, reach: int = REACH // 2) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, row) of every leaf that the ball of radius ``reach`` around each fingerprint meets."""
        out: list[tuple[int, np.ndarray]] = []
        todo = [(0 if len(self.point) else -1, np.arange(len(fps)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((-1 - node, rows))
                continue
            d = distance(self.point[node], fps[rows]).astype("int64")
            todo.append((int(self.near[node]), rows[d <= self.radius[node] + reach]))
            todo.append((int(self.far[node]), rows[d > self.radius[node] - reach]))
        if not out:
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        return np.concatenate([np.full(len(rows), leaf) for leaf, rows in out]), np.concatenate([rows for _, rows in out])


def vantage(fps: np.ndarray, rng: np.random.Generator, tries: int = TRIES) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that part ``fps`` and whose boundary few balls of radius 1 overlap, for the evenness of the parts; none if all pairs of the parts are hardly fewer than those of the whole."""
    best, chosen = np.inf, None
    for k in rng.choice(len(fps), min(tries, len(fps)), replace=False):
        counts = np.bincount(distance(fps[k], fps), minlength=66) / len(fps)
        inside = np.cumsum(counts)
        with np.errstate(divide="ignore", invalid="ignore"):
            evenness = -(inside * np.log2(inside) + (1 - inside) * np.log2(1 - inside))
            cost = np.log2(1 + counts + np.append(counts[1:], 0)) / evenness
        near, far = np.append(inside[1:], 1), 1 - np.concatenate([[0], inside[:-1]])
        cost[(near**2 + far**2 > 0.8) | np.isnan(cost)] = np.inf  # the parts, with what overlaps, must be less work than the whole
        r = int(np.argmin(cost))
        if cost[r] < best:
            best, chosen = cost[r], (fps[k], r)
    return chosen


def fit(sample: np.ndarray, leaf: int, seed: int = 12) -> Tree:
    """A tree whose leaves hold ``leaf`` of the sample's fingerprints at most, or such as no vantage point parts."""
    rng = np.random.default_rng(seed)
    point, radius, branches, leaves = [], [], [], 0
    todo = [(sample, -1, 0)]  # fingerprints, the node above, which branch
    while todo:
        own, above, side = todo.pop()
        split = vantage(own, rng) if len(own) > leaf else None
        if split is None:
            name, leaves = -1 - leaves, leaves + 1
        else:
            name = len(point)
            point.append(split[0])
            radius.append(split[1])
            branches.append([0, 0])
            d = distance(split[0], own)
            todo += [(own[d <= split[1]], name, 0), (own[d > split[1]], name, 1)]
        if above >= 0:
            branches[above][side] = name
    links = np.array(branches, "int64").reshape(-1, 2)
    return Tree(np.array(point, "uint64"), np.array(radius, "int64"), links[:, 0], links[:, 1])


def shard_links(fps: np.ndarray, small: int = SMALL, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of linked fingerprints that connect what is linked in a shard: a vantage-point tree down to ``small`` ones, or such as stay together."""
    rng = np.random.default_rng(seed)
    todo = [np.arange(len(fps))]
    while todo:
        rows = todo.pop()
        split = vantage(fps[rows], rng, 4) if len(rows) > small else None
        if split is not None:
            d = distance(split[0], fps[rows]).astype("int64")
            todo += [rows[d <= split[1] + REACH // 2], rows[d > split[1] - REACH // 2]]
        else:
            yield from compared(fps, rows)


def compared(fps: np.ndarray, rows: np.ndarray, block: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All links among ``rows``; sorted by the distance to the first, only those whose distances to it differ by ``REACH`` at most are compared."""
    if len(rows) < 2:
        return
    d = distance(fps[rows[0]], fps[rows]).astype("int64")
    order = np.argsort(d, kind="stable")
    rows, d = rows[order], d[order]
    stop = np.searchsorted(d, d + REACH, "right")
    for at in range(0, len(rows), block):
        end = min(len(rows), at + block)
        others = rows[at : stop[end - 1]]
        close = np.bitwise_count(fps[rows[at:end], None] ^ fps[others][None, :]) <= REACH
        a, b = np.nonzero(close)
        later = b > a
        if later.any():
            yield rows[at + a[later]], others[b[later]]


def upper_tree(items: DataFrame, n: int, sample: int = SAMPLE, shard: int = SHARD) -> Tree:
    """The tree over shards, fitted in one task on ``sample`` fingerprints at most; only its nodes come back."""
    leaf = max(LEAST_SAMPLE, int(shard * min(1, sample / max(n, 1))))

    def run(it):
        import pyarrow as pa

        found = [batch.column(0).to_numpy() for batch in it]
        tree = fit(np.concatenate(found).view("uint64") if found else np.zeros(0, "uint64"), leaf)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(len(tree.point)), tree.point.view("int64"), tree.radius, tree.near, tree.far)], names=["node", "point", "radius", "near", "far"])

    drawn = items.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).coalesce(1)
    nodes = drawn.mapInArrow(tidy(run), "node long, point long, radius long, near long, far long").orderBy("node").collect()  # at most sample / LEAST_SAMPLE rows
    column = lambda c, kind="int64": np.array([r[c] for r in nodes], "int64").view(kind)
    return Tree(column("point", "uint64"), column("radius"), column("near"), column("far"))


def links(items: DataFrame, sample: int = SAMPLE, shard: int = SHARD, small: int = SMALL) -> DataFrame:
    """(a, b): stars that connect linked items; ``items``: (fp, item), one row a fingerprint."""
    tree = upper_tree(items, items.count(), sample, shard)

    def visit(it):
        import pyarrow as pa

        for batch in it:
            leaf, row = tree.leaves(batch.column("fp").to_numpy().view("uint64"))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *[batch.column(c).take(pa.array(row)) for c in ("fp", "item")]], names=["shard", "fp", "item"])

    def compare(group):
        import pyarrow as pa

        fps, ids = group.column("fp").to_numpy().view("uint64"), group.column("item").to_numpy()
        a, b, held = [np.zeros(0, "int64")], [np.zeros(0, "int64")], 0
        for x, y in shard_links(fps, small):
            a.append(ids[x])
            b.append(ids[y])
            held += len(x)
            if held > 1_000_000:
                left, right = star_edges(np.concatenate(a), np.concatenate(b))
                a, b, held = [left], [right], 0
        left, right = star_edges(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    visits = items.select("fp", "item").mapInArrow(tidy(visit), "shard long, fp long, item long")
    return visits.groupBy("shard").applyInArrow(compare, "a long, b long")


def hexed(fp: Column | str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text", **sizes: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; ``sizes``: those of ``links``."""
    signed = materialise(fingerprints(docs, width, doc_id, text), "fingerprints")
    alive = signed.filter(F.col("doc_id").isNotNull())
    items = materialise(alive.groupBy("fp").agg(F.min("doc_id").alias("item")), "items")
    # rows that share an id link their fingerprints; the smallest id of a fingerprint may stand for several
    shared = alive.groupBy("doc_id").agg((F.min("fp") < F.max("fp")).alias("_several")).filter("_several").select("doc_id")
    ties = alive.join(shared, "doc_id").select("doc_id", "fp").distinct().join(items, "fp").select(F.least("doc_id", "item").alias("a"), F.greatest("doc_id", "item").alias("b"))
    found = components(links(items, **sizes).unionByName(ties.filter("a <> b")))
    labels = items.join(found, "item", "left").select("fp", F.coalesce("component", "item").alias("_component"))
    out = signed.join(labels, "fp", "left")
    return out.select("doc_id", hexed("fp").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))
