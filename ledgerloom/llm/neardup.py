"""Near-duplicate components by a chosen-path set similarity join.

1. One scan turns each whole text into its set of shingle hashes, a digest of
   that set, ``COORDINATES`` minwise values (kept as one byte each) and the root
   keys of ``TREES`` independent trees: each tree starts with one minwise token.
2. Equal sets are one item from here on (a partial aggregate by digest).
3. A node of a tree holds the items that share its path of tokens.  Nodes of up to
   ``BIG_NODE`` items are branched inside one task: small nodes are compared
   exhaustively, items around a leader are taken out together, and what remains is
   split again by two chosen tokens.  Larger nodes are branched by joins in the
   same way: items like the leader are its cluster, those around it are compared with
   its core in tiles of bounded size (``_bridges``), and what is not core is dealt
   anew.  A node of any size yields the same clusters: items connected by sketch
   similarities that no true link can miss (five standard deviations under the threshold).
4. Clusters that share an item are joined over all trees, so that an item is in one
   cluster.  The full sets of a cluster's items are compared exactly and confirmed
   links reported as stars; clusters of more than ``BIG_CLUSTER`` items or
   ``BIG_SHINGLES`` hashes in all are compared in pairs of blocks.
5. Stars are joined into components of items by alternating large-star and
   small-star steps.  Rows get the component of their item last, by the digest, so
   that exact copies never are edges.

A linked pair (similarity s >= 0.8) stays together in a tree with a probability
of about s * 0.94, so ten trees miss fewer than one link in 10^5 at the
threshold, and fewer above it.

Defined results: null, empty and blank texts have empty sets, are linked with
nothing and are their own component; rows that share a doc_id share a component,
which links their texts; rows with a null doc_id take no part (component_id null,
kept true); repeated rows are each reported; very long texts are used whole, their words a stretch at a time;
further columns, whatever their names, are kept by ``keep_one``; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, tidy

WIDTH = 2
THRESHOLD = 80  # per cent
COORDINATES = 128
TREES = 10
SMALL_NODE = 160
BIG_NODE = 20_000
BIG_CLUSTER = 8_192
BIG_SHINGLES = 2_000_000  # 16 MB of hashes
DEPTH = 8
LINK = 0.62  # sketch similarity that a linked pair reaches
CORE = 0.70  # items this near a leader are taken out
AROUND = CORE + LINK - 1  # whose sketch is LINK-like to one in the core is at least so near the leader: shares of equal bytes obey the triangle inequality
TILE = 8_192  # items of a core, or around it, that one task holds: 1 MB of sketches
WORD_CACHE = 200_000
STRETCH = 1 << 20  # bytes of a text that are words at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_rng = np.random.default_rng(8)
_MUL = (_rng.integers(0, 2**31, COORDINATES, dtype="uint32") << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, COORDINATES, dtype="uint32")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) < 40:
            self[word] = value
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M3
    return x ^ (x >> np.uint64(32))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of a text in order; a long text is cut at white space, so that few words are objects at once."""
    parts, at = [np.zeros(0, "uint64")], 0
    while at < len(data):
        cut = _SPACE.search(data, at + STRETCH)
        to = cut.start() if cut else len(data)
        words = data[at:to].split()  # of bytes: ASCII white space only
        if len(_WORDS) > WORD_CACHE:
            _WORDS.clear()
        parts.append(np.fromiter(map(_WORDS.__getitem__, words), "uint64", len(words)))
        at = to
    return parts[-1] if len(parts) == 2 else np.concatenate(parts)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # of bytes: A-Z only
    if not len(h):
        return np.zeros(0, "uint64")
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, "uint64")
    for k in range(width):
        out = _mix((out ^ h[k : k + n]) * _M1 + _M2)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minwise values of a set and a byte of each."""
    low, high = hashes.astype("uint32"), (hashes >> np.uint64(32)).astype("uint32")
    values = np.full(COORDINATES, 0xFFFFFFFF, "uint32")
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096, None] * _MUL + _ADD
        part ^= part >> np.uint32(15)
        part = (part ^ high[at : at + 4096, None]) * np.uint32(0x85EBCA6B)
        part ^= part >> np.uint32(13)
        np.minimum(values, part.min(axis=0), out=values)
    return values, ((values * np.uint32(0xC2B2AE35)) >> np.uint32(24)).astype("uint8")


def root_keys(values: np.ndarray) -> np.ndarray:
    """Root node of each tree: the tree's number and its first chosen token."""
    trees = np.arange(TREES, dtype="uint64")
    chosen = values[(trees * np.uint64(COORDINATES // TREES)).astype(int)].astype("uint64")
    return _mix((trees << np.uint64(32) | chosen) * _M1 + _M2).astype("int64")


SIGNATURE = "doc_id long, n_shingles long, digest binary, sketch binary, keys array<long>"


def signatures(docs: DataFrame, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(it):
        import pyarrow as pa

        for batch in it:
            n, digests, sketches, keys = [], [], [], []
            for value in batch.column(1):
                found = shingle_set(value.as_py(), width)
                n.append(len(found))
                if len(found):
                    values, bytes_ = sketch(found)
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    sketches.append(bytes_.tobytes())
                    keys.append(root_keys(values))
                else:
                    digests.append(None)
                    sketches.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sketch", "keys"])
        _WORDS.clear()  # the worker goes on to other work

    bounded_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(tidy(run), SIGNATURE)


def _near(sketches: np.ndarray, leader: int, among: np.ndarray) -> np.ndarray:
    return np.count_nonzero(sketches[among] == sketches[leader], axis=1) / COORDINATES


def node_clusters(sketches: np.ndarray, rows: np.ndarray, rng: np.random.Generator, depth: int = 0):
    """Clusters (arrays of rows) of one node, which branches until its parts are small."""
    if len(rows) > SMALL_NODE and depth < DEPTH:
        for _ in range(4):
            if len(rows) <= SMALL_NODE:
                break
            near = _near(sketches, rows[rng.integers(len(rows))], rows)
            if np.count_nonzero(near >= LINK) > 1:
                around = rows[near >= AROUND]
                yield from _connected(sketches, around)
                rows = rows[near < CORE]
        if len(rows) > SMALL_NODE:
            for coordinate in rng.choice(COORDINATES, 2, replace=False):
                token = sketches[rows, coordinate]
                order = np.argsort(token, kind="stable")
                for part in np.split(rows[order], np.flatnonzero(np.diff(token[order])) + 1):
                    if len(part) > 1:
                        yield from node_clusters(sketches, part, rng, depth + 1)
            return
    yield from _connected(sketches, rows)


def _connected(sketches: np.ndarray, rows: np.ndarray):
    """Items of ``rows`` connected by sketch similarities of ``LINK`` or more, as clusters of two or more."""
    left = rows
    while len(left) > 1:
        found, queue, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = _near(sketches, queue.pop(), left)
            hit = left[near >= LINK]
            left = left[near < LINK]
            found.extend(hit)
            queue.extend(hit)
        if len(found) > 1:
            yield np.array(found)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of two or more equal keys."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, "int64")
    sizes = np.diff(edge)
    return [(edge[k], edge[k + 1]) for k in np.flatnonzero(sizes > 1)]


def _whole_groups(it, key: str):
    """Arrow tables that never split a run of equal keys; the input is sorted by key."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []
    for batch in it:
        if not batch.num_rows:
            continue
        piece = pa.Table.from_batches([batch])
        keys = piece.column(key)
        cut = piece.num_rows if not held else 0
        last = keys[-1].as_py()
        same = pc.equal(keys, last).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(same))  # sorted: the last key's rows are at the end
        if held and held[0].column(key)[0].as_py() != keys[0].as_py():
            yield pa.concat_tables(held)
            held = []
        if cut:
            yield pa.concat_tables([*held, piece.slice(0, cut)])
            held = []
        held.append(piece.slice(cut))
    if held:
        yield pa.concat_tables(held)


def _bytes_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "uint8").reshape(-1, COORDINATES)


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One (smallest item, item) edge for every other item of each component of the edges (a, b)."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    other = np.flatnonzero(label != np.arange(len(names)))
    return names[label[other]], names[other]


def tree_clusters(nodes: DataFrame) -> DataFrame:
    """(a, b): stars that connect the clusters of nodes (key, item, sketch) of up to ``BIG_NODE`` items; a task joins what it finds."""

    def run(it):
        import pyarrow as pa

        left, right, held = [], [], 0
        for group in _whole_groups(it, "key"):
            keys, ids = group.column("key").to_numpy(), group.column("item").to_numpy()
            runs = _runs(keys)
            if not runs:
                continue
            take = np.concatenate([np.arange(a, b) for a, b in runs])
            sketches = _bytes_matrix(group.column("sketch").take(take))
            mine, at = ids[take], 0
            for a, b in runs:
                for rows in node_clusters(sketches, np.arange(at, at + b - a), np.random.default_rng(int(keys[a]) & 0xFFFFFFFF)):
                    left.append(np.full(len(rows) - 1, mine[rows[0]]))
                    right.append(mine[rows[1:]])
                    held += len(rows)
                at += b - a
            if held > 1_000_000:
                found = star_edges(np.concatenate(left), np.concatenate(right))
                left, right, held = [found[0]], [found[1]], 0
        if left:
            a, b = star_edges(np.concatenate(left), np.concatenate(right))
            for at in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 50_000]), pa.array(b[at : at + 50_000])], names=["a", "b"])

    return nodes.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long")


def _leaders(nodes: DataFrame, items: DataFrame, level: int) -> DataFrame:
    """(key, _lead_item, _leader) of each node of more than ``BIG_NODE`` items: its leader and the leader's sketch.

    It is written, so that the joins with it are planned by its real size.
    """
    large = nodes.groupBy("key").agg(F.count("*").alias("_n"), F.min_by("item", F.xxhash64("item", F.lit(level))).alias("_lead_item")).filter(F.col("_n") > BIG_NODE)
    sketches = items.select(F.col("item").alias("_lead_item"), F.col("sketch").alias("_leader"))
    return materialise(large.join(sketches, "_lead_item").select("key", "_lead_item", "_leader"), "leaders")


def node_coordinates(level: int) -> tuple[Column, Column]:
    """Two different coordinates of each node (``key``), drawn for every node on its own: trees, and the branches of one, stay independent."""
    first = F.pmod(F.xxhash64("key", F.lit(level), F.lit("first")), F.lit(COORDINATES)).cast("int")
    step = F.pmod(F.xxhash64("key", F.lit(level), F.lit("second")), F.lit(COORDINATES - 1)).cast("int")
    return first, F.pmod(first + 1 + step, F.lit(COORDINATES))


def _branch_big(nodes: DataFrame, leaders: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """One step for nodes too large for a task: (stars, the nodes of the next level).

    Whoever is ``LINK``-like to the leader is in its cluster.  The core leaves the node;
    what links it to others is found by ``_bridges``.  The rest is split by two tokens.
    """

    def same(a, b):
        return F.aggregate(F.sequence(F.lit(1), F.lit(COORDINATES)), F.lit(0), lambda n, i: n + (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))).cast("int")) / COORDINATES

    near = same(F.col("sketch"), F.col("_leader"))
    marked = materialise(nodes.join(leaders, "key").select("key", "item", "sketch", "_lead_item", near.alias("_near")), "branch")
    stars = marked.filter((F.col("_near") >= LINK) & (F.col("item") != F.col("_lead_item"))).select(F.col("_lead_item").alias("a"), F.col("item").alias("b"))
    split = F.array(*[F.xxhash64("key", c, F.substring(F.col("sketch"), c + 1, F.lit(1))) for c in node_coordinates(level)])
    after = marked.filter(F.col("_near") < CORE).select("item", "sketch", F.explode(split).alias("key"))
    return stars.unionByName(_bridges(marked)), after


def _bridges(marked: DataFrame) -> DataFrame:
    """(a, b): a node's leader and each item around it whose sketch is ``LINK``-like to an item of the leader's core, but not to the leader.

    ``marked``: (key, item, sketch, _lead_item, _near).  A node's core and what is around
    it are dealt into tiles of about ``TILE`` items; each pair of tiles is a group of its
    own.  A node whose core is the leader alone has none.
    """
    core = marked.filter((F.col("_near") >= CORE) & (F.col("item") != F.col("_lead_item")))
    around = marked.filter((F.col("_near") >= AROUND) & (F.col("_near") < LINK))
    tiles = lambda df, name: df.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias(name))
    sizes = materialise(tiles(core, "_cores").join(tiles(around, "_arounds"), "key"), "bridge-tiles")
    tile = lambda n: F.pmod(F.xxhash64("item", F.lit("tile")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cores = core.join(sizes, "key").select("key", tile("_cores").alias("_c"), every("_arounds").alias("_a"), F.lit(True).alias("core"), "_lead_item", "item", "sketch")
    arounds = around.join(sizes, "key").select("key", every("_cores").alias("_c"), tile("_arounds").alias("_a"), F.lit(False).alias("core"), "_lead_item", "item", "sketch")
    met = cores.unionByName(arounds).select(F.xxhash64("key", "_c", "_a").alias("key"), "core", F.col("_lead_item").alias("lead"), "item", "sketch")

    def run(it):
        import pyarrow as pa

        for group in _whole_groups(it, "key"):
            keys, ids = group.column("key").to_numpy(), group.column("item").to_numpy()
            leads, is_core = group.column("lead").to_numpy(), group.column("core").to_numpy(zero_copy_only=False)
            for a, b in _runs(keys):
                inside = is_core[a:b]
                sketches = _bytes_matrix(group.column("sketch").slice(a, b - a))
                hit = bridged(sketches[inside], sketches[~inside])
                found = ids[a:b][~inside][hit]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), leads[a])), pa.array(found)], names=["a", "b"])

    return met.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), "a long, b long").distinct()


def bridged(core: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Rows of ``around`` whose sketch is ``LINK``-like to one of ``core``; whichever is the smaller is gone through one by one."""
    least = int(np.ceil(LINK * COORDINATES))
    if len(around) <= len(core):
        return np.array([k for k, one in enumerate(around) if (np.count_nonzero(core == one, axis=1) >= least).any()], "int64")
    left = np.arange(len(around))
    hit = [np.zeros(0, "int64")]
    for one in core:
        like = np.count_nonzero(around[left] == one, axis=1) >= least
        hit.append(left[like])
        left = left[~like]
        if not len(left):
            break
    return np.concatenate(hit)


def candidate_clusters(items: DataFrame) -> DataFrame:
    """(cluster, item): each item that is like another by sketch, in the one cluster that all trees connect; ``items``: (item, sketch, keys)."""
    nodes = items.select("item", "sketch", F.explode("keys").alias("key"))
    out, level = None, 0
    while True:  # every step takes out the cores of each large node and splits the rest, down to small nodes
        leaders = _leaders(nodes, items, level)
        large = leaders.count()
        found = tree_clusters((nodes.join(leaders, "key", "left_anti") if large else nodes).select("key", "item", "sketch"))
        out = found if out is None else out.unionByName(found)
        if not large:
            break
        stars, nodes = _branch_big(nodes, leaders, level)
        out = out.unionByName(stars)
        level += 1
    found = components(out)
    return found.select(F.col("component").alias("cluster"), "item").unionByName(found.select(F.col("component").alias("cluster"), F.col("component").alias("item"))).distinct()


def confirmed_stars(sets: list[np.ndarray], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """(root, row) links that connect the components of exact links among ``sets``."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    vocabulary, flat = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(len(vocabulary), bool)
    left, out = np.arange(len(sets)), []
    rows = np.repeat(np.arange(len(sets)), sizes)
    while len(left) > 1:
        root, left = left[0], left[1:]
        queue = [root]
        keep = np.zeros(len(sets), bool)
        keep[left] = True
        while queue and len(left):
            at = queue.pop()
            own = flat[starts[at] : starts[at + 1]]
            mark[own] = True
            if keep[rows].mean() < 0.5:  # forget the sets already placed
                flat_left, rows_left = flat[keep[rows]], rows[keep[rows]]
            else:
                flat_left, rows_left = flat, rows
            shared = np.bincount(rows_left[mark[flat_left]], minlength=len(sets))[left]
            mark[own] = False
            linked = 100 * shared >= threshold * (sizes[left] + sizes[at] - shared)
            hit = left[linked]
            left = left[~linked]
            keep[hit] = False
            queue.extend(hit.tolist())
            out += [(int(root), int(h)) for h in hit]
    return out


def confirm(docs: DataFrame, clusters: DataFrame, width: int, threshold: int, doc_id: str, text: str) -> DataFrame:
    """(a, b): confirmed links that connect what is linked inside each cluster."""
    items = clusters.select("item").distinct()
    slim = docs.select(docs[doc_id].cast("long").alias("item"), docs[text].cast("string").alias("text"))

    def to_sets(it):
        import pyarrow as pa

        for batch in it:
            sets = [shingle_set(t.as_py(), width).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["item", "hashes"])
        _WORDS.clear()

    sets = slim.join(items, "item", "left_semi").mapInArrow(tidy(to_sets), "item long, hashes binary").filter(F.length("hashes") > 0)
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("_n"), F.sum("n_shingles").alias("_m"))
    blocks = F.greatest(F.ceil(F.col("_n") / BIG_CLUSTER), F.ceil(F.col("_m") / BIG_SHINGLES))
    placed = clusters.join(sizes, "cluster").withColumn("_blocks", blocks.cast("int"))
    block = F.pmod(F.xxhash64("item", F.lit("block")), F.col("_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("_blocks") - 1)
    placed = placed.withColumn("_own", block).select("cluster", "item", "_own", F.explode(others).alias("_other"))
    placed = placed.select(F.xxhash64("cluster", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "item")

    def run(it):
        import pyarrow as pa

        for group in _whole_groups(it, "key"):
            keys, ids = group.column("key").to_numpy(), group.column("item").to_numpy()
            hashes = group.column("hashes")
            pairs = []
            for a, b in _runs(keys):
                own = [np.frombuffer(x, "uint64") for x in hashes.slice(a, b - a).to_pylist()]
                pairs += [(ids[a + i], ids[a + j]) for i, j in confirmed_stars(own, threshold)]
            left, right = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    joined = sets.join(placed, "item").select("key", "item", "hashes")
    return joined.repartition("key").sortWithinPartitions("key", "item").mapInArrow(tidy(run), "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(item, component): the smallest item reachable, for every item with an edge (a, b)."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = materialise(small.filter("u <> v").distinct(), "edges")
        same = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        if after.agg(F.count("*"), same).first() == edges.agg(F.count("*"), same).first():
            break
        edges = after
    return after.groupBy(F.col("u").alias("item")).agg(F.min("v").alias("component"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    signed = materialise(signatures(docs, width, doc_id, text), "signatures")
    alive = signed.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    items = materialise(alive.groupBy("digest", "n_shingles", "sketch", "keys").agg(F.min("doc_id").alias("item")), "items")
    clusters = candidate_clusters(items.select("item", "sketch", "keys")).join(items.groupBy("item").agg(F.sum("n_shingles").alias("n_shingles")), "item")
    links = confirm(docs, materialise(clusters, "clusters"), width, threshold, doc_id, text)
    # ids of rows with different texts link the items of these texts
    shared = alive.groupBy("doc_id").agg((F.min("digest") < F.max("digest")).alias("_several")).filter("_several").select("doc_id")
    of_shared = alive.join(shared, "doc_id").select("doc_id", "digest").distinct().join(items.select("digest", "item"), "digest").select("doc_id", "item")
    ties = of_shared.join(of_shared.groupBy("doc_id").agg(F.min("item").alias("a")), "doc_id").select("a", F.col("item").alias("b")).filter("a <> b")
    found = components(links.unionByName(ties))
    labels = items.select("digest", "item").join(found, "item", "left").select("digest", F.coalesce("component", "item").alias("_component"))
    out = signed.join(labels, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """Rows of ``docs`` without those that are near copies of a document with a smaller id; of rows that repeat an id all stay or go.

    Columns stay as they are, whatever their names.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    doc_id, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    gone = near_duplicates(plain, width, doc_id=doc_id, text=text).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return plain.join(gone, F.col(doc_id).cast("long") == F.col("_gone"), "left_anti").toDF(*docs.columns)
