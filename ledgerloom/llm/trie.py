"""Prefix trie of conversations, with subtree figures by the Euler-tour technique.

1. Turns become slim: the SHA-256 of role and text and a count of words; texts are not
   shuffled.  Conversations are rebuilt from the first ``h`` turns of their block's
   first conversation and their own turns after these.
2. Turns get global row numbers in the order of (conversation, turn, digest), so that a
   conversation of any length is spread over tasks.  A prefix is known by two 64-bit
   sums (exclusive or) of hashes of (place, digest); running sums are taken in chunks of
   ``CHUNK`` turns, and the sums of the chunks before complete them.  A prefix's parent
   is the prefix without the last turn's hash, so no row needs its neighbour.
3. A node is an aggregate by prefix.  Nodes whose smallest member is the same
   conversation are a path, so a node's number is the start of its path and its depth.
   Only the tops of paths are joined with their parents.
4. Each node has an enter and an exit arc.  Children are in the order of their smallest
   member, the one that continues its parent's path first.  The successors of all arcs
   form one list, the Euler tour, which ``listrank`` ranks.
5. Prefix sums of leaves and of savings over the arcs' positions: what a node's subtree
   holds is the difference between its exit and its enter.

Defined results: null role or text is empty; turns are ordered by turn (null first), ties
by the digest ``sha256(length of role ':' role text)``; repeated rows are turns of their
own; rows with a null conv_id take no part; remainders take the sign of the id, as in SQL;
an empty table gives an empty result; very long texts are hashed whole; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import listrank
from .common import materialise, tidy
from .scans import prefix_sums

BLOCK = 20
CHUNK = 1 << 16
RUN = 4096  # ids in a piece of a node's list
WORD = r"[^\x20\x09-\x0D]+"


def slim(talks: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, words, tie) of each turn."""
    role, text = (F.coalesce(talks[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    kept = talks.select(
        talks["conv_id"].cast("long").alias("conv_id"), talks["turn"].cast("long").alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("tie"),
    )
    return kept.filter(F.col("conv_id").isNotNull())


def marks(place: Column, digest: Column) -> list[Column]:
    """The two hashes of a turn at a place."""
    return [F.xxhash64(F.lit(k), place, digest) for k in (1, 2)]


def taken(conv_id: Column) -> Column:
    """Turns that a conversation takes from its block's first."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, k1, k2, m1, m2, words) of every prefix of a rebuilt conversation but the empty one, and (conv_id, depth, k1, k2) of every whole one.

    ``k1``, ``k2`` name the prefix, ``m1``, ``m2`` its last turn at its place.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.withColumns({"h": taken(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % BLOCK})
    # the first three turns of the conversations that others begin with; row_number's limit is applied before the shuffle too
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest", "tie")
    begun = turns.filter(F.col("conv_id") % BLOCK == 0).withColumn("depth", F.row_number().over(first)).filter("depth <= 3")
    begun = begun.select(F.col("conv_id").alias("base"), "depth", "words", *[m.alias(f"m{k}") for k, m in enumerate(marks(F.col("depth"), F.col("digest")), 1)])
    upto = Window.partitionBy("base").orderBy("depth")
    begun = materialise(begun.withColumns({f"k{k}": F.bit_xor(f"m{k}").over(upto) for k in (1, 2)}), "begun")
    heads = convs.select("conv_id", "n", "h", "base").join(begun, "base", "left")
    heads = heads.withColumn("used", F.col("depth") <= F.col("h"))
    early = heads.filter("used").select("conv_id", F.col("depth").cast("long").alias("depth"), "k1", "k2", "m1", "m2", "words")
    last = F.max(F.when(F.col("used"), F.struct("depth", "k1", "k2")))
    known = heads.groupBy("conv_id", "n", "h").agg(last.alias("_last"))
    zero = F.lit(0).cast("long")
    known = materialise(
        prefix_sums(
            known.select("conv_id", "n", "h", F.coalesce("_last.depth", zero).alias("p"), F.coalesce("_last.k1", zero).alias("p1"), F.coalesce("_last.k2", zero).alias("p2")),
            ["conv_id"], {"begin": F.col("n")}, "conversations",
        ), "conversations",
    )
    placed = prefix_sums(turns, ["conv_id", F.asc_nulls_first("turn"), "digest", "tie"], {"row": F.lit(1)}, "turns")
    own = placed.join(known, "conv_id").withColumn("at", F.col("row") - F.col("begin") + 1).filter(F.col("at") > F.col("h"))
    own = own.withColumn("depth", F.col("at") - F.col("h") + F.col("p")).select(
        "conv_id", "depth", "words", "p1", "p2", F.expr(f"row div {CHUNK}").alias("chunk"), (F.col("at") == F.col("n")).alias("end"),
        *[m.alias(f"m{k}") for k, m in enumerate(marks(F.col("depth").cast("int"), F.col("digest")), 1)],
    )
    own = materialise(own, "own")
    # sums of a conversation's chunks before; only one that does not end in its chunk has any after
    parts = own.groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"m{k}").alias(f"c{k}") for k in (1, 2)], F.max("end").alias("_ends"), F.min("depth").alias("_low"), F.min("p1").alias("_p1"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"c{k}").over(earlier), zero).alias(f"c{k}") for k in (1, 2)])
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = own.withColumns({f"k{k}": F.bit_xor(f"m{k}").over(inside) for k in (1, 2)}).join(carried, ["conv_id", "chunk"])
    late = run.select("conv_id", "depth", *[F.col(f"k{k}").bitwiseXOR(F.col(f"c{k}")).bitwiseXOR(F.col(f"p{k}")).alias(f"k{k}") for k in (1, 2)], "m1", "m2", "words", "end")
    late = materialise(late, "prefixes")
    ends = known.filter("n <= h").select("conv_id", F.col("p").cast("long").alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    return early.unionByName(late.drop("end")), ends.unionByName(late.filter("end").select("conv_id", "depth", "k1", "k2"))


def id_lists(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes at which conversations end: SHA-256 of their decimal ids, ascending, comma-joined.

    Sorted by range, a node's ids become pieces of ``RUN`` ids, in as many tasks as hold
    them; the pieces of a node then go through one hash, one after the other.
    """
    key = ["depth", "k1", "k2"]
    ranged = ends.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def pieces(it):
        import pyarrow as pa

        for batch in it:
            cols = [batch.column(c).to_numpy() for c in (*key, "conv_id")]
            n = batch.num_rows
            if not n:
                continue
            changed = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])
            starts = [0, *(changed.nonzero()[0] + 1).tolist(), n]
            cuts = [x for a, b in zip(starts, starts[1:], strict=False) for x in range(a, b, RUN)] + [n]
            ids = cols[3].tolist()
            texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
            heads = cuts[:-1]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[heads]) for c in cols], pa.array(texts)], names=[*key, "first", "ids"])

    def digests(it):
        import pyarrow as pa

        now, state = None, None

        def done(rows):
            keys, hashes = zip(*rows, strict=True) if rows else ((), ())
            own = list(zip(*keys, strict=True)) if keys else [[], [], []]
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in own], pa.array(hashes, pa.string())], names=[*key, "ends_sha256"])

        for batch in it:
            rows = []
            for *k, ids in zip(*[batch.column(c).to_pylist() for c in (*key, "ids")], strict=True):
                if k != now:
                    if now is not None:
                        rows.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield done(rows)
        if now is not None:
            yield done([(now, state.hexdigest())])

    schema = "depth long, k1 long, k2 long"
    listed = ranged.mapInArrow(tidy(pieces), f"{schema}, first long, ids string")
    return listed.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(tidy(digests), f"{schema}, ends_sha256 string")


def nodes_of(prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, conv_id, depth, key, parent key, n_convs, words, top, last): the trie's nodes, numbered along their paths.

    ``top`` and ``last`` tell whether a node begins or ends the path of its smallest member.
    """
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("m1"), zero.alias("m2"), zero.alias("words"), "conv_id", "n_convs")
    inner = prefixes.groupBy("depth", "k1", "k2").agg(*[F.min(c).alias(c) for c in ("m1", "m2", "words", "conv_id")], F.count("*").alias("n_convs"))
    nodes = materialise(inner.unionByName(root), "nodes")
    paths = nodes.groupBy("conv_id").agg(F.min("depth").alias("_low"), F.max("depth").alias("_high"))
    paths = materialise(prefix_sums(paths, ["conv_id"], {"_begin": F.col("_high") - F.col("_low") + 1}, "paths"), "paths")
    numbered = nodes.join(paths, "conv_id").withColumns({"id": F.col("_begin") + F.col("depth") - F.col("_low"), "top": F.col("depth") == F.col("_low"), "last": F.col("depth") == F.col("_high")})
    return materialise(numbered.drop("_begin", "_low", "_high"), "numbered")


def tops_of(nodes: DataFrame) -> DataFrame:
    """(id, parent, parent_conv, sibling) of the tops of paths but the root: the node above and the next top below that one."""
    up = nodes.filter("top AND depth > 0").select(
        "id", (F.col("depth") - 1).alias("depth"), F.col("k1").bitwiseXOR(F.col("m1")).alias("k1"), F.col("k2").bitwiseXOR(F.col("m2")).alias("k2"),
    )
    above = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv"), "depth", "k1", "k2")
    placed = materialise(prefix_sums(up.join(above, ["depth", "k1", "k2"]).select("id", "parent", "parent_conv"), ["parent", "id"], {"_at": F.lit(1)}, "tops"), "tops")
    after = placed.select((F.col("_at") - 1).alias("_at"), F.col("parent").alias("_same"), F.col("id").alias("_next"))
    return placed.join(after, "_at", "left").select("id", "parent", "parent_conv", F.when(F.col("_same") == F.col("parent"), F.col("_next")).alias("sibling"))


def tour(nodes: DataFrame, tops: DataFrame, below: DataFrame) -> DataFrame:
    """(arc, next) of the Euler tour: node i enters by arc 2i and leaves by 2i + 1; ``below`` (id, first, n_below): the first of the tops below a node."""
    enter, leave = (lambda c: 2 * c), (lambda c: 2 * c + 1)
    own = F.col("id")
    met = nodes.join(below, "id", "left")
    onward = F.coalesce(enter(F.col("first")), leave(own))  # after the path's own child, or if there is none
    inside = F.array(
        F.struct(enter(own).alias("arc"), F.when(F.col("last"), onward).otherwise(enter(own + 1)).alias("next")),
        F.when(~F.col("last"), F.struct(leave(own + 1).alias("arc"), onward.alias("next"))),
    )
    arcs = met.select(F.explode(F.array_compact(inside)).alias("_arc")).select("_arc.*")
    out = tops.select(leave(F.col("id")).alias("arc"), F.coalesce(enter(F.col("sibling")), leave(F.col("parent"))).alias("next"))
    end = nodes.filter("depth = 0").select(leave(own).alias("arc"), F.lit(None).cast("long").alias("next"))
    return arcs.unionByName(out).unionByName(end)


def trie(talks: DataFrame, block: int | None = None) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes, ends = rebuilt(slim(talks))
    ends = materialise(ends, "ends")
    nodes = nodes_of(prefixes, ends)
    tops = materialise(tops_of(nodes), "siblings")
    below = materialise(tops.groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("first"), F.count("*").alias("n_below")), "below")
    position = listrank.ranks(materialise(tour(nodes, tops, below), "tour"), block)
    node = F.expr("arc div 2").alias("id")
    saved = (F.col("n_convs") - 1) * F.col("words")
    children = F.coalesce("n_below", F.lit(0).cast("long")) + (~F.col("last")).cast("long")
    figures = nodes.join(below, "id", "left").select("id", (children == 0).cast("long").alias("_leaf"), saved.alias("_saved"), children.alias("n_children"))
    weighed = position.select(node, "arc", "position").join(figures.drop("n_children"), "id")
    entered = F.col("arc") % 2 == 0
    sums = prefix_sums(weighed, ["position"], {"leaves": F.when(entered, F.col("_leaf")).otherwise(0), "savings": F.when(entered, F.col("_saved")).otherwise(0)}, "sums")
    subtree = sums.groupBy("id").agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("leaves", "savings")])  # sums at exit less those at enter; both only grow along the tour
    out = (
        nodes.join(subtree, "id").join(figures.select("id", "n_children"), "id")
        .join(tops.select("id", "parent_conv"), "id", "left").join(id_lists(ends), ["depth", "k1", "k2"], "left")
    )
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("savings").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
