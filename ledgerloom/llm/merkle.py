"""Merkle manifest of a dataset: a content-addressed DAG that requests descend.

A row is a leaf.  Leaves of a group (``lang``) in the order of their ids form a tree
of ``FAN`` children a node, whose root is the group's subroot; the subroots, ordered
by group, form a tree of the same kind over them.  A digest H is the lowercase hex
SHA-256 of its inputs, concatenated.

Building: ranks are global row numbers less the start of their group.  Each level is
one aggregate of at most ``FAN`` rows a key and is written as records (digest,
children), which is all that the DAG stores.

Proving: leaf requests start at the root and descend by the digits of their rank in
base ``FAN``.  Requests that share leading digits share one row until they part: a
step looks the row's digest up among the records, goes to each child that is asked
for and keeps the children that were not chosen as a path segment.  The segments,
reversed, are the proof from the leaf upwards.  A level of n rows is joined with n
records, by digest; only the last step, from ``FAN`` leaves' parent to the leaf, has
a row for each request.

Defined results: a null column of a leaf is ``-``; rows are ordered by group (null
first, bytewise), id (null first) and leaf, so that repeated rows are neighbours and
each has its own proof; rows with a null id are never tampered with; an empty table
gives an empty result; further columns, whatever their names, are not read.  Texts
are hashed whole and are not shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .scans import prefix_sums

FAN = 8
FILE_ROWS = 2000  # a written file has about as many rows at least
LEAF = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENTS = "array<struct<left: binary, right: binary>>"


def counted(value: Column) -> Column:
    """A value with its byte count before it, ``-`` if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(counted, values)), 256)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_bytes(digests: Column) -> Column:
    """An array of digests as one run of bytes."""
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def digest_of(children: Column) -> Column:
    return F.unhex(F.sha2(F.array_join(F.transform(children, hexed), ""), 256))


@dataclass
class Manifest:
    """``rows``: (grp, rank, leaf) and what the leaves came with; ``groups``: (grp, name, size, subroot);
    ``size``: number of rows; ``levels``, ``top``: records (grp, at, digest, children) of the groups' trees and of the tree over them, from the bottom; ``root``: its one digest."""

    rows: DataFrame
    groups: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: DataFrame
    size: int

    def records(self) -> DataFrame:
        """The DAG: the children of every digest that has some."""
        spark = self.rows.sparkSession
        out = spark.createDataFrame([], "digest binary, children array<binary>")
        for level in [*self.levels, *self.top]:
            out = out.unionByName(level.select("digest", "children"))
        return out.dropDuplicates(["digest"])


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than its number of rows fills: a file costs its writer a process where the shared folder is local."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def tree(nodes: DataFrame, largest: int, rows: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level over the ``rows`` ``nodes`` (grp, at, n, digest), ``n`` nodes in its group, and (grp, digest) of what remains of each."""
    levels, ends = [], nodes.filter("n = 1").select("grp", "digest")
    while largest > 1:
        own = F.sort_array(F.collect_list(F.struct("at", "digest")))
        level = nodes.filter("n > 1").groupBy("grp", F.expr(f"at div {FAN}").alias("at"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n")).agg(own.alias("_own"))
        level = level.withColumn("children", F.transform("_own", lambda x: x["digest"])).withColumn("digest", digest_of(F.col("children")))
        rows = -(-rows // FAN)
        nodes = materialise(gathered(level.select("grp", "at", "n", "digest", "children"), rows), name)
        levels.append(nodes)
        ends = ends.unionByName(nodes.filter("n = 1").select("grp", "digest"))
        largest = -(-largest // FAN)
    return levels, ends


def build(leaves: DataFrame, group: str, order: list[str], keep: list[str]) -> Manifest:
    """The manifest of ``leaves``: a row each, with its digest in ``leaf``; ``order`` ends in a column that tells equal leaves apart."""
    counts = leaves.groupBy(F.col(group).alias("name")).agg(F.count("*").alias("size"))
    groups = prefix_sums(counts, ["name"], {"grp": F.lit(1), "_start": F.col("size")}, "groups")
    placed = prefix_sums(leaves, [group, *order], {"_position": F.lit(1)}, "leaves")
    rows = placed.join(groups, placed[group].eqNullSafe(groups["name"])).select("grp", (F.col("_position") - F.col("_start")).alias("rank"), "size", "leaf", *keep)
    largest, n_groups, size = groups.agg(F.max("size"), F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    levels, ends = tree(rows.select("grp", F.col("rank").alias("at"), F.col("size").alias("n"), F.col("leaf").alias("digest")), largest or 0, size, "level")
    groups = materialise(gathered(groups.join(ends, "grp").select("grp", "name", "size", F.col("digest").alias("subroot")), n_groups), "subroots")
    top, root = tree(groups.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("at"), F.lit(n_groups).cast("long").alias("n"), F.col("subroot").alias("digest")), n_groups, n_groups, "top")
    return Manifest(rows, groups, levels, top, root.select(F.col("digest").alias("root")), size)


def found(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The frontier's rows with their digests' children; equal digests have equal children."""
    return frontier.join(records.groupBy("digest").agg(F.first("children").alias("children")), "digest")


def split(children: Column, chosen: Column) -> Column:
    """The children before and after the chosen one, as a path segment."""
    return F.struct(joined_bytes(F.slice(children, F.lit(1), chosen)).alias("left"), joined_bytes(F.slice(children, chosen + 2, F.lit(FAN))).alias("right"))


def step(frontier: DataFrame, records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """All rows of ``frontier`` (grp, at, digest, path and others) one level down, or those only whose (grp, at) are ``wanted``."""
    rest = [c for c in frontier.columns if c not in ("at", "digest", "path")]
    down = found(frontier, records).select(*rest, "at", "path", "children", F.posexplode("children").alias("_digit", "_child"))
    down = down.select(*rest, (F.col("at") * FAN + F.col("_digit")).alias("at"), F.col("_child").alias("digest"), F.concat("path", F.array(split(F.col("children"), F.col("_digit")))).alias("path"))
    return down if wanted is None else down.join(wanted, ["grp", "at"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Rows of the manifest, or of ``requests`` (some of its rows) only, with subroot, root and ``path``: segments from the leaf to the root."""
    asked = manifest.rows if requests is None else requests

    def prefixes(height: int) -> DataFrame | None:
        """Where the requests are at that height."""
        return None if requests is None else asked.select("grp", F.expr(f"rank div {FAN**height}").alias("at")).distinct()

    start = manifest.root.select(F.lit(0).cast("long").alias("grp"), F.lit(0).cast("long").alias("at"), F.col("root").alias("digest"), F.lit(None).cast(SEGMENTS).alias("path"), "root")
    above = start.withColumn("path", F.array().cast(SEGMENTS))
    for records in reversed(manifest.top):
        above = step(above, records)
    heads = above.select(F.col("at").alias("grp"), F.lit(0).cast("long").alias("at"), "digest", "path", "root", F.col("digest").alias("subroot"))
    if requests is not None:
        heads = heads.join(asked.select("grp").distinct(), "grp", "left_semi")
    heads = heads.join(manifest.groups.select("grp", "size"), "grp")
    frontier = None
    for height in range(len(manifest.levels), 0, -1):
        begin = heads.filter(F.col("size").between(FAN ** (height - 1) + 1, FAN**height)).drop("size")
        frontier = begin if frontier is None else frontier.unionByName(begin)
        if height > 1:
            frontier = step(frontier, manifest.levels[height - 1], prefixes(height - 1))
    parents = heads.filter("size = 1").drop("size", "digest").withColumn("children", F.lit(None).cast("array<binary>"))
    if frontier is not None:
        parents = parents.unionByName(found(frontier, manifest.levels[0]).drop("digest"))
    digit = F.pmod("rank", F.lit(FAN)).cast("int")
    met = asked.withColumn("at", F.expr(f"rank div {FAN}")).join(parents, ["grp", "at"])
    whole = F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", F.array(split(F.col("children"), digit))))
    return met.select(*asked.columns, "subroot", "root", F.reverse(whole).alias("path"))


def proof_digest(path: Column) -> Column:
    """H of all siblings, from the leaf's up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its siblings give."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(hexed(s["left"]), at, hexed(s["right"])), 256))


def manifest_of(docs: DataFrame) -> Manifest:
    """The manifest of ``documents``; its rows also carry ``tampered``: the leaf with a lower-cased text where the id's check sum is divisible by 3."""
    values = {c: docs[c].cast("string") for c in LEAF}
    lowered = values | {"text": F.translate(values["text"], UPPER, LOWER)}
    own = leaf_of([values[c] for c in LEAF])
    hit = F.coalesce(F.pmod(F.crc32(values["doc_id"].cast("binary")), F.lit(3)) == 0, F.lit(False))
    slim = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), values["lang"].alias("lang"), F.unhex(own).alias("leaf"),
        F.unhex(F.when(hit, leaf_of([lowered[c] for c in LEAF])).otherwise(own)).alias("tampered"), F.monotonically_increasing_id().alias("_tie"),
    )
    return build(slim, "lang", ["doc_id", "leaf", "_tie"], ["doc_id", "tampered"])


def verify(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    manifest = manifest_of(docs)
    proved = prove(manifest)
    out = proved.select(
        "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), folded(hexed(F.col("tampered")), F.col("path")).alias("folded_root"),
    )
    return gathered(out.withColumn("verified", F.col("folded_root") == F.col("root")), manifest.size)
