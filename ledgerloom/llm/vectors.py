"""What both vector searches share: usable rows, query rows, blocks and the final ranking.

A vector takes part if it and its id are not null, it has at least one component
and all components are finite.  Vectors are compared only with vectors of their
own length.  Queries are rows whose id is divisible by ``EVERY`` (one per id: of
rows that repeat an id the smallest vector asks); candidates are all rows with
another id, repeated rows as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVERY = 50
K = 5
CANDIDATE_BLOCK = 65_536  # rows of a block at most
QUERY_BLOCK = 16_384
CANDIDATE_BYTES = 32 << 20  # of a block's components
QUERY_BYTES = 8 << 20


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part; v as doubles."""
    v = df[embedding].cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(df[vec_id].isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite).select(df[vec_id].cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))


def query_rows(rows: DataFrame, every: int = EVERY) -> DataFrame:
    return rows.filter(F.col("vec_id") % every == 0).groupBy("dim", "vec_id").agg(F.min("v").alias("v"))


def block_count(rows: int, block: int, least: int = 1) -> int:
    return max(1, least, -(-rows // block))


def block_rows(dim: int, most: int, most_bytes: int) -> int:
    """Rows of a block of vectors with ``dim`` components."""
    return max(1, min(most, most_bytes // (8 * max(dim, 1))))


def ranked(found: DataFrame, k: int = K) -> DataFrame:
    """The k best (query_id, vec_id, score) of each query; a task has sent at most k a query."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
