"""Reproducible shuffled sharding by a Feistel permutation of global row numbers.

Rows get global numbers 0..n-1 in the order of (doc_id, text digest): a range
shuffle of slim rows, a count a partition and a running sum.  A keyed Feistel
network permutes the smallest even-width domain that holds n, and cycle walking
(applying it again while the value is n or more) keeps it a permutation of
0..n-1.  Position p goes to shard ``p mod k``, slot ``p div k``: shard sizes
differ by one row at most, slots have no gaps, and both can be computed for any
row number, or back from shard and slot, without the data.

Law ``rows``.  Defined results: null text has size 8 and the check sum of empty
bytes; null doc_id sorts first; repeated rows are told apart only by their
number; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

ROUNDS = 6
SEED = 20_240_607
SHARDS = 24


def round_keys(seed: int = SEED, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Odd multiplier and addend (below 2^30) of each round, from a linear congruential generator."""
    keys, x = [], seed
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            x = (x * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) % 2**64
            pair.append(x >> 34)
        keys.append((pair[0] | 1, pair[1]))
    return keys


def half_width(n: int) -> int:
    """Bits of half a block, so that 2^(2h) holds n."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permute(values: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Images of ``values`` under the permutation of 0..n-1."""
    half = half_width(n)
    mask = (1 << half) - 1
    out = np.asarray(values, "int64").copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for a, b in round_keys(seed, rounds):
            mixed = (right & 0x3FFFFFFF) * a + b
            left, right = right, left ^ ((mixed ^ (mixed >> 15) ^ (mixed >> 29)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def unpermute(values: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The row numbers whose images are ``values``."""
    half = half_width(n)
    mask = (1 << half) - 1
    out = np.asarray(values, "int64").copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for a, b in reversed(round_keys(seed, rounds)):
            mixed = (left & 0x3FFFFFFF) * a + b
            left, right = right ^ ((mixed ^ (mixed >> 15) ^ (mixed >> 29)) & mask), left
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out


def number_rows(df: DataFrame, order: list) -> tuple[DataFrame, int]:
    """``df`` with a global ``row_number`` (from 0) in the given order, and the number of rows.

    Rows equal in ``order`` are spread over partitions by a tie-breaker, so a
    hot key does not fill one task.  The written table fixes the partitions.
    """
    inside = F.monotonically_increasing_id() % F.lit(1 << 33)
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    fixed = materialise(ranged.select("*", F.spark_partition_id().alias("_part"), inside.alias("_at")), "numbered")
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a partition: their number is a setting, not the data's
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    total = fixed.count()
    return fixed.join(F.broadcast(starts), "_part").withColumn("row_number", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), total


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Size, check sum, shard and slot of each row."""
    body = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    slim = docs.select(docs[doc_id].alias("doc_id"), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("_digest"))
    numbered, n = number_rows(slim, ["doc_id", "_digest"])

    @F.pandas_udf("long")
    def position(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    placed = numbered.withColumn("_position", position("row_number"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_position") % shards).cast("int").alias("shard"),
        F.expr(f"_position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
