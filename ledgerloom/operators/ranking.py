"""Positions over a whole table without a window over one partition."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared one; a local one only in a local session that names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that later steps do not compute it again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(tables: Sequence[DataFrame], rows: int) -> int:
    """Partitions of about ``rows`` rows of all tables together, one a core at least; counts them."""
    whole = None
    for t in tables:
        own = t.select(F.lit(1))
        whole = own if whole is None else whole.unionByName(own)
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, 1 + whole.count() // rows)


def global_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` with positions from 1 in the given order, which should end in a unique column.

    The range-sorted rows are written once with their place in their partition;
    sizes of partitions (one row each) give the offsets.  A value that a third
    of the rows share is split by the later order columns.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, "positions")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, "_part").withColumn(name, F.col("_before") + inside + 1).drop("_at", "_part", "_before")


def assign_ids(df: DataFrame, old_id: str, tie: Sequence[Column], pattern: str = "EXP-%03d", name: str = "new_id") -> DataFrame:
    """Renumbered ids in the order of the old ones; missing old ids come last."""
    placed = global_position(df, [F.asc_nulls_last(old_id), *tie], "_position")
    return placed.withColumn(name, F.format_string(pattern, F.col("_position"))).drop("_position")
