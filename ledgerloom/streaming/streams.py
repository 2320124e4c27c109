"""Streams over files: upserts, changes, duplicates, due items, first and last sight, live counts.

A table that batches are merged into is cut into buckets by key: a batch reads and
rewrites only the buckets that its keys fall into, in a folder of its batch id, and
then the list of each bucket's latest folder.  A batch that is run again after a
loss starts from the list of the batch before, so it gives the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.feed import due_for_refresh, preferred, upsert_feed
from ..sources.readers import read_snapshot, write_snapshot
from ..sources.versions import delete, subfolders

Batch = Callable[[DataFrame, int], None]
BUCKETS = 64


def file_stream(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def stream_upsert(stream: DataFrame, apply: Batch, checkpoint: str) -> StreamingQuery:
    """Each batch is merged by ``apply(batch, batch_id)``, which must be idempotent by batch id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, batch_id: int) -> dict[int, int]:
    """Batch that wrote each bucket last, as of ``batch_id``: one row a bucket, whose number is a parameter."""
    return {r["bucket"]: r["v"] for r in read_snapshot(spark, f"{path}/list", batch_id).collect()} if batch_id >= 0 else {}


def _read_buckets(like: DataFrame, path: str, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return like.limit(0)
    return like.sparkSession.read.schema(like.schema).parquet(*[f"{path}/data/v={v}/_bucket={b}" for b, v in sorted(versions.items())])


def read_table(like: DataFrame, path: str, batch_id: int) -> DataFrame:
    """A merged table as of a batch; ``like`` has its columns."""
    return _read_buckets(like, path, _versions(like.sparkSession, path, batch_id))


def merge_into(rows: DataFrame, path: str, key: Sequence[str], batch_id: int, buckets: int, merge: Callable[[DataFrame, DataFrame], DataFrame], columns: Sequence[str]) -> None:
    """Rewrite the buckets of ``rows`` as ``merge(old, rows)`` gives them; ``columns`` are the table's.

    Rows with a blank key take no part.  A bucket that ``merge`` leaves empty leaves the list.
    """
    spark, bucket = rows.sparkSession, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("_bucket")
    for k in key:
        rows = rows.filter(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    before = _versions(spark, path, batch_id - 1)
    touched = [r[0] for r in rows.select(bucket).distinct().collect()]
    old = _read_buckets(rows.select(*columns), path, {b: before[b] for b in touched if b in before})
    merged = merge(old, rows).select(*columns, bucket)
    merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/v={batch_id}")
    written = [int(name.removeprefix("_bucket=")) for name in subfolders(spark, f"{path}/data/v={batch_id}", "_bucket=")]
    after = {b: v for b, v in before.items() if b not in touched} | dict.fromkeys(written, batch_id)
    write_snapshot(spark.createDataFrame(sorted(after.items()), "bucket int, v long"), f"{path}/list", batch_id)


def drop_old_batches(spark: SparkSession, path: str, batch_id: int, keep: int = 1) -> list[str]:
    """Delete what none of the last ``keep`` batches up to ``batch_id`` needs of a merged table; the names of the folders that went."""
    lists = [v for v in sorted((int(x.removeprefix("v=")) for x in subfolders(spark, f"{path}/list", "v=")), reverse=True) if v <= batch_id]
    needed = {v for n in lists[:keep] for v in _versions(spark, path, n).values()}
    gone = [f"list/v={v}" for v in lists[keep:]]
    gone += [f"data/{x}" for x in subfolders(spark, f"{path}/data", "v=") if int(x.removeprefix("v=")) not in needed and int(x.removeprefix("v=")) <= batch_id]
    for name in gone:
        delete(spark, f"{path}/{name}")
    return gone


def upsert_table(path: str, key: Sequence[str], digest: str, values: Sequence[str], order: Sequence[Column], buckets: int = BUCKETS) -> Batch:
    """For ``stream_upsert``: the feed at ``path`` (see ``read_table``) as of a batch has it merged in."""
    columns = [*key, digest, *values]

    def apply(batch: DataFrame, batch_id: int) -> None:
        merge_into(batch, path, key, batch_id, buckets, lambda old, rows: upsert_feed(old, rows, key, digest, values, order)[0], columns)

    return apply


def change_table(path: str, key: Sequence[str], value: str, order: str, buckets: int = BUCKETS) -> Batch:
    """For ``stream_upsert``: each batch's changes at ``path``/changes, the last value of every key in the table ``path``/state.

    A row is ``added`` (first of its key) or ``modified`` (value differs from the
    key's last one).  Rows that do not advance the key's ``order`` are late and
    go; of rows of equal order in a batch the smallest value counts; rows with a
    blank key or order take no part.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = preferred(batch.select(*key, value, order), [*key, order], [F.asc_nulls_last(value)])
        w = Window.partitionBy(*key).orderBy(order)

        def advanced(old: DataFrame, new: DataFrame) -> DataFrame:
            last = old.select(*key, F.col(value).alias("_value"), F.col(order).alias("_order"))
            fresh = new.join(last, list(key), "left").filter(F.col("_order").isNull() | (F.col(order) > F.col("_order")))
            first = F.row_number().over(w) == 1
            return fresh.withColumns({"first": first & F.col("_order").isNull(), "old": F.when(first, F.col("_value")).otherwise(F.lag(value).over(w))})

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            seen = advanced(old, new)
            kind = F.when(F.col("first"), "added").when(~F.col(value).eqNullSafe(F.col("old")), "modified")
            write_snapshot(seen.select(*key, order, kind.alias("kind"), "old", F.col(value).alias("new")).filter("kind IS NOT NULL"), f"{path}/changes", batch_id)
            state = old.select(*key, value, order).unionByName(seen.select(*key, value, order))
            return state.groupBy(*key).agg(F.max_by(F.struct(value, order), order).alias("_s")).select(*key, f"_s.{value}", f"_s.{order}")

        merge_into(rows, f"{path}/state", key, batch_id, buckets, merge, [*key, value, order])

    return apply


def due_table(path: str, items: Callable[[], DataFrame], tick: str, checked: str, deadline: str) -> Batch:
    """For ``stream_upsert`` over a clock's ticks: at each batch the items due at its latest tick, written at ``path``."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max(tick).cast("timestamp")).first()[0]
        write_snapshot(due_for_refresh(items(), F.lit(now).cast("timestamp"), checked, deadline), path, batch_id)

    return apply


def stream_dedupe(stream: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def first_last_seen(stream: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def status_counts(stream: DataFrame, status: str) -> DataFrame:
    """Live count of each status, for complete mode."""
    return stream.groupBy(status).agg(F.count("*").alias("n"))
