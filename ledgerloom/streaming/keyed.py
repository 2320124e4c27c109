"""Streams with a state of their own a key: changes of values, and items that wake when they are due.

The state of a key is one value (and one timer) in the state store, which the
checkpoint holds; nothing is rewritten but the keys that a batch or a timer touches.
A stream that starts again from its checkpoint goes on where its last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DataType, IntegralType, TimestampType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Let the session keep the state of keys in RocksDB, which these streams need; it holds for streams that start later."""
    spark.conf.set(PROVIDER, ROCKS)


def _filled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.filter(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    return df


def _sortable(c: str, kind: DataType) -> Column:
    """An order as whole number, or as text, which sorts by its bytes."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(c)
    return F.col(c).cast("long") if isinstance(kind, IntegralType) else F.col(c).cast("string")


class Changes(StatefulProcessor):
    """Value and order of a key's last row; rows out are (order, kind, old, new)."""

    def __init__(self, keys: Sequence[str], order: str):
        self.keys, self.order = list(keys), order

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", f"value string, at {self.order}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()
        old, at = last if last is not None else (None, None)
        least: dict = {}  # the smallest value of each order, null after all others
        for row in rows:
            k, v = row["at"], row["value"]
            if last is not None and k <= at:
                continue
            if k not in least or v is not None and (least[k] is None or v < least[k]):
                least[k] = v
        if not least:
            return
        first = last is None
        for k in sorted(least):
            new = least[k]
            if first or old != new:
                yield Row(**dict(zip(self.keys, key, strict=True)), at=k, kind="added" if first else "modified", old=old, new=new)
            old, at, first = new, k, False
        self.last.update((old, at))

    def close(self) -> None:
        pass


def stream_changes(stream: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, order, kind, old, new) of a stream: each row whose value differs from the one before it of its key.

    A row is ``added`` (first of its key) or ``modified``.  Rows that do not advance the
    key's ``order`` are late and go; of rows of equal order in a batch the smallest value
    counts, null last (values compare as text); rows with a blank key or order take no
    part.  A key's rows of one batch that differ are held together, which the size of a
    batch bounds; its state is one value.
    """
    keyed_state(stream.sparkSession)
    fields = stream.schema
    kind, order_kind = fields[value].dataType, fields[order].dataType
    at = "string" if not isinstance(order_kind, TimestampType | IntegralType) else "long"
    # rows reach Python as named tuples, which take plain names only
    plain = [f"key{k}" for k in range(len(keys))]
    named = [F.col(k).alias(p) for k, p in zip(keys, plain, strict=True)]
    slim = _filled(stream, [*keys, order]).select(*named, _sortable(order, order_kind).alias("at"), F.col(value).cast("string").alias("value"))
    schema = ", ".join(f"{p} {fields[k].dataType.simpleString()}" for k, p in zip(keys, plain, strict=True)) + f", at {at}, kind string, old string, new string"
    found = slim.groupBy(*plain).transformWithState(Changes(plain, at), schema, "Append", "None")
    back = F.timestamp_micros("at") if isinstance(order_kind, TimestampType) else F.col("at")
    return found.select(*[F.col(p).alias(k) for k, p in zip(keys, plain, strict=True)], back.cast(order_kind).alias(order), "kind", F.col("old").cast(kind).alias("old"), F.col("new").cast(kind).alias("new"))


class Due(StatefulProcessor):
    """When an item was checked last and its deadline; a timer wakes it.  Times are milliseconds."""

    def __init__(self, keys: Sequence[str], base: int, urgent: int, horizon: int):
        self.keys, self.base, self.urgent, self.horizon = list(keys), base, urgent, horizon

    def init(self, handle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "checked long, deadline long")

    def due_at(self, checked: int | None, deadlines: Sequence[int]) -> int:
        """The first time at which the item's patience has run out: short while a deadline is near, before or after it."""
        if checked is None:
            return 0
        times = [checked + self.base]
        for d in deadlines:
            soon = max(checked + self.urgent, d - self.horizon)
            if soon <= d + self.horizon:
                times.append(soon)
        return min(times)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        checked, deadline = self.item.get() or (None, None)
        # nulls come before all times
        rank = lambda times: tuple((x is not None, x or 0) for x in times)
        latest, until = max(((row["checked"], row["deadline"]) for row in rows), key=rank)
        if checked is None or latest is not None and latest >= checked:
            checked, deadline = latest, until
        self.item.update((checked, deadline))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(1, self.due_at(checked, [] if deadline is None else [deadline])))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(**dict(zip(self.keys, key, strict=True)), due_at=int(expiredTimerInfo.getExpiryTimeInMs()))

    def close(self) -> None:
        pass


def stream_due(stream: DataFrame, keys: Sequence[str], checked: str, deadline: str, base_s: int = 10_800, urgent_s: int = 2_700, horizon_s: int = 172_800, watermark: str | None = None) -> DataFrame:
    """(keys, due_at): each item once when its patience runs out, without a row of its own, until a row says that it was checked.

    A row tells when an item was checked last (null: never, it is due at once) and its
    deadline; of several the latest check counts.  The patience is ``base_s``, or ``urgent_s`` within ``horizon_s`` of the deadline.
    Timers are of the machine's clock, looked at with every batch of the stream; with
    ``watermark``, a column that the caller has set one on, they are of that.  Rows with a blank key take no part.
    """
    keyed_state(stream.sparkSession)
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    plain = [f"key{k}" for k in range(len(keys))]
    named = [F.col(k).alias(p) for k, p in zip(keys, plain, strict=True)]
    slim = _filled(stream, keys).select(*named, ms(checked).alias("checked"), ms(deadline).alias("deadline"), *([F.col(watermark)] if watermark else []))
    schema = ", ".join(f"{p} {stream.schema[k].dataType.simpleString()}" for k, p in zip(keys, plain, strict=True)) + ", due_at long"
    clock = "EventTime" if watermark else "ProcessingTime"
    found = slim.groupBy(*plain).transformWithState(Due(plain, 1000 * base_s, 1000 * urgent_s, 1000 * horizon_s), schema, "Append", clock)
    return found.select(*[F.col(p).alias(k) for k, p in zip(keys, plain, strict=True)], F.timestamp_millis("due_at").alias("due_at"))


def daily_counts(stream: DataFrame, ts: str, by: Sequence[str], delay: str, width: str = "1 day") -> DataFrame:
    """(day, by, n) of windows of event time, for append mode: each closed window once, after which its state goes; rows later than ``delay`` behind the latest are dropped."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    counted = timed.groupBy(F.window("_ts", width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), *by, "n")
