"""Keyed state, timers, sources of their own, windows, merged tables with blank keys, and versions behind a pointer."""

import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerloom.sources import versions as vs
from ledgerloom.streaming import jobs
from ledgerloom.streaming import keyed as ky
from ledgerloom.streaming import streams as st

CHANGE = "k string, v int, n long, extra string"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def to_end(stream, path, mode="append"):
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def test_changes_in_keyed_state_over_restarts(spark, tmp_path):
    batches = [
        [("a", 1, 1, "x"), ("a", 1, 2, "x"), ("a", 2, 3, "x"), ("b", None, 5, "y"), (None, 1, 1, "z"), (" ", 1, 1, "z")],
        [("a", 9, 2, "late"), ("a", 2, 4, "same"), ("b", 7, 6, "y"), ("b", 8, 6, "tie"), ("c", 1, None, "no order")],
        [("a", 9, 4, "does not advance"), ("b", None, 7, None), ("d", 1, 1, "new"), ("d", 1, 1, "repeated"), ("a", 5, 6, "")],
    ]
    want = [
        [("a", 1, "added", None, 1), ("a", 3, "modified", 1, 2), ("b", 5, "added", None, None)],
        [("b", 6, "modified", None, 7)],
        [("a", 6, "modified", 2, 5), ("b", 7, "modified", 7, None), ("d", 1, "added", None, 1)],
    ]
    seen = []
    for batch, new in zip(batches, want, strict=True):  # each run starts from the checkpoint of the one before
        put(spark, tmp_path / "in", batch, CHANGE)
        to_end(ky.stream_changes(st.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], CHANGE)), ["k"], "v", "n"), tmp_path)
        got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("k", "n", "kind", "old", "new").collect()]
        for row in seen:
            got.remove(row)
        assert sorted(got, key=str) == sorted(new, key=str)
        seen += got
    once = tmp_path / "at-once"  # all rows as one batch: those that were late only between batches count
    to_end(ky.stream_changes(st.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], CHANGE), 100), ["k"], "v", "n"), once)
    assert ("a", 2, "modified", 1, 9) not in [tuple(r) for r in spark.read.parquet(f"{once}/out").select("k", "n", "kind", "old", "new").collect()]


def test_patience_ends_at_the_first_time_either_rule_holds():
    due = ky.Due(["k"], base=100, urgent=10, horizon=50)
    assert due.due_at(None, [5]) == 0
    assert due.due_at(0, []) == 100
    assert due.due_at(0, [30]) == 10  # near from the start
    assert due.due_at(0, [120]) == 70  # becomes near at 70
    assert due.due_at(0, [500]) == 100
    assert due.due_at(1000, [30]) == 1100  # long past
    assert due.due_at(0, [500, 130]) == 80
    for checked in range(0, 300, 7):
        for d in range(0, 400, 11):
            slow = next(t for t in range(2000) if t >= checked + (10 if abs(d - t) <= 50 else 100))
            assert due.due_at(checked, [d]) == slow


def test_an_item_wakes_without_a_row_of_its_own(spark, tmp_path):
    schema = "k string, ts timestamp, checked timestamp, deadline timestamp"
    like = spark.createDataFrame([], schema)

    def run(rows):
        put(spark, tmp_path / "in", rows, "k string, ts string, checked string, deadline string")
        clock = spark.readStream.schema("k string, ts string, checked string, deadline string").parquet(f"{tmp_path}/in")
        timed = clock.select("k", *[F.col(c).cast("timestamp").alias(c) for c in ("ts", "checked", "deadline")]).withWatermark("ts", "0 seconds")
        to_end(ky.stream_due(timed, ["k"], "checked", "deadline", watermark="ts"), tmp_path)
        return sorted((r.k, r.t) for r in spark.read.schema("k string, due_at timestamp").parquet(f"{tmp_path}/out").select("k", F.date_format("due_at", "dd HH:mm").alias("t")).collect())

    assert like.columns == ["k", "ts", "checked", "deadline"]
    assert run([("a", "2024-01-10 10:00", "2024-01-10 10:00", None), ("b", "2024-01-10 10:00", "2024-01-10 10:00", "2024-01-11 10:00"), (None, "2024-01-10 10:00", None, None)]) == []
    # only the clock moves: b's patience is short near its deadline
    assert run([("tick", "2024-01-10 11:00", "2024-01-10 11:00", None)]) == [("b", "10 10:45")]
    # b was checked again, a is due after three hours
    assert run([("b", "2024-01-10 11:01", "2024-01-10 11:01", None), ("tick", "2024-01-10 13:30", "2024-01-10 13:30", None)]) == [("a", "10 13:00"), ("b", "10 10:45")]
    assert run([("tick", "2024-01-10 14:10", "2024-01-10 14:10", None)]) == [("a", "10 13:00"), ("b", "10 10:45"), ("b", "10 14:01")]


def test_timers_of_the_machines_clock(spark, tmp_path):
    now = time.time()
    schema = "k string, checked double, deadline double"
    put(spark, tmp_path / "in", [("soon", now, None), ("never", None, None), ("later", now + 3600, None)], schema)
    items = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").select("k", *[F.timestamp_seconds(c).alias(c) for c in ("checked", "deadline")])
    query = ky.stream_due(items, ["k"], "checked", "deadline", base_s=6).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
    try:
        found, until = [], time.time() + 60
        while time.time() < until and "soon" not in found:
            time.sleep(1)
            found = [r.k for r in spark.read.schema("k string").parquet(f"{tmp_path}/out").collect()] if (tmp_path / "out/_spark_metadata").exists() else []
    finally:
        query.stop()
    assert sorted(found) == ["never", "soon"]


def test_a_source_that_fails_stops_no_other(spark, tmp_path):
    for name in ("good", "bad", "late"):
        put(spark, tmp_path / name, [("a", 1, 1, "x"), ("b", 2, 1, "y")], CHANGE)
    put(spark, tmp_path / "bad", [("c", 3, 1, "z")], CHANGE)
    broken = True

    def apply(name):
        merge = st.upsert_table(f"{tmp_path}/tables/{name}", ["k"], "extra", ["v"], [F.desc("n")])

        def run(batch, batch_id):
            if broken and name == "bad" and batch_id == 1:
                raise RuntimeError("the source's second batch")
            merge(batch, batch_id)

        return run

    like = spark.createDataFrame([], CHANGE)
    streams = lambda: {n: st.file_stream(spark, f"{tmp_path}/{n}", like) for n in ("good", "bad", "late")}
    runs = jobs.run_sources(spark, streams(), apply, f"{tmp_path}/checkpoints")
    assert (runs["good"].ok, runs["late"].ok, runs["bad"].ok) == (True, True, False) and "second batch" in runs["bad"].error
    assert (runs["good"].batches, runs["bad"].batches) == (1, 1)
    table = lambda n, v: sorted((r.k, r.v) for r in st.read_table(spark.createDataFrame([], "k string, extra string, v int"), f"{tmp_path}/tables/{n}", v).collect())
    assert table("good", 0) == table("late", 0) == [("a", 1), ("b", 2)]
    broken = False
    runs = jobs.run_sources(spark, streams(), apply, f"{tmp_path}/checkpoints")
    assert runs["bad"].ok and runs["bad"].batches == 1 and runs["good"].batches == 0
    assert table("bad", 1) == [("a", 1), ("b", 2), ("c", 3)]


def test_blank_keys_and_emptied_buckets(spark, tmp_path):
    apply = st.upsert_table(f"{tmp_path}/feed", ["k"], "extra", ["v"], [F.desc("n")], buckets=4)
    rows = lambda *x: spark.createDataFrame([(k, v, 1, str(v)) for k, v in x], CHANGE)
    like = spark.createDataFrame([], "k string, extra string, v int")
    read = lambda n: sorted((r.k, r.v) for r in st.read_table(like, f"{tmp_path}/feed", n).collect())
    apply(rows((None, 1), ("", 2), (" ", 3)), 0)
    assert read(0) == []
    apply(rows((None, 1), ("a", 2), ("", 3), ("b", 4)), 1)
    assert read(1) == [("a", 2), ("b", 4)]
    columns = ["k", "extra", "v"]
    st.merge_into(rows(("a", 0)), f"{tmp_path}/feed", ["k"], 2, 4, lambda old, new: old.limit(0), columns)
    assert [k for k, _ in read(2)] in (["b"], [])
    apply(rows(("a", 7), (None, 7)), 3)
    assert ("a", 7) in read(3)
    before = read(3)
    assert st.drop_old_batches(spark, f"{tmp_path}/feed", 3) and read(3) == before
    assert vs.subfolders(spark, f"{tmp_path}/feed/list") == ["v=3"]
    apply(rows(("z", 1)), 4)
    assert ("z", 1) in read(4)


def test_closed_days_come_once(spark, tmp_path):
    def run(rows):
        put(spark, tmp_path / "in", rows, "ts string, kind string")
        to_end(ky.daily_counts(spark.readStream.schema("ts string, kind string").parquet(f"{tmp_path}/in"), "ts", ["kind"], "1 hour"), tmp_path)
        return sorted((str(r.day), str(r.kind), r.n) for r in spark.read.schema("day date, kind string, n long").parquet(f"{tmp_path}/out").collect())

    assert run([("2024-01-01 10:00", "a"), ("2024-01-01 11:00", "a"), ("2024-01-01 23:00", "b"), (None, "b")]) == []
    first = [("2024-01-01", "a", 2), ("2024-01-01", "b", 2)]
    assert run([("2024-01-02 00:30", "a"), ("2024-01-01 23:50", "b")]) == []  # within the hour
    assert run([("2024-01-02 01:30", "a")]) == first
    assert run([("2024-01-01 12:00", "a"), ("2024-01-02 02:00", None)]) == first  # too late
    assert run([("2024-01-03 02:00", "c")]) == [*first, ("2024-01-02", "None", 1), ("2024-01-02", "a", 2)]


def test_versions_behind_a_pointer(spark, tmp_path):
    path, df = f"file://{tmp_path}/t", spark.range(3)
    with pytest.raises(FileNotFoundError):
        vs.read_latest(spark, path)
    assert vs.publish(df, path) == 0 and vs.read_latest(spark, path).count() == 3
    kept = vs.read_latest(spark, path)

    def dies(it):
        raise RuntimeError("the writer dies")

    with pytest.raises(Exception, match="the writer dies"):
        vs.publish(df.mapInPandas(dies, "id long"), path)
    assert vs.latest(spark, path) == 0 and vs.read_latest(spark, path).count() == 3
    spark.range(5).write.parquet(f"{path}/v=7")  # of a writer that died before it moved the pointer
    assert vs.latest(spark, path) == 0
    assert vs.publish(spark.range(4), path) == 8 and vs.read_latest(spark, path).count() == 4 and kept.count() == 3
    assert vs.publish(spark.range(1), path, keep=2) == 9 and vs.subfolders(spark, path, "v=") == ["v=8", "v=9"]
    with pytest.raises(ValueError):
        vs.retain(spark, path, 0)


class Held:
    """A state store of one key."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_keys_are_read_as_rows_without_a_frame_each():
    held, began = Held(), time.time()
    changes = ky.Changes(["k"], "long")
    changes.init(held)
    rows = lambda *pairs: iter([Row(at=a, value=v) for a, v in pairs])
    got = [tuple(r) for r in changes.handleInputRows(("a",), rows((2, None), (1, "9"), (1, "10"), (2, "b"), (3, "b"), (4, None)), None)]
    assert got == [("a", 1, "added", None, "10"), ("a", 2, "modified", "10", "b"), ("a", 4, "modified", "b", None)]
    assert [tuple(r) for r in changes.handleInputRows(("a",), rows((4, "late"), (5, None)), None)] == [] and held.value == (None, 5)
    for k in range(20_000):
        held.value = None
        assert len(list(changes.handleInputRows((k,), rows((2, "b"), (1, "a")), None))) == 2
    assert time.time() - began < 5  # a frame a key took over a millisecond each
    item = Held()
    due = ky.Due(["k"], base=100, urgent=10, horizon=50)
    due.init(item)
    for checked, deadline in ((None, None), (7, 400), (7, None), (3, 20)):
        assert list(due.handleInputRows(("a",), iter([Row(checked=checked, deadline=deadline), Row(checked=None, deadline=9)]), None)) == []
    assert item.value == (7, None) and item.timers == [107]
