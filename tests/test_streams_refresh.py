import datetime as dt
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators.refresh import refresh_changes
from ledgerloom.sources import readers as rd
from ledgerloom.streaming import streams as st

CHANGE = "k string, v int, n long, extra string"


def run(spark, tmp_path, batches, schema, apply):
    """The batches as files of a stream, one a batch."""
    stream = None
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = st.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], schema))
        st.stream_upsert(stream, apply, f"{tmp_path}/checkpoint").awaitTermination()


def test_stream_changes(spark, tmp_path):
    batches = [
        [("a", 1, 1, "x"), ("a", 1, 2, "x"), ("a", 2, 3, "x"), ("b", None, 5, "y"), (None, 1, 1, "z")],
        [("a", 9, 2, "late"), ("a", 2, 4, "same"), ("b", 7, 6, "y"), ("b", 8, 6, "tie"), ("c", 1, None, "no order")],
        [("a", 9, 4, "does not advance"), ("b", None, 7, None), ("d", 1, 1, "new"), ("d", 1, 1, "repeated")],
    ]
    run(spark, tmp_path, batches, CHANGE, st.change_table(f"{tmp_path}/out", ["k"], "v", "n"))
    got = [sorted(tuple(r) for r in rd.read_snapshot(spark, f"{tmp_path}/out/changes", v).select("k", "n", "kind", "old", "new").collect()) for v in range(3)]
    assert got[0] == [("a", 1, "added", None, 1), ("a", 3, "modified", 1, 2), ("b", 5, "added", None, None)]
    assert got[1] == [("b", 6, "modified", None, 7)]
    assert got[2] == [("b", 7, "modified", 7, None), ("d", 1, "added", None, 1)]
    like = spark.createDataFrame([], "k string, v int, n long")
    assert sorted(tuple(r) for r in st.read_table(like, f"{tmp_path}/out/state", 2).collect()) == [("a", 2, 4), ("b", None, 7), ("d", 1, 1)]


def test_stream_upsert_equals_batches(spark, tmp_path):
    batches = [[("a", 1, 1, "x"), ("b", 2, 1, "y")], [("b", 3, 2, "z"), ("b", 2, 1, "y"), ("c", 4, 1, None)]]
    run(spark, tmp_path, batches, CHANGE, st.upsert_table(f"{tmp_path}/feed", ["k"], "extra", ["v"], [F.desc("n")]))
    like = spark.createDataFrame([], "k string, extra string, v int")
    assert sorted((r.k, r.v) for r in st.read_table(like, f"{tmp_path}/feed", 1).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted((r.k, r.v) for r in st.read_table(like, f"{tmp_path}/feed", 0).collect()) == [("a", 1), ("b", 2)]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    apply = st.upsert_table(f"{tmp_path}/feed", ["k"], "extra", ["v"], [F.desc("n")], buckets=8)
    rows = lambda *x: spark.createDataFrame([(k, v, 1, str(v)) for k, v in x], CHANGE)
    apply(rows(*[(f"k{i}", i) for i in range(60)]), 0)
    for _ in range(2):  # run again after a loss: the same
        apply(rows(("k7", 70)), 1)
        like = spark.createDataFrame([], "k string, extra string, v int")
        got = {r.k: r.v for r in st.read_table(like, f"{tmp_path}/feed", 1).collect()}
        assert got == {f"k{i}": 70 if i == 7 else i for i in range(60)}
    assert len(list((tmp_path / "feed/data/v=0").glob("_bucket=*"))) == 8 and len(list((tmp_path / "feed/data/v=1").glob("_bucket=*"))) == 1
    apply(rows(), 2)
    assert st.read_table(like, f"{tmp_path}/feed", 2).count() == 60


def test_refresh_leaves_missing_emptied_and_fresh_enough(spark):
    now = dt.datetime(2024, 1, 20, 12)
    items = "id long, v string, lists array<int>, previous_v string, unread boolean, checked timestamp, deadline timestamp, note string"
    old = [(1, "a", [1], None, False, None, None, "n"), (2, "a", [1], "z", True, None, None, None), (3, "a", [1], None, None, now, None, None), (4, "a", [1], None, False, None, None, None), (5, "a", [1], None, False, None, None, None)]
    fresh = [(1, "b", [2], "clash"), (1, "b", [2], "repeated"), (2, "c", [], "emptied"), (3, "b", [2], ""), (5, "c", None, ""), (5, "b", [3], ""), (None, "q", [1], ""), (9, "new", [1], "")]
    docs = "id long, uuid string, removed boolean, removed_at timestamp, has_file boolean"
    d = spark.createDataFrame([(1, "u", None, None, True), (1, "w", False, None, False), (4, "u", False, None, True)], docs)
    out = refresh_changes(spark.createDataFrame(old, items), spark.createDataFrame(fresh, "id long, v string, lists array<int>, note string"), d, d.filter("uuid = 'x'"), "id", ["v"], ["lists"], "uuid", "checked", "deadline", F.lit(now))
    got = {r.id: (r.v, r.lists, r.previous_v, r.unread, r.checked, r.note) for r in out.items.collect()}
    assert got == {1: ("b", [2], "a", True, now, "n"), 2: ("a", [1], "z", True, now, None), 3: ("a", [1], None, False, now, None), 4: ("a", [1], None, False, now, None), 5: ("b", [3], "a", True, now, None)}
    assert sorted((r.id, r.kind, r.old, r.new) for r in out.changes.collect()) == [(1, "modified", "a", "b"), (5, "modified", "a", "b")]
    assert sorted((r.id, r.uuid, r.removed) for r in out.documents.collect()) == [(1, "u", True), (4, "u", False)]
    empty = refresh_changes(spark.createDataFrame([], items), spark.createDataFrame([], "id long, v string, lists array<int>"), d.limit(0), d, "id", ["v"], ["lists"], "uuid", "checked", "deadline", F.lit(now))
    assert empty.items.count() == empty.changes.count() == empty.documents.count() == 0


def test_refresh_deals_documents_by_their_number(spark, monkeypatch):
    from ledgerloom.operators import refresh

    monkeypatch.setattr(refresh, "ROWS", 100, raising=False)
    now, then = dt.datetime(2024, 1, 20, 12), dt.datetime(2023, 1, 1)
    items = spark.createDataFrame([(i, "a", [1], None, False, None if i % 4 else now, None) for i in range(400)], "id long, v string, lists array<int>, previous_v string, unread boolean, checked timestamp, deadline timestamp")
    fresh = spark.createDataFrame([(i, "b", [] if i % 5 == 0 else [2]) for i in range(440) if i % 3], "id long, v string, lists array<int>")
    flags = lambda u: (None, None, True) if u == 1 else (True, then, False) if u == 2 else (False, None, None)
    old = [(i, u, *flags(u)) for i in range(420) for u in range(5)] + [(7, 1, *flags(1)), (8, 1, *flags(1)), (None, 1, *flags(1)), (7, None, *flags(1))]
    new = [(i, u) for i in range(440) for u in (1, 2, 9) if u != 1 or i % 2] * 2 + [(7, None), (None, 9)]
    out = refresh_changes(items, fresh, spark.createDataFrame(old, "id long, uuid int, removed boolean, removed_at timestamp, has_file boolean"), spark.createDataFrame(new, "id long, uuid int"), "id", ["v"], ["lists"], "uuid", "checked", "deadline", F.lit(now)).documents
    taken, seen, want = {i for i in range(400) if i % 4 and i % 3 and i % 5}, set(new), []
    for i, u, removed, at, file in old:
        if i not in taken:
            want.append((i, u, bool(removed), at))
        elif u is not None and (i, u) in seen:
            want.append((i, u, False, None))
        elif removed or file:
            want.append((i, u, True, at if removed else now))
    known = {x[:2] for x in old}
    want += [(i, u, False, None) for i, u in seen if i in taken and (u is None or (i, u) not in known)]
    got = out.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(map(str, want)) == sorted(str((r.id, r.uuid, r.removed, r.removed_at)) for r in got)
    rows = Counter(r.part for r in got)
    assert len(rows) > 30 and max(rows.values()) < 200
