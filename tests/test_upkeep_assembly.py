"""Nulls, empty tables, ties and order-dependent cases of the upkeep and assembly operators."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import assembly as am
from ledgerloom.operators import corpus as cp
from ledgerloom.operators import ranking as rk
from ledgerloom.operators import upkeep as up


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def close_by_loop(chunks, total):
    out = [list(x) for x in sorted(chunks)]
    out[0][0] = min(out[0][0], 1)
    for prev, cur in zip(out, out[1:], strict=False):
        if cur[0] > prev[1] + 1:
            prev[1] = cur[0] - 1
        elif cur[0] <= prev[1] and not cur[2]:
            cur[0] = prev[1] + 1
    out[-1][1] = max(out[-1][1], total)
    return [tuple(x) for x in out]


def test_close_gaps_equals_the_sequential_rule(spark):
    rng, data, want = random.Random(3), [], []
    for doc in range(40):
        starts = rng.sample(range(1, 90), rng.randint(1, 8))
        chunks = [(a, a + rng.randint(0, 25), rng.random() < 0.3) for a in starts]
        data += [(doc, *x) for x in chunks]
        want += [(doc, a, b) for a, b, _ in close_by_loop(chunks, 100)]
    df = spark.createDataFrame(data, "doc int, line_start int, line_end int, cut boolean").withColumn("total", F.lit(100))
    assert rows(am.close_gaps(df, "doc", "total", "cut").select("doc", "line_start", "line_end")) == sorted(want, key=str)


def test_close_gaps_of_nothing(spark):
    empty = spark.createDataFrame([], "doc int, line_start int, line_end int, total int")
    assert rows(am.close_gaps(empty, "doc", "total")) == []


def test_global_position_with_a_value_that_most_rows_share(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 11).alias("v")).repartition(9)
    got = {r["id"]: r["position"] for r in rk.global_position(df, [F.asc("v"), F.asc("id")]).collect()}
    order = sorted(range(5000), key=lambda i: (7 if i % 3 else i % 11, i))
    assert got == {i: k for k, i in enumerate(order, 1)}
    assert rows(rk.global_position(df.limit(0), [F.asc("id")])) == []


def test_sample_of_few_rows_and_of_none(spark):
    assert cp.deterministic_sample(spark.range(5), "id", "s", 0.3, 20).count() == 5
    assert cp.deterministic_sample(spark.range(0), "id", "s", 0.3, 20).count() == 0
    assert cp.deterministic_sample(spark.range(1000), "id", "s", 0.3, 20).count() == 300


def test_key_dates_without_a_schedule(spark):
    df = spark.createDataFrame([(None,), ([],), ([(None, None, None), ("Absolución de consultas", "1", "2")],)], "s array<struct<stage:string,start:string,end:string>>")
    assert [tuple(r) for r in df.select(am.key_dates(F.col("s")).alias("d")).select("d.*").collect()] == [(None, None)] * 3


def test_build_query_falls_back_to_the_description(spark):
    df = spark.createDataFrame([("plain text", None, None), (None, "g", ["5 kg x 2W"])], "d string, g string, p array<string>")
    q = am.build_query(F.col("d"), F.col("g"), F.col("p"), {"red": "rojo"}, {"g": "group words"}, " buy")
    assert [r[0] for r in df.select(q).collect()] == ["plain text buy", "group words 5 kg 2W buy"]


def test_documents_equal_ignores_dates_that_came_or_went(spark):
    schema = "item int, uuid string, stage string, day string"
    old = spark.createDataFrame([(1, "a", "x", None), (2, "a", "x", "1"), (3, "a", "x", "1"), (4, "", "q", "1"), (4, "b", "x", "1")], schema)
    new = spark.createDataFrame([(1, "a", " x", "9"), (2, "a", "x", "2"), (3, "a", "x", "1"), (3, "b", "x", "1"), (4, "b", "x", " ")], schema)
    assert rows(up.documents_equal(old, new, "item", "uuid", ["stage"], "day")) == [(1, True), (2, False), (3, False), (4, True)]


def test_twin_goes_with_its_decisions_and_old_reference_stays(spark):
    schema = "id int, source_ref string, status string, promoted_at timestamp, has_data boolean, has_analysis boolean, rejected boolean"
    feed = spark.createDataFrame([(1, "10", "done", None, True, True, False), (2, "12", "new", None, None, None, None), (3, "20", "done", None, True, None, None), (4, "21", "new", None, None, None, True)], schema)
    sights = spark.createDataFrame([(1, "12"), (1, "11"), (3, "21"), (3, "x")], "id int, new_ref string")
    decisions = spark.createDataFrame([(2, "a"), (4, "a")], "feed_item_id int, decision string")
    claimed, left, kept = up.adopt_republication(feed.filter("status = 'done'"), sights, feed, decisions, "new")
    assert rows(claimed.select("id", "source_ref", "adopted")) == [(1, "12", True), (3, "20", False)]
    assert rows(left.select("id")) == [(1,), (3,), (4,)]
    assert rows(kept) == [(4, "a")]


def test_unread_latch(spark):
    df = spark.createDataFrame([(1, "b", "a", True), (2, "b", None, True), (3, "b", "a", False), (4, None, "a", None)], "id int, cur string, prev string, unread boolean")
    got = rows(up.mark_unread(df, F.lit(True), "cur", "prev").select("id", "prev", "unread"))
    assert got == [(1, "a", True), (2, "b", True), (3, "b", True), (4, "a", True)]
    assert rows(up.mark_read(df, ["prev"]).select("id", "prev", "unread")) == [(i, None, False) for i in range(1, 5)]


def test_removal_policy_keeps_analyzed(spark):
    feed = spark.createDataFrame([(1, 1, "a", False), (2, 1, "d", False), (3, 1, "p", True), (4, 2, "p", False), (5, None, "p", None)], "id int, entity_id int, status string, busy boolean")
    ids = spark.createDataFrame([(1,), (1,)], "entity_id int")
    words = {"analyzed": ["a"], "downloaded": ["d"], "published": "p", "discarded": "x", "archived": "z"}
    got = rows(up.removal_policy(feed, ids, "keep_analyzed", busy=F.col("busy"), **words).select("id", "next_status", "outcome"))
    assert got == [(1, "a", "kept"), (2, "x", "affected"), (3, "p", "deferred"), (4, "p", "kept"), (5, "p", "kept")]


def test_digest_ignores_row_order_and_sees_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    digest = lambda d: up.table_digest(d, ["k", "v"]).first()["digest"]
    assert digest(df) == digest(df.orderBy(F.desc("k"))) != digest(df.union(df).union(df))
    assert up.hash_gate(df, ["k", "v"], digest(df)).count() == 0
    assert up.hash_gate(df, ["k", "v"], digest(df), forced=True).count() == 2


def test_section_and_entry_checks_on_nulls(spark):
    s = spark.createDataFrame([("1", None), ("x", "3"), ("2", "1"), ("2", "2")], "line_start string, line_end string")
    assert rows(am.valid_line_ranges(s)) == [(2, 2)]
    e = spark.createDataFrame([(1, 1, None, 2, None), (1, 2, 1, 9, "ok")], "doc int, entry int, line_start int, line_end int, evidence string")
    t = spark.createDataFrame([(1, 5)], "doc int, total int")
    assert rows(am.validate_entries(e, t, "doc", "entry")) == [(1, 1, "bad range"), (1, 1, "no evidence"), (1, 2, "past the end")]


def test_clarifications_report_lines_that_do_not_exist(spark):
    lines = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, None)], "doc int, pos int, line string")
    edits = spark.createDataFrame([(1, 0, "modify", "x", 1), (1, 0, "delete", None, 2), (1, 7, "add", "y", 1)], "doc int, pos int, action string, new_text string, v int")
    body, lost = am.apply_clarifications(lines, edits, "doc", "pos", "line", "v")
    assert rows(body) == [(1, "b")] and [r["pos"] for r in lost.collect()] == [7]
