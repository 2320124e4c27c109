from pyspark.sql import functions as F

from ledgerloom.operators.scan import scan_actions, scan_cycle

FEED = "id long, source_ref string, key string, status string, claimed boolean, digest string, title string, last_seen timestamp, promoted_at timestamp, has_data boolean, has_analysis boolean, rejected boolean"
SNAP = "source_ref string, key string, digest string, title string"


def cycle(spark, feed, snap, decisions=()):
    f = spark.createDataFrame([(*r, None, None, None, None, None) for r in feed], FEED)
    actions = scan_actions(f, spark.createDataFrame(snap, SNAP), [F.asc("source_ref")], "pub", ["dead"], F.lit(False))
    nxt, kept = scan_cycle(f, spark.createDataFrame(list(decisions), "tenant_id string, feed_item_id long, decision string"), actions, ["title"], "pub", F.lit("2024-01-01").cast("timestamp"), F.lit(99).cast("long"))
    return {(r.source_ref, r.action, r.target) for r in actions.collect()}, sorted((r.id, r.source_ref, r.title, r.last_seen is not None) for r in nxt.collect()), kept.count()


def test_scan_cycle(spark):
    feed = [(1, "10", "K a", "done", True, "d", "t"), (2, "12", "k  A", "pub", False, "d", "t"), (3, "20", "b", "pub", None, "d", "t"), (4, "30", "c", "dead", False, "d", "t"), (5, "40", None, "pub", False, "d", "t")]
    snap = [("12", "k a", "d", "t"), ("12", "k a", "d", "t"), ("", "x", "d", "t"), (None, "x", "d", "t"), ("30", "c", "e", "u"), ("20", "b", "e", "u"), ("40", " ", "d", "t"), ("50", "n", "d", "first"), ("51", "N", "d", "second")]
    actions, nxt, kept = cycle(spark, feed, snap, [("t", 2, "exempt"), ("t", 3, "exempt")])
    assert actions == {("12", "adopt", 1), ("30", "touch", 4), ("20", "update", 3), ("40", "touch", 5), ("50", "insert", None), ("51", "join", None)}
    assert nxt == [(1, "12", "t", True), (3, "20", "u", True), (4, "30", "t", True), (5, "40", "t", True), (99, "51", "first", True)]
    assert kept == 1


def test_empty_sides(spark):
    assert cycle(spark, [(1, "1", "a", "pub", False, "d", "t")], [])[1] == [(1, "1", "t", False)]
    assert cycle(spark, [], [("1", "a", "d", "t")])[1] == [(99, "1", "t", True)]
