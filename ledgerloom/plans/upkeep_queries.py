"""Queries of the feed upkeep operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import feed as fd
from ..operators import upkeep as up
from .queries import ANALYZED, DECISIONS_SQL, DOWNLOADED, FEED_SQL, NOW, OVERLAY_SQL, PUBLISHED, SNAPSHOTS_SQL, _part_fields, _word, c, decisions, feed, now, query, snapshots, table

ARCHIVED, DISCARDED = "archivada", "descartada"


@query("F09_removable_duplicate", OVERLAY_SQL + f" SELECT id FROM feed WHERE status = '{PUBLISHED}' AND promoted_at IS NULL AND NOT (id % 3 = 0) AND NOT (id % 5 = 0) AND id NOT IN (SELECT id FROM rejected)")
def f09(spark, sf_dir):
    items = fd.with_overlay(feed(spark, sf_dir), decisions(spark, sf_dir), "t1")
    marked = items.withColumns({"has_data": c("id") % 3 == 0, "has_analysis": F.when(c("id") % 5 == 0, True)})
    return marked.filter(up.removable_duplicate(PUBLISHED)).select("id")


@query("F10_should_be_promoted", f"WITH {FEED_SQL} SELECT id, status IN ('{ANALYZED}', '{DOWNLOADED}') OR id % 4 = 0 OR id % 7 = 0 AS due FROM feed")
def f10(spark, sf_dir):
    items = feed(spark, sf_dir).withColumns({"interest": F.when(c("id") % 4 == 0, "starred").when(c("id") % 4 == 1, "none"), "has_data": c("id") % 7 == 0, "has_analysis": F.lit(None).cast("boolean")})
    return items.select("id", up.should_be_promoted([ANALYZED, DOWNLOADED]).alias("due"))


@query("F11_empty_snapshot_guard", "SELECT l_orderkey, bool_or(l_returnflag = 'N') AND NOT bool_or(l_linenumber > 2) AS quarantined FROM lineitem GROUP BY l_orderkey")
def f11(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    old = lines.agg(F.collect_list(F.when(c("l_returnflag") == "N", c("l_linenumber"))).alias("stages"), F.array().cast("array<int>").alias("files"))
    new = lines.agg(F.array().cast("array<int>").alias("stages"), F.collect_list(F.when(c("l_linenumber") > 2, c("l_linenumber"))).alias("files"))
    return up.empty_snapshot_guard(old, new, "l_orderkey", ["stages", "files"]).select("l_orderkey", "quarantined")


@query("J09_merge_stored", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN p_name || '.pdf' END AS file, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN p_type ELSE p_brand END AS title FROM part")
def j09(spark, sf_dir):
    k, p = c("p_partkey"), table(spark, sf_dir, "part")
    new = p.select("p_partkey", F.lit(None).cast("string").alias("file"), c("p_brand").alias("title"))
    stored = p.filter(k % 2 == 0).select("p_partkey", F.when(k % 3 == 0, " ").otherwise(F.concat("p_name", F.lit(".pdf"))).alias("file"), F.when(k % 5 == 0, "(12 KB)").otherwise(c("p_type")).alias("title"))
    return up.merge_stored(new, stored, "p_partkey")


@query("J11_profile_for_source", "SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'open' WHEN source IN ('src1', 'src2') THEN 'technical' ELSE 'default' END AS profile FROM documents")
def j11(spark, sf_dir):
    return up.profile_for_source(table(spark, sf_dir, "documents"), [("open", ["SRC0", "src1"]), ("technical", ["src1", "src2"])], "source", "default").select("doc_id", "profile")


@query("G03_bucket_counts", f"WITH {FEED_SQL} SELECT c_custkey AS entity_id, count(*) FILTER (WHERE status = '{PUBLISHED}') AS published, count(*) FILTER (WHERE status = '{DOWNLOADED}') AS downloaded, count(*) FILTER (WHERE status = '{ANALYZED}') AS analyzed FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') LEFT JOIN feed ON entity_id = c_custkey GROUP BY c_custkey")
def g03(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("entity_id"))
    return up.bucket_counts(feed(spark, sf_dir), ids, {"published": [PUBLISHED], "downloaded": [DOWNLOADED], "analyzed": [ANALYZED]})


@query("G17_sync_report", f"WITH {SNAPSHOTS_SQL} SELECT CASE WHEN new.user_id IS NULL THEN 'keep' WHEN old.user_id IS NULL THEN 'insert' WHEN old.value IS DISTINCT FROM new.value THEN 'update' ELSE 'touch' END AS action, count(*) AS n FROM old FULL JOIN new USING (user_id, event_type) GROUP BY 1")
def g17(spark, sf_dir):
    old, new = (s.withColumn("digest", F.sha2(c("value").cast("string"), 256)) for s in snapshots(spark, sf_dir))
    return up.action_counts(fd.upsert_feed(old, new, ["user_id", "event_type"], "digest", ["value"], [F.asc("value")])[1])


@query("G18_list_max_rank", "SELECT l_orderkey, max(CASE WHEN l_returnflag <> 'N' THEN l_linenumber ELSE 0 END) AS max_rank FROM lineitem GROUP BY l_orderkey")
def g18(spark, sf_dir):
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(c("l_returnflag") != "N", c("l_linenumber")).alias("rank"))
    return up.max_rank(ranked, ["l_orderkey"], "rank")


@query("W03_first_in_listing", """WITH p AS (SELECT l_suppkey, l_partkey, l_orderkey * 10 + l_linenumber AS place, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, l_partkey) - 1) // 20 AS page FROM lineitem)
  SELECT l_suppkey, min(place) AS place FROM p WHERE page < 200 GROUP BY l_suppkey""")
def w03(spark, sf_dir):
    place = c("l_orderkey") * 10 + c("l_linenumber")
    nth = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(place, "l_partkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor((nth - 1) / 20).alias("page"), place.alias("place"))  # a page of 20 lines of its supplier
    return up.first_in_listing(rows, ["l_suppkey"], "page", "place").select("l_suppkey", "place")


@query("W07_backfill_rank", """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS INTEGER) AS old, l_extendedprice AS p FROM lineitem),
  n AS (SELECT *, CASE WHEN bool_or(old IS NULL) OVER (PARTITION BY l_orderkey) THEN CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY old NULLS LAST, p, l_linenumber) AS INTEGER) ELSE old END AS new_rank FROM r) SELECT l_orderkey, l_linenumber, new_rank, new_rank IS DISTINCT FROM old AS changed FROM n""")
def w07(spark, sf_dir):
    ranked = table(spark, sf_dir, "lineitem").withColumn("rank", F.when(c("l_returnflag") != "N", c("l_linenumber")))
    return up.backfill_rank(ranked, ["l_orderkey"], "rank", [F.asc("l_extendedprice"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "new_rank", "changed")


@query("W17_default_choice", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) = 1 AS chosen FROM lineitem")
def w17(spark, sf_dir):
    return up.default_choice(table(spark, sf_dir, "lineitem"), "l_orderkey", [F.desc("l_quantity"), F.asc("l_linenumber")]).select("l_orderkey", "l_linenumber", "chosen")


@query("W18_cap_history", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, event_id FROM r WHERE n <= 100")
def w18(spark, sf_dir):
    return up.cap_history(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@query("W19_version_history", "SELECT o_custkey, o_orderkey, lead(o_orderdate) OVER w AS valid_to, lead(1) OVER w IS NULL AS is_current FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w19(spark, sf_dir):
    return up.version_history(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "valid_to", "is_current")


@query("S04_sort_rank", "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 99 END AS INTEGER) AS place FROM orders")
def s04(spark, sf_dir):
    place = up.sort_rank(c("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2})
    return table(spark, sf_dir, "orders").select("o_orderkey", place.alias("place")).sort("place", "o_orderkey")


@query("S05_best_candidate", "WITH f AS (SELECT p_type, p_name, CASE WHEN p_size % 3 = 0 THEN -1 ELSE p_size END AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score < 0, score DESC, lower(p_name), p_name) AS k, count_if(score >= 0) OVER (PARTITION BY p_type) AS n FROM f) SELECT p_type, CASE WHEN n > 0 THEN p_name END AS best, CAST(n AS BIGINT) AS n FROM r WHERE k = 1")
def s05(spark, sf_dir):
    files = table(spark, sf_dir, "part").withColumn("score", F.when(c("p_size") % 3 == 0, -1).otherwise(c("p_size")))
    return up.best_candidate(files, "p_type", "score", "p_name")


@query("S06_discarded_listing", OVERLAY_SQL + f" SELECT id, CASE WHEN status = '{DOWNLOADED}' THEN status ELSE 'autorejected' END AS branch FROM feed WHERE status = '{DOWNLOADED}' OR id IN (SELECT id FROM rejected)")
def s06(spark, sf_dir):
    items = feed(spark, sf_dir)
    found = up.discarded_listing(items, fd.effective_rejected(items, decisions(spark, sf_dir), "t1"), DOWNLOADED)
    return found.sort(F.desc("first_seen"), F.desc("id")).select("id", "branch")


@query("U02_unknown_members", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def u02(spark, sf_dir):
    known = table(spark, sf_dir, "part").filter("p_size > 10").select(c("p_partkey").alias("l_partkey"))
    return up.unknown_members(table(spark, sf_dir, "lineitem"), known, "l_partkey")


@query("U03_completeness", "WITH e AS (SELECT p_partkey AS id FROM part WHERE p_size > 10), a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45) SELECT 'missing' AS kind, 'critical' AS severity, id FROM e WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'extra', 'minor', id FROM a WHERE id NOT IN (SELECT id FROM e)")
def u03(spark, sf_dir):
    expected = table(spark, sf_dir, "part").filter("p_size > 10").select(c("p_partkey").alias("id"))
    return up.completeness(expected, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(c("l_partkey").alias("id")), "id")


@query("U04_added_ids", "WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (l_linenumber < 3) AS o, list(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey, list_sort(list_filter(n, lambda v: NOT list_contains(coalesce(o, []), v))) AS a FROM s) SELECT l_orderkey, array_to_string(a, ',') AS added FROM x")
def u04(spark, sf_dir):
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(c("l_linenumber") < 3, c("l_partkey"))).alias("o"), F.collect_set("l_partkey").alias("n"))
    return sets.select("l_orderkey", F.array_join(up.added_ids("o", "n"), ",").alias("added"))


@query("U05_union_sources", "SELECT 'customers' AS source, 'customers:' || c_custkey AS feed_key, c_mktsegment AS segment FROM customer UNION ALL SELECT 'suppliers', 'suppliers:' || s_suppkey, NULL FROM supplier")
def u05(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("segment"))
    return up.union_sources({"customers": customers, "suppliers": table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("id"))}, "id").select("source", "feed_key", "segment")


@query("U06_ranges_covered", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'N' AND r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber)")
def u06(spark, sf_dir):
    plan = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return up.ranges_covered(plan, plan.filter("l_returnflag = 'N'"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("U07_keys_agree", f"WITH {SNAPSHOTS_SQL} SELECT user_id, bool_and(o IS NOT NULL AND n IS NOT NULL) AS same FROM (SELECT user_id, old.user_id AS o, new.user_id AS n FROM old FULL JOIN new USING (user_id, event_type)) GROUP BY user_id")
def u07(spark, sf_dir):
    return up.keys_agree(*snapshots(spark, sf_dir), "user_id", "event_type")


DOCS_SQL = """a AS (SELECT l_orderkey AS item, l_linenumber AS uuid, l_returnflag AS stage, l_shipdate AS day FROM lineitem WHERE l_linenumber < 6),
  b AS (SELECT l_orderkey AS item, l_linenumber AS uuid, CASE WHEN l_quantity > 48 THEN 'X' ELSE l_returnflag END AS stage, CASE WHEN l_quantity < 3 THEN NULL WHEN l_quantity < 5 THEN l_shipdate + INTERVAL 1 DAY ELSE l_shipdate END AS day FROM lineitem WHERE l_linenumber < 7)"""


def _documents(spark, sf_dir):
    l, q = table(spark, sf_dir, "lineitem"), c("l_quantity")
    key = [c("l_orderkey").alias("item"), c("l_linenumber").cast("string").alias("uuid")]
    day = lambda d: d.cast("string").alias("day")
    old = l.filter("l_linenumber < 6").select(*key, c("l_returnflag").alias("stage"), day(c("l_shipdate")))
    moved = F.when(q < 3, None).when(q < 5, c("l_shipdate") + F.expr("INTERVAL 1 DAY")).otherwise(c("l_shipdate"))
    return old, l.filter("l_linenumber < 7").select(*key, F.when(q > 48, "X").otherwise(F.concat(F.lit(" "), "l_returnflag")).alias("stage"), day(moved))


@query("C02_documents_equal", f"WITH {DOCS_SQL} SELECT item, bool_and(a.uuid IS NOT NULL AND b.uuid IS NOT NULL AND a.stage = b.stage AND (b.day IS NULL OR a.day = b.day)) AS docs_equal FROM a FULL JOIN b USING (item, uuid) GROUP BY item")
def c02(spark, sf_dir):
    return up.documents_equal(*_documents(spark, sf_dir), "item", "uuid", ["stage"], "day")


@query("C03_schedule_equal", f"WITH {DOCS_SQL} SELECT item, bool_and(a.stage IS NOT DISTINCT FROM b.stage AND a.day IS NOT DISTINCT FROM b.day) AS schedule_equal FROM a FULL JOIN b USING (item, uuid) GROUP BY item")
def c03(spark, sf_dir):
    return up.schedule_equal(*_documents(spark, sf_dir), "item", "uuid", ["stage", "day"])


@query("C04_content_changed", f"WITH {DOCS_SQL} SELECT item, NOT bool_and(a.stage IS NOT DISTINCT FROM b.stage AND a.day IS NOT DISTINCT FROM b.day) AS schedule_changed, NOT bool_and(a.uuid IS NOT NULL AND b.uuid IS NOT NULL AND a.stage = b.stage AND (b.day IS NULL OR a.day = b.day)) AS docs_changed FROM a FULL JOIN b USING (item, uuid) GROUP BY item")
def c04(spark, sf_dir):
    pair = _documents(spark, sf_dir)
    both = up.schedule_equal(*pair, "item", "uuid", ["stage", "day"]).join(up.documents_equal(*pair, "item", "uuid", ["stage"], "day"), "item", "full_outer")
    return both.select("item", (~up.flag("schedule_equal")).alias("schedule_changed"), (~up.flag("docs_equal")).alias("docs_changed"))


@query("C06_schedule_view", f"""WITH {SNAPSHOTS_SQL}, d AS (SELECT user_id, event_type, old.value AS o, new.value AS n, old.user_id AS a, new.user_id AS b, user_id IN (SELECT user_id FROM old) AS t FROM old FULL JOIN new USING (user_id, event_type))
  SELECT user_id, event_type, n AS value, CASE WHEN a IS NOT NULL AND (b IS NULL OR o IS DISTINCT FROM n) THEN o END AS value_prev, a IS NULL AND t AS is_new, b IS NULL AS is_removed, b IS NULL OR (a IS NULL AND t) OR (a IS NOT NULL AND o IS DISTINCT FROM n) AS changed FROM d""")
def c06(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return up.schedule_view(new, old, "user_id", "event_type", ["value"])


@query("C07_change_label", "SELECT user_id, CASE WHEN bool_and(event_type IN ('click', 'view')) AND max(d) IS NOT NULL THEN max(d) ELSE max(ts) END AS label FROM (SELECT user_id % 50 + 100 * (event_id % 40) AS user_id, event_type, ts, CASE WHEN event_id % 3 > 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS d FROM events) GROUP BY user_id")
def c07(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    changes = e.select((c("user_id") % 50 + 100 * (c("event_id") % 40)).alias("user_id"), F.lit("documento").alias("area"), F.when(c("event_type").isin("click", "view"), "added").otherwise("modified").alias("kind"), F.when(c("event_id") % 3 > 0, F.to_date("ts").cast("timestamp")).alias("doc_date"), c("ts").alias("at"))
    return up.change_label(changes, "user_id")


@query("M02_adopt_republication", f"""WITH {FEED_SQL}, cl AS (SELECT id, CAST(id AS VARCHAR) AS ref, id + 3 AS new_ref FROM feed WHERE status = '{ANALYZED}'), t AS (SELECT cl.id, ref, new_ref, f.id AS twin, f.status = '{PUBLISHED}' AND f.promoted_at IS NULL AS free FROM cl LEFT JOIN feed f ON f.id = new_ref)
  SELECT id, CAST(CASE WHEN twin IS NULL OR free THEN new_ref ELSE id END AS VARCHAR) AS source_ref, coalesce(twin IS NULL OR free, FALSE) AS adopted FROM t""")
def m02(spark, sf_dir):
    items = feed(spark, sf_dir).withColumns({"source_ref": c("id").cast("string"), "has_data": F.lit(False), "has_analysis": F.lit(False), "rejected": F.lit(False)})
    claimed = items.filter(c("status") == ANALYZED)
    sights = claimed.select("id", F.explode(F.array((c("id") + 3).cast("string"), (c("id") + 1).cast("string"))).alias("new_ref"))
    return up.adopt_republication(claimed, sights, items, decisions(spark, sf_dir), PUBLISHED)[0].select("id", "source_ref", "adopted")


@query("M05_snapshot_pipeline", f"WITH {FEED_SQL}, p AS (SELECT id, amount - 1 AS amount FROM feed WHERE status = '{ANALYZED}' AND id % 2 = 0), n AS (SELECT id, amount FROM feed WHERE promoted_at IS NOT NULL) SELECT id AS origin_feed_id, coalesce(p.amount, n.amount) AS amount, CASE WHEN p.id IS NULL THEN 'insert' ELSE 'keep' END AS action FROM p FULL JOIN n USING (id)")
def m05(spark, sf_dir):
    items = feed(spark, sf_dir)
    stored = items.filter((c("status") == ANALYZED) & (c("id") % 2 == 0)).select(c("id").alias("origin_feed_id"), (c("amount") - 1).alias("amount"))
    return up.snapshot_pipeline(items, stored, ["amount"], refresh=False)


@query("M07_hash_gate", "SELECT s_suppkey FROM supplier")
def m07(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    known = up.table_digest(s.filter("s_suppkey > 1"), ["s_suppkey", "s_name"]).first()["digest"]
    same = up.hash_gate(s.repartition(3), ["s_suppkey", "s_name"], up.table_digest(s, ["s_suppkey", "s_name"]).first()["digest"])
    return up.hash_gate(s, ["s_suppkey", "s_name"], known).union(same).select("s_suppkey")


@query("M08_removal_policy", f"WITH {FEED_SQL}, x AS (SELECT id, status, entity_id % 3 = 0 AS out, id % 10 = 0 AS busy FROM feed) SELECT id, CASE WHEN out AND NOT busy THEN CASE WHEN status = '{ANALYZED}' THEN '{ARCHIVED}' ELSE '{DISCARDED}' END ELSE status END AS next_status, CASE WHEN NOT out THEN 'kept' WHEN busy THEN 'deferred' ELSE 'affected' END AS outcome FROM x")
def m08(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(c("o_custkey").alias("entity_id")).filter("entity_id % 3 = 0")
    out = up.removal_policy(feed(spark, sf_dir), ids, "discard_all", busy=c("id") % 10 == 0, analyzed=[ANALYZED], downloaded=[DOWNLOADED], published=PUBLISHED, discarded=DISCARDED, archived=ARCHIVED)
    return out.select("id", "next_status", "outcome")


@query("M10_backfill_overlay", f"WITH {DECISIONS_SQL}, x AS (SELECT o_orderkey AS id, o_orderkey % 4 = 0 AS e, o_orderstatus = 'F' AS r, o_orderpriority || ': ' || o_orderstatus AS reason FROM orders) SELECT 't1' AS tenant_id, id AS feed_item_id, CASE WHEN e THEN 'exempt' ELSE 'autorejected' END AS decision, CASE WHEN NOT e THEN split_part(reason, ':', 1) END AS rule_id, CASE WHEN NOT e THEN reason END AS reason FROM x WHERE (e OR r) AND id NOT IN (SELECT feed_item_id FROM decisions)")
def m10(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    items = o.select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") == "F", fd.REJECTED).otherwise(PUBLISHED).alias("status"), (c("o_orderkey") % 4 == 0).alias("exempt"), F.concat_ws(": ", "o_orderpriority", "o_orderstatus").alias("reason"))
    return up.backfill_overlay(items, decisions(spark, sf_dir), "t1")


@query("M12_repair_missing", f"WITH {FEED_SQL}, x AS (SELECT id, status, id % 3 = 0 AS s, id % 5 = 0 AS d FROM feed) SELECT id, CASE WHEN NOT s AND status = '{DOWNLOADED}' THEN '{PUBLISHED}' WHEN NOT s AND status = '{ANALYZED}' THEN CASE WHEN d THEN '{DOWNLOADED}' ELSE '{PUBLISHED}' END ELSE status END AS next_status, NOT s AND status IN ('{DOWNLOADED}', '{ANALYZED}') OR status = '{PUBLISHED}' AND s AS cleared FROM x")
def m12(spark, sf_dir):
    items = feed(spark, sf_dir).withColumns({"analysis_done": c("id") % 5 == 0, "has_analysis": F.lit(False)})
    out = up.repair_missing(items, items.filter("id % 3 = 0"), needs_data=[DOWNLOADED], archived=ANALYZED, analyzed=DOWNLOADED, published=PUBLISHED, discarded=PUBLISHED)
    return out.select("id", "next_status", "cleared")


@query("M13_preserve_removed", f"WITH o AS (SELECT user_id AS item, event_id AS uuid, event_id % 3 = 0 AS was, ts AS since, event_id % 5 < 2 AS f FROM events), n AS (SELECT event_id AS uuid FROM events WHERE event_id % 2 = 0) SELECT item, uuid, n.uuid IS NULL AS removed, CASE WHEN n.uuid IS NULL THEN CASE WHEN was THEN since ELSE TIMESTAMP '{NOW}' END END AS removed_at, NOT was AS compared FROM o LEFT JOIN n USING (uuid) WHERE n.uuid IS NOT NULL OR was OR f")
def m13(spark, sf_dir):
    k = c("event_id")
    e = table(spark, sf_dir, "events").select(c("user_id").alias("item"), k.alias("uuid"), (k % 3 == 0).alias("removed"), c("ts").alias("removed_at"), (k % 5 < 2).alias("has_file"))
    return up.preserve_removed(e, e.filter("uuid % 2 = 0"), "item", "uuid", now())


@query("M14_retention_split", f"WITH {FEED_SQL} SELECT id, promoted_at IS NULL AND first_seen < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AS purge FROM feed")
def m14(spark, sf_dir):
    return up.retention_split(feed(spark, sf_dir).withColumnRenamed("first_seen", "last_seen"), F.lit("1998-01-01").cast("timestamp")).select("id", "purge")


@query("M15_mark_unread", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND (o_orderkey % 2 = 1 OR o_orderkey % 3 = 0) THEN o_orderpriority WHEN o_orderkey % 3 > 0 THEN 'older' END AS prev, o_orderkey % 2 = 0 OR o_orderstatus = 'F' AS unread FROM orders")
def m15(spark, sf_dir):
    k = c("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumns({"unread": k % 2 == 0, "prev": F.when(k % 3 > 0, "older")})
    return up.mark_unread(rows, c("o_orderstatus") == "F", "o_orderpriority", "prev").select("o_orderkey", "prev", "unread")


@query("M16_orphan_paths", f"WITH {FEED_SQL} SELECT 'p' || p_partkey AS path FROM part WHERE 'p' || p_partkey NOT IN (SELECT 'p' || id FROM feed WHERE status IN ('{ANALYZED}', '{DOWNLOADED}'))")
def m16(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("path"))
    return up.orphan_paths(files, feed(spark, sf_dir).withColumn("path", F.concat(F.lit("p"), "id")), "path", [ANALYZED, DOWNLOADED])


@query("X02_apply_rules", f"SELECT p_partkey AS feed_item_id, CASE WHEN {_word('p_type', 'promo')} THEN 'r1' ELSE 'r2' END AS rule_id FROM part WHERE p_size % 2 = 0 AND ({_word('p_type', 'promo')} OR {_word('p_name', 'steel')})")
def x02(spark, sf_dir):
    found = rules.first_matching_rule([("r1", "descripcion:promo"), ("r2", "objeto:steel")], _part_fields(), ["objeto", "descripcion"])
    items = table(spark, sf_dir, "part").withColumns({"id": c("p_partkey"), "source": F.when(c("p_size") % 2 == 0, "even").otherwise("odd")})
    return up.apply_rules(items, found, ["even"])
