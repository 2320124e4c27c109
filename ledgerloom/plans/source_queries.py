"""Queries of sources and sinks, streams and the refresh cycle, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as cp
from ..operators.ranking import shared_folder
from ..operators.refresh import Refreshed, refresh_changes
from ..operators.scan import scan_actions, scan_cycle
from ..sources import layouts as ly
from ..sources import readers as rd
from ..sources import versions as vs
from ..streaming import jobs
from ..streaming import keyed as ky
from ..streaming import streams as st
from .queries import ANALYZED, NOW, PUBLISHED, c, now, query, scalar, table



def _catalog_bytes():
    kind, name = c("p_partkey") % 4, F.encode("p_name", "UTF-8")
    raw = lambda digits: F.concat(F.unhex(F.lit(digits)), name)
    return F.when(kind == 0, raw("EFBBBF")).when(kind == 1, F.encode(F.concat(F.lit("ñ € "), "p_name"), "UTF-8")).when(kind == 2, raw("F120")).otherwise(raw("803520937894208A20"))


scalar(
    "A02_decode_bytes", "part", "p_partkey", lambda: rd.decode_bytes(_catalog_bytes()),
    "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'ñ € ' || p_name WHEN 2 THEN 'ñ ' || p_name ELSE '€5 “x” Š ' || p_name END",
)
scalar("A04_extract_total_pages", "pages", "page_id", lambda: rd.extract_total_pages(F.concat(F.when(c("page_id") % 3 == 0, F.concat(F.lit("totalPages: "), (c("page_id") % 50).cast("string"), F.lit(","))).when(c("page_id") % 3 == 1, F.concat(F.lit("Página: 1/"), (c("page_id") % 70).cast("string"), F.lit(" "))).otherwise(""), F.coalesce("html", F.lit("")))), "CAST(CASE page_id % 3 WHEN 0 THEN page_id % 50 WHEN 1 THEN page_id % 70 ELSE 1 END AS INTEGER)")


@query("E31_valid_bbox", "SELECT l_orderkey, l_linenumber, l_linenumber > 1 AND l_linenumber < 9 AND l_quantity > 16 AND l_quantity <= 64 AND (l_linenumber - 1) * (l_quantity - 16) <= 358.4 AS out FROM lineitem")
def e31(spark, sf_dir):
    box = F.array(F.lit(0.125), F.lit(0.25), c("l_linenumber") / F.lit(8.0), c("l_quantity").cast("double") / F.lit(64.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.valid_bbox(box).alias("out"))


@query("A11_rescue_json_objects", """WITH e AS (SELECT *, props LIKE '{%' AS own FROM events) SELECT event_id, CAST(0 AS INTEGER) AS place, props AS object FROM e WHERE own
  UNION ALL SELECT event_id, CAST(CASE WHEN own THEN 1 ELSE 0 END AS INTEGER), '{"a": {"b": ' || user_id || '}}' FROM e""")
def a11(spark, sf_dir):
    cut = F.concat(F.lit("["), F.coalesce("props", F.lit("")), F.lit(', {"a": {"b": '), c("user_id").cast("string"), F.lit('}}, {"k": '))
    return cp.rescue_json_objects(table(spark, sf_dir, "events").select("event_id", cut.alias("body")), "event_id", "body")


@query("A13_write_consolidated", "SELECT p_partkey, p_name, CAST(p_size AS INTEGER) AS p_size FROM part")
def a13(spark, sf_dir):
    path = shared_folder(spark, "consolidated")
    rd.write_consolidated(table(spark, sf_dir, "part"), path, ["p_partkey", "p_name", "p_size"])
    return spark.read.schema("p_partkey long, p_name string, p_size int").option("sep", "\t").option("header", True).csv(f"{path}/tsv")


@query("A14_snapshots", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def a14(spark, sf_dir):
    path, o = shared_folder(spark, "snapshots"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    rd.write_snapshot(o, path, 0)
    rd.write_snapshot(rd.read_snapshot(spark, path, 0).filter("o_orderkey % 2 = 0"), path, 1)
    return rd.read_snapshot(spark, path, 1)


@query("A14_latest_pointer", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def a14_latest(spark, sf_dir):
    path, o = shared_folder(spark, "versions"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for part in (o, o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0")):
        vs.publish(part, path, keep=2)
    return vs.read_latest(spark, path)


@query("B06_qa_verdict", "SELECT CASE WHEN count_if(p_size > 49) > 0 THEN 'NO_OK' WHEN count(*) > 0 THEN 'OK_CON_OBSERVACIONES' ELSE 'OK' END AS verdict FROM part")
def b06(spark, sf_dir):
    findings = table(spark, sf_dir, "part").select(F.when(c("p_size") > 49, "CRITICO").otherwise("MENOR").alias("severity"))
    return cp.qa_verdict(findings)


@query("X01_sources", "SELECT 'orders' AS source, o_orderkey AS id, o_orderpriority AS title FROM orders UNION ALL SELECT 'parts', p_partkey, p_name FROM part")
def x01(spark, sf_dir):
    mapped = lambda key, title: lambda df: df.select(c(key).alias("id"), c(title).alias("title"))
    rd.register_source(rd.Source("orders", lambda s: table(s, sf_dir, "orders"), mapped("o_orderkey", "o_orderpriority"), 1))
    rd.register_source(rd.Source("parts", lambda s: table(s, sf_dir, "part"), mapped("p_partkey", "p_name"), 2))
    return rd.union_sources(spark, ["parts", "orders"]).select("source", "id", "title")


def _stream(spark: SparkSession, sf_dir: str, apply: Callable[[str], st.Batch]) -> str:
    """Run ``apply(folder)`` over the events table's files as a stream, to the end; the folder it wrote to."""
    path, like = shared_folder(spark, "stream"), table(spark, sf_dir, "events")
    stream = spark.readStream.schema(like.schema).parquet(f"{sf_dir}/events.parquet*").withColumn("digest", F.sha2(c("value").cast("string"), 256))
    st.stream_upsert(stream, apply(path), f"{path}/checkpoint").awaitTermination()
    return path


@query("T01_stream_upsert", "SELECT user_id, event_type, max_by(value, ts) AS value FROM events GROUP BY ALL")
def t01(spark, sf_dir):
    path = _stream(spark, sf_dir, lambda p: st.upsert_table(f"{p}/feed", ["user_id", "event_type"], "digest", ["value"], [F.desc("ts")]))
    like = table(spark, sf_dir, "events").select("user_id", "event_type", F.lit("").alias("digest"), "value")
    return st.read_table(like, f"{path}/feed", 0).select("user_id", "event_type", "value")  # the files of one run are one batch


@query("T02_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def t02(spark, sf_dir):
    path, like = shared_folder(spark, "stream"), table(spark, sf_dir, "events")
    stream = spark.readStream.schema(like.schema).parquet(f"{sf_dir}/events.parquet*")
    first = st.stream_dedupe(stream, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type")
    first.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{path}/out")


CHANGES = """WITH r AS (SELECT user_id, event_type, ts, min(value) AS new FROM events GROUP BY ALL),
  l AS (SELECT *, lag(new) OVER w AS old, row_number() OVER w = 1 AS first FROM r WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts))
  SELECT user_id, event_type, ts, CASE WHEN first THEN 'added' ELSE 'modified' END AS kind, old, new FROM l WHERE first OR old IS DISTINCT FROM new"""
DUE = """WITH n AS (SELECT date_trunc('second', max(ts)) AS now FROM events), i AS (SELECT user_id, date_trunc('second', max(ts)) AS checked FROM events GROUP BY user_id)
  SELECT user_id FROM i, n WHERE epoch(checked) < epoch(now) - CASE WHEN abs(epoch(checked) + 86400 - epoch(now)) <= 172800 THEN 2700 ELSE 10800 END"""


def _to_files(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream to its end into files in append mode."""
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table's files as a stream."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")


@query("T04_change_table", CHANGES)
def t04_table(spark, sf_dir):
    path = _stream(spark, sf_dir, lambda p: st.change_table(p, ["user_id", "event_type"], "value", "ts"))
    return rd.read_snapshot(spark, f"{path}/changes", 0)


@query("T04_stream_changes", CHANGES.replace("min(value)", "CAST(min(CAST(value AS VARCHAR)) AS DOUBLE)"))
def t04(spark, sf_dir):
    return _to_files(ky.stream_changes(_events(spark, sf_dir), ["user_id", "event_type"], "value", "ts"), shared_folder(spark, "stream"))


@query("T05_due_table", DUE)
def t05_table(spark, sf_dir):
    def items() -> DataFrame:
        return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("checked")).withColumn("deadline", c("checked") + F.expr("INTERVAL 1 DAY"))

    path = _stream(spark, sf_dir, lambda p: st.due_table(f"{p}/due", items, "ts", "checked", "deadline"))
    return rd.read_snapshot(spark, f"{path}/due", 0).select("user_id")


@query("T05_stream_due", """WITH n AS (SELECT epoch_us(max(ts)) // 1000 AS now FROM events), i AS (SELECT user_id, epoch_us(max(ts)) // 1000 AS checked FROM events GROUP BY user_id)
  SELECT user_id, make_timestamp(1000 * (checked + 2700000)) AS due_at FROM i, n WHERE checked + 2700000 <= now""")
def t05(spark, sf_dir):
    timed = _events(spark, sf_dir).withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
    items = timed.withColumns({"checked": c("ts"), "deadline": c("ts") + F.expr("INTERVAL 1 DAY")}).select("user_id", "ts", "checked", "deadline")
    return _to_files(ky.stream_due(items, ["user_id"], "checked", "deadline", watermark="ts"), shared_folder(spark, "stream"))


@query("T06_daily_counts", """SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events
  WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) GROUP BY 1, 2""")
def t06_daily(spark, sf_dir):
    return _to_files(ky.daily_counts(_events(spark, sf_dir), "ts", ["event_type"], "0 seconds"), shared_folder(spark, "stream"))


@query("T01_run_sources", "SELECT event_type, user_id, max_by(value, ts) AS value FROM events GROUP BY ALL")
def t01_sources(spark, sf_dir):
    """A streaming query for each kind of event, each into its own table."""
    path, like = shared_folder(spark, "stream"), table(spark, sf_dir, "events").select("user_id", F.lit("").alias("digest"), "value")
    kinds = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    events = _events(spark, sf_dir).withColumn("digest", F.sha2(c("value").cast("string"), 256))
    apply = lambda name: st.upsert_table(f"{path}/{name}", ["user_id"], "digest", ["value"], [F.desc("ts")])
    jobs.run_sources(spark, {k: events.filter(c("event_type") == k) for k in kinds}, apply, f"{path}/checkpoint")
    out = None
    for k in kinds:
        own = st.read_table(like, f"{path}/{k}", 0).select(F.lit(k).alias("event_type"), "user_id", "value")
        out = own if out is None else out.unionByName(own)
    return out


def _refreshed(spark: SparkSession, sf_dir: str) -> Refreshed:
    """Orders as watched items, their lines as documents; three of four are due, two of three have fresh rows, one of five is emptied."""
    k, hours = c("id"), lambda n: now() - F.expr(f"INTERVAL {n} HOURS")
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"))
    checked = F.when(k % 4 == 0, F.lit(None).cast("timestamp")).when(k % 4 < 3, hours(1)).otherwise(hours(4))
    items = o.withColumns({"stages": F.array(F.lit(1)), "previous_status": F.lit(None).cast("string"), "unread": F.lit(False), "checked": checked, "deadline": F.when(k % 4 == 2, hours(-24))})
    fresh = o.filter(k % 3 != 0).withColumns({"status": F.when(k % 2 == 0, "X").otherwise(c("status")), "stages": F.when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))})
    line = c("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), line.alias("uuid"), F.lit(False).alias("removed"), F.lit(None).cast("timestamp").alias("removed_at"), (line % 2 == 0).alias("has_file"))
    return refresh_changes(items, fresh, lines, lines.filter("uuid % 3 <> 0"), "id", ["status"], ["stages"], "uuid", "checked", "deadline", now())


DISCARDED = "descartada"
TAKEN = "{0} % 4 <> 1 AND {0} % 3 <> 0 AND {0} % 5 <> 0"
_TAKEN = TAKEN.format("o_orderkey")


@query("C08_refresh_items", f"""SELECT o_orderkey AS id, CASE WHEN {_TAKEN} AND o_orderkey % 2 = 0 THEN 'X' ELSE o_orderstatus END AS status,
  CASE WHEN {_TAKEN} AND o_orderkey % 2 = 0 THEN o_orderstatus END AS previous_status, {_TAKEN} AND o_orderkey % 2 = 0 AS unread,
  CASE WHEN o_orderkey % 4 = 1 THEN TIMESTAMP '{NOW}' - INTERVAL 1 HOUR ELSE TIMESTAMP '{NOW}' END AS checked FROM orders""")
def c08_items(spark, sf_dir):
    return _refreshed(spark, sf_dir).items.select("id", "status", "previous_status", "unread", "checked")


@query("C08_refresh_changes", f"SELECT o_orderkey AS id, 'modified' AS kind, 'status' AS field, o_orderstatus AS old, 'X' AS new FROM orders WHERE {_TAKEN} AND o_orderkey % 2 = 0")
def c08_changes(spark, sf_dir):
    return _refreshed(spark, sf_dir).changes


@query("C08_refresh_documents", f"""SELECT l_orderkey AS id, l_linenumber AS uuid, {TAKEN.format('l_orderkey')} AND l_linenumber % 3 = 0 AS removed,
  CASE WHEN {TAKEN.format('l_orderkey')} AND l_linenumber % 3 = 0 THEN TIMESTAMP '{NOW}' END AS removed_at
  FROM lineitem WHERE NOT ({TAKEN.format('l_orderkey')} AND l_linenumber % 3 = 0 AND l_linenumber % 2 = 1)""")
def c08_documents(spark, sf_dir):
    return _refreshed(spark, sf_dir).documents


@query("A05_extract_schedule", """SELECT page_id, CAST(n AS INTEGER) AS place, CASE n WHEN 0 THEN 'Bases' || page_id ELSE 'Registro' END AS stage, '0' || (page_id % 9 + 1) || '/02/2024' AS starts, 'fin' AS ends
  FROM pages, (VALUES (0), (1)) v(n) WHERE n = 0 OR page_id % 3 > 0""")
def a05(spark, sf_dir):
    row = lambda stage: F.concat(F.lit("<tr><td>"), stage, F.lit("</td><td>0"), (c("page_id") % 9 + 1).cast("string"), F.lit("/02/2024</td><td><b>fin</b></td></tr>"))
    second = F.when(c("page_id") % 3 > 0, row(F.lit("Registro (Electrónica)"))).otherwise("")
    head = F.lit('<table><tr><td><table id="tbFicha:j_idt7"><tr><th>Etapa</th><th>Fecha Inicio</th><th>Fecha Fin</th></tr>')
    body = F.concat(head, row(F.concat(F.lit("Bases A TRAVES DEL SEACE "), c("page_id").cast("string"))), second, F.lit("</table></td></tr></table>"), F.coalesce("html", F.lit("")))
    body = F.replace(body, F.lit("SEACE "), F.lit("SEACE&nbsp;"))
    return ly.extract_schedule(table(spark, sf_dir, "pages").withColumn("html", body), "page_id", "html")


@query("A06_extract_nested_processes", """SELECT page_id, 'P-' || page_id AS code, CASE WHEN page_id % 2 = 0 THEN page_id || '.pdf' END AS file, CASE WHEN page_id % 2 = 0 THEN '01.02.24' END AS valid_from FROM pages""")
def a06(spark, sf_dir):
    k = c("page_id").cast("string")
    doc = F.concat(F.lit('<div class="container-participations-item"><span class="title">T</span><span class="excerpt">Fecha de vigencia: Desde 01.02.24 Hasta 02.03.24</span><a href="getFile_store_competition_download?name_file='), k, F.lit('.pdf">x</a></div>'))
    html = F.concat(F.coalesce("html", F.lit("")), F.lit('<li class="parent-main-competition"><div class="container-title-competition"><span class="title">P-'), k, F.lit("</span></div>"), F.when(c("page_id") % 2 == 0, doc).otherwise(""), F.lit("</li>"))
    return ly.extract_nested_processes(table(spark, sf_dir, "pages").withColumn("html", html), "page_id", "html").select("page_id", "code", "file", "valid_from")


@query("A10_read_bom_variants", "SELECT p_partkey, CAST(0 AS INTEGER) AS place, p_name AS name, CAST(p_size AS VARCHAR) AS size, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'own' END AS grp FROM part")
def a10(spark, sf_dir):
    items = F.array(F.struct(c("p_name").alias("name"), c("p_size").alias("size"), c("p_type").alias("grupo")))
    rescued = F.to_json(F.struct(items.alias("items"), F.array(F.lit("own")).alias("grupos_identificados")))
    files = table(spark, sf_dir, "part").select("p_partkey", F.when(c("p_partkey") % 2 == 0, F.to_json(items)).otherwise('{"items": [{"na').alias("body"), rescued.alias("rescued"))
    return ly.read_bom_variants(files, "p_partkey", "body", "rescued", ["name", "size"]).select("p_partkey", "place", "name", "size", c("groups")[0].alias("grp"))


@query("A12_layout_blocks", """SELECT doc_id, CAST(n AS INTEGER) AS place, CASE n WHEN 0 THEN 'text' ELSE 'table' END AS type, md5(CASE n WHEN 0 THEN coalesce(text, '') ELSE trim(coalesce(lang, '') || ' ' || coalesce(source, '')) END) AS digest
  FROM documents, (VALUES (0), (1)) v(n)""")
def a12(spark, sf_dir):
    text = lambda x: F.struct(F.struct(F.coalesce(x, F.lit("")).alias("text")).alias("textBlock"))
    cell = F.struct(F.array(text(c("lang")), text(c("source"))).alias("blocks"))
    block = F.to_json(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("text")).alias("textBlock")))
    grid = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(cell).alias("cells"))).alias("bodyRows")).alias("tableBlock")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("["), block, F.lit(","), grid, F.lit("]")).alias("body"), F.lit(0).alias("at"))
    got = ly.parse_layout_blocks(docs, "doc_id", "body", "at")
    return got.select("doc_id", "place", "type", F.md5(F.coalesce("text", c("table_rows")[0][0])).alias("digest"))


@query("A12_chunks", "SELECT doc_id, md5(coalesce(text, '')) AS digest, CAST(1 + doc_id % 5 AS INTEGER) AS page_start, contains(coalesce(text, ''), '__START_OF_ANNOTATION__') OR contains(coalesce(text, ''), '**Image Description') AS image FROM documents")
def a12_chunks(spark, sf_dir):
    chunk = F.to_json(F.array(F.struct(F.coalesce("text", F.lit("")).alias("content"), F.struct(F.lit(1).alias("pageStart")).alias("pageSpan"))))
    got = ly.parse_chunks(table(spark, sf_dir, "documents").select("doc_id", chunk.alias("body"), (c("doc_id") % 5).cast("int").alias("at")), "doc_id", "body", "at")
    return got.select("doc_id", F.md5("content").alias("digest"), "page_start", c("is_image_annotation").alias("image"))


def _scan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as the feed (without those of 7) and all of them listed again, one of three under a higher reference."""
    k = c("o_orderkey")
    o = table(spark, sf_dir, "orders")
    feed_ = o.filter(k % 7 != 0).select(
        k.alias("id"), k.cast("string").alias("source_ref"), F.concat(F.lit("key "), k.cast("string")).alias("key"), F.when(k % 5 == 0, DISCARDED).when(k % 2 == 0, ANALYZED).otherwise(PUBLISHED).alias("status"),
        (k % 2 == 0).alias("claimed"), F.md5("o_orderpriority").alias("digest"), c("o_orderpriority").alias("title"), F.lit("2024-01-01").cast("timestamp").alias("last_seen"), F.lit(None).cast("timestamp").alias("promoted_at"),
        F.lit(False).alias("has_data"), F.lit(False).alias("has_analysis"), F.lit(False).alias("rejected"),
    )
    title = F.when(k % 11 == 0, "changed").otherwise(c("o_orderpriority"))
    listed = o.select(F.when(k % 3 == 0, k + 100_000_000).otherwise(k).cast("string").alias("source_ref"), F.concat(F.lit(" KEY  "), k.cast("string")).alias("key"), F.md5(title).alias("digest"), title.alias("title"))
    return feed_, scan_actions(feed_, listed, [F.asc("source_ref")], PUBLISHED, [DISCARDED], c("id") % 13 == 0)


SCAN_SQL = f"""o AS (SELECT o_orderkey AS k, o_orderpriority AS p, CASE WHEN o_orderkey % 5 = 0 THEN '{DISCARDED}' WHEN o_orderkey % 2 = 0 THEN '{ANALYZED}' ELSE '{PUBLISHED}' END AS status, o_orderkey % 7 = 0 AS new, o_orderkey % 3 = 0 AS moved FROM orders),
  a AS (SELECT *, CASE WHEN new THEN 'insert' WHEN moved AND (k % 2 = 0 OR status = '{PUBLISHED}') THEN 'adopt' WHEN moved THEN 'insert' WHEN status = '{DISCARDED}' THEN 'touch' WHEN k % 11 = 0 THEN 'update' WHEN k % 13 = 0 THEN 'refresh' ELSE 'touch' END AS action FROM o)"""


@query("M01_scan_actions", f"WITH {SCAN_SQL} SELECT CAST(CASE WHEN moved THEN k + 100000000 ELSE k END AS VARCHAR) AS source_ref, action, CASE WHEN action <> 'insert' THEN k END AS target FROM a")
def m01_actions(spark, sf_dir):
    return _scan(spark, sf_dir)[1].select("source_ref", "action", "target")


@query("M01_scan_cycle", f"""WITH {SCAN_SQL} SELECT CAST(CASE WHEN action = 'adopt' THEN k + 100000000 ELSE k END AS VARCHAR) AS source_ref, CASE WHEN action = 'update' THEN 'changed' ELSE p END AS title, status, NOT (moved AND action = 'insert') AS seen FROM a WHERE NOT new
  UNION ALL SELECT CAST(CASE WHEN moved THEN k + 100000000 ELSE k END AS VARCHAR), CASE WHEN k % 11 = 0 THEN 'changed' ELSE p END, '{PUBLISHED}', TRUE FROM a WHERE action = 'insert'""")
def m01_cycle(spark, sf_dir):
    items, actions = _scan(spark, sf_dir)
    decisions_ = spark.createDataFrame([], "tenant_id string, feed_item_id long, decision string")
    out, _ = scan_cycle(items, decisions_, actions, ["title"], PUBLISHED, now(), F.xxhash64("source_ref"))
    return out.select("source_ref", "title", "status", (c("last_seen") == now()).alias("seen"))
