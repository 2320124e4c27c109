"""Queries of catalogs, listing and detail pages, fingerprints, drawings, images, regions and risks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import assembly as am
from ..operators import corpus as cp
from ..operators import feed as fd
from ..operators import upkeep as up
from ..operators.ranking import shared_folder
from ..sources import layouts as ly
from ..sources import readers as rd
from .queries import c, candidates, query, table


@query("A01_read_entity_catalog", "SELECT CAST(s_suppkey AS VARCHAR) AS ruc, s_name AS nombre, 'ACTIVO' AS estado FROM supplier WHERE s_suppkey % 10 <> 3 AND s_suppkey % 10 <> 4")
def a01(spark, sf_dir):
    path, k = shared_folder(spark, "catalog"), c("s_suppkey")
    key = F.when(k % 10 == 4, "none").otherwise(F.concat(F.lit(" No. "), k.cast("string"), F.lit("- ")))
    row = F.when(k % 10 == 3, F.concat_ws("|", key, "s_name")).otherwise(F.concat_ws("|", key, F.concat(F.lit(" "), c("s_name")), F.lit("ACTIVO")))
    head = spark.range(1).select(F.lit("ruc | Nombre_de_Entidad|ESTADO").alias("value"))
    lines = head.unionByName(table(spark, sf_dir, "supplier").select(row.alias("value")))
    lines.coalesce(1).write.text(path)  # the header is the first line of one file
    return rd.read_entity_catalog(spark, path).toDF("ruc", "nombre", "estado")


def _listing_page(pages: DataFrame) -> DataFrame:
    """Each page with a listing of four rows before its own markup: two good ones, a repeated id and a short one."""
    k = c("page_id").cast("string")

    def row(at: int, nid: str, cells: int):
        tds = F.concat(*[F.concat(F.lit(f"<td><span>c{j}-"), k, F.lit("</span></td>")) for j in range(cells)])
        call = F.concat(F.lit("f({'nidProceso':'"), k, F.lit(f"{nid}','nidConvocatoria':'v"), k, F.lit("','formBuscador:dtProcesos:1:x':'formBuscador:dtProcesos:1:x'})"))
        return F.concat(F.lit(f'<tr data-ri="{at}">'), tds, F.lit('<td><a id="own" href="#" onclick="'), call, F.lit('">x</a></td></tr>'))

    body = F.concat(row(4, "0", 9), row(5, "1", 9), row(6, "1", 9), row(7, "2", 5))
    return pages.withColumn("html", F.concat(F.lit('<table><tbody id="formBuscador:dtProcesos_data" class="x">'), body, F.lit("</tbody></table>"), F.coalesce("html", F.lit(""))))


@query("A03_extract_listing_rows", """SELECT page_id, CAST(4 + n AS INTEGER) AS row_index, 'c0-' || page_id AS numero, 'c1-' || page_id AS fecha_publicacion, 'c2-' || page_id AS nomenclatura, 'c3-' || page_id AS reiniciado_desde, 'c4-' || page_id AS objeto,
  'c5-' || page_id AS descripcion, 'c6-' || page_id AS cuantia, 'c7-' || page_id AS moneda, 'c8-' || page_id AS version_seace, page_id || '' || n AS nid_proceso, 'v' || page_id AS nid_convocatoria, '3' AS nid_sistema, '0' AS ntipo, 'formBuscador:dtProcesos:1:x' AS link_id
  FROM pages, (VALUES (0), (1)) v(n)""")
def a03_rows(spark, sf_dir):
    return ly.extract_listing_rows(_listing_page(table(spark, sf_dir, "pages")), "page_id", "html")


@query("A05_extract_documents", """SELECT page_id, CAST(n AS INTEGER) AS place, 'u' || n || '-' || page_id AS uuid, CASE n WHEN 0 THEN 'Bases' ELSE url END AS name, 'Etapa' AS stage, 'Bases' AS kind, CAST(page_id % 90 AS VARCHAR) AS size, '01/02/2024' AS "date", CAST(n + 1 AS VARCHAR) AS access
  FROM pages, (VALUES (0), (1)) v(n)""")
def a05_documents(spark, sf_dir):
    k = c("page_id").cast("string")

    def row(n: int, name):
        call = F.concat(F.lit(f"return descargaDocGeneral('u{n}-"), k, F.lit(f"','{n + 1}','"), name, F.lit("');"))
        return F.concat(F.lit("<tr><td>1</td><td>Etapa</td><td>Bases</td><td>"), F.lit('<a href="#" onclick="'), call, F.lit('">('), (c("page_id") % 90).cast("string"), F.lit(" KB)</a></td><td>01/02/2024</td><td></td></tr>"))

    html = F.concat(F.lit("<table><tr><td><table>"), row(0, F.lit("")), row(1, c("url")), F.lit("</table></td></tr></table>"), F.coalesce("html", F.lit("")))
    return ly.extract_documents(table(spark, sf_dir, "pages").withColumn("html", html), "page_id", "html")


@query("A05_label_value", "SELECT page_id, 'LP-' || page_id AS code, '' AS missing FROM pages")
def a05_label(spark, sf_dir):
    k = c("page_id").cast("string")
    html = F.concat(F.lit("<table><tr><td>x</td><td><b>Nomenclatura:</b></td><td> LP-"), k, F.lit("</td></tr></table>"), F.coalesce("html", F.lit("")))
    page = table(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return page.select("page_id", ly.label_value(c("html"), "Nomenclatura:").alias("code"), ly.label_value(c("html"), "No such label:").alias("missing"))


@query("A13_grouped_markdown", """WITH i AS (SELECT p_type, p_partkey, '### ' || p_partkey || ' — ' || p_name || chr(10) || CASE WHEN p_size % 3 = 0 THEN '  - **SIN CANDIDATO**: ' || p_brand WHEN p_size % 3 = 1 THEN '  - Servicio' ELSE '  - **Candidato 1**: ' || p_brand || ' — **VALIDO**' || chr(10) || '  - **Candidato 2**: ' || p_brand || ' — **VALIDO**' END AS s FROM part)
  SELECT md5('## ' || p_type || chr(10) || chr(10) || string_agg(s, chr(10) || chr(10) ORDER BY p_partkey)) AS body FROM i GROUP BY p_type""")
def a13_markdown(spark, sf_dir):
    path, p, k = shared_folder(spark, "markdown"), table(spark, sf_dir, "part"), c("p_size") % 3
    number = F.explode(F.when(k == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0))))
    rows = p.select("p_type", "p_partkey", "p_name", "p_brand", F.when(k == 0, "SIN_CANDIDATO").when(k == 1, "SERVICIO").otherwise("VALIDO").alias("state"), number.alias("candidate"))
    text = rd.consolidated_markdown(rows, "p_type", "p_partkey", "p_name", "candidate", "p_brand", "state", "p_brand")
    rd.write_consolidated(p, path, ["p_partkey", "p_name", "p_size"], text)
    return spark.read.text(f"{path}/md", wholetext=True).select(F.explode(F.split("value", "\n\n(?=## )")).alias("body")).select(F.md5(F.regexp_replace("body", r"\n+\z", "")).alias("body"))


# Documents and schedules: the lines of each order as two lists.
_LISTS_SQL = """l AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'u' || l_partkey || '-' || l_linenumber END AS uuid, l_returnflag AS stage, CAST(l_shipdate AS DATE) || '' AS day FROM lineitem),
  d AS (SELECT id, string_agg(uuid || chr(1) || stage, chr(2) ORDER BY n, uuid, stage, day) AS docs, coalesce(string_agg(uuid || chr(1) || stage, chr(2) ORDER BY uuid, n, stage, day) FILTER (uuid <> ''), '') AS known, string_agg(stage || chr(1) || day, chr(2) ORDER BY n, uuid, stage, day) AS plan FROM l GROUP BY id)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("l_partkey")
    uuid = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("-"), c("l_linenumber").cast("string")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", uuid.alias("uuid"), c("l_returnflag").alias("stage"), F.to_date("l_shipdate").cast("string").alias("day")).alias("r"))
    lists = rows.groupBy(c("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("r")).alias("docs"))
    noisy = F.transform("docs", lambda r: F.struct(F.concat(r["stage"], F.lit("  (Electrónica) ")).alias("stage"), r["day"].alias("day")))
    return lists.withColumns({"plan": F.transform("docs", lambda r: F.struct(r["stage"].alias("stage"), r["day"].alias("day"))), "noisy": noisy})


@query("E26_content_hash", f"WITH {_LISTS_SQL} SELECT id, sha256(plan || chr(1) || docs || chr(1) || '2024') AS out FROM d")
def e26_content(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", tx.content_hash(c("plan"), ["stage", "day"], c("docs"), ["uuid", "stage"], F.lit("2024")).alias("out"))


@query("E26_docs_fingerprint", f"WITH {_LISTS_SQL} SELECT id, sha256(known) AS out FROM d")
def e26_docs(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", tx.docs_fingerprint(c("docs"), "uuid", ["stage"]).alias("out"))


@query("E26_watch_fingerprint", f"WITH {_LISTS_SQL} SELECT id, sha256(plan || chr(1) || known || chr(1) || '2024') AS out FROM d")
def e26_watch(spark, sf_dir):
    return _lists(spark, sf_dir).select("id", tx.watch_fingerprint(c("noisy"), "stage", ["day"], ["(Electrónica)"], c("docs"), "uuid", ["stage"], F.lit(" 2024 ")).alias("out"))


@query("C02_last_document_counts", """SELECT o_orderkey AS item, CASE WHEN o_orderkey % 4 = 3 THEN TRUE ELSE o_orderkey % 2 = 0 END AS docs_equal FROM orders""")
def c02_last(spark, sf_dir):
    """One document an order, repeated on both sides: stale first rows differ, last rows only for odd orders; a fourth has none."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("item"))
    side = lambda first, last: o.filter("item % 4 <> 3").select("item", F.lit("u").alias("uuid"), F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit(first).alias("stage")), F.struct(F.lit(2).alias("n"), last.alias("stage")))).alias("r")).select("item", "uuid", "r.n", "r.stage", F.lit(None).cast("string").alias("day"))
    return up.documents_equal(side("stale", F.lit("x")), side("old", F.when(c("item") % 2 == 0, "x").otherwise("y")), "item", "uuid", ["stage"], "day", order="n", items=o)


@query("C03_noise_in_stages", "SELECT o_orderkey AS item, o_orderkey % 3 <> 0 AS schedule_equal FROM orders")
def c03_noise(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("item"), F.lit(1).alias("pos"), c("o_orderpriority").alias("stage"))
    new = o.withColumn("stage", F.concat(F.when(c("item") % 3 == 0, "new ").otherwise(""), F.lit(" "), c("stage"), F.lit("  a traves del SEACE ")))
    return up.schedule_equal(o, new, "item", "pos", ["stage"], "stage", ["A TRAVES DEL SEACE"])


@query("C05_last_duplicate", """WITH o AS (SELECT user_id, event_type, max_by(event_id, event_id) AS v FROM events WHERE event_id % 3 > 0 GROUP BY ALL), n AS (SELECT user_id, event_type, max_by(event_id, event_id) AS v FROM events WHERE event_id % 3 < 2 GROUP BY ALL)
  SELECT user_id, event_type, CASE WHEN o.v IS NULL THEN 'added' WHEN n.v IS NULL THEN 'removed' ELSE 'modified' END AS kind, CASE WHEN o.v IS NOT NULL AND n.v IS NOT NULL THEN CAST(o.v AS VARCHAR) END AS old, CASE WHEN o.v IS NOT NULL AND n.v IS NOT NULL THEN CAST(n.v AS VARCHAR) END AS new
  FROM o FULL JOIN n USING (user_id, event_type) WHERE o.v IS DISTINCT FROM n.v""")
def c05_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", c("event_id").alias("v"), c("event_id").alias("at"))
    return fd.changelog(e.filter("v % 3 > 0"), e.filter("v % 3 < 2"), ["user_id", "event_type"], ["v"], order="at").drop("field")


@query("C05_date_changes", "SELECT o_orderkey, 'modified' AS kind, 'day' AS field, CAST(o_orderdate AS DATE) || '' AS old, 'x' AS new FROM orders WHERE o_orderkey % 3 = 0")
def c05_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"))
    new = o.withColumn("day", F.when(c("o_orderkey") % 3 == 0, " x").when(c("o_orderkey") % 3 == 1, c("day")))
    return fd.date_changes(o, new, "o_orderkey", "day")


@query("D07_entry_index", "SELECT conv_id, CASE WHEN turn % 3 = 0 THEN 'unclear' ELSE role END AS phase, count(*) AS entries FROM conversations GROUP BY ALL")
def d07_index(spark, sf_dir):
    return am.entry_index(table(spark, sf_dir, "conversations").withColumn("role", F.when(c("turn") % 3 > 0, c("role")).otherwise(" ")), "conv_id", "role")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines of an order as a page; the new version lacks some lines and has others anew."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    l = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page"), place.alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("line"), "l_partkey")
    return l, l.filter("l_partkey % 7 > 0").withColumn("line", F.when(c("l_partkey") % 5 == 0, F.concat(F.lit("new"), c("pos").cast("string"))).otherwise(c("line")))


_REGIONS_SQL = """a AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS pos, l_returnflag || l_linestatus AS line, l_partkey FROM lineitem), b AS (SELECT page, pos, CASE WHEN l_partkey % 5 = 0 THEN 'new' || pos ELSE line END AS line FROM a WHERE l_partkey % 7 > 0),
  x AS (SELECT 0 AS side, page, pos, line, row_number() OVER (PARTITION BY page, line ORDER BY pos) AS nth FROM a WHERE page IN (SELECT page FROM b)), y AS (SELECT 1 AS side, page, pos, line, row_number() OVER (PARTITION BY page, line ORDER BY pos) AS nth FROM b),
  m AS (SELECT x.*, nth > coalesce((SELECT count(*) FROM b WHERE b.page = x.page AND b.line = x.line), 0) AS changed FROM x UNION ALL SELECT y.*, nth > coalesce((SELECT count(*) FROM a WHERE a.page = y.page AND a.line = y.line), 0) FROM y),
  g AS (SELECT *, pos - row_number() OVER (PARTITION BY side, page ORDER BY pos) AS k FROM m WHERE changed), r AS (SELECT page, count(*) AS n FROM g GROUP BY side, page, k), t AS (SELECT page, count(*) AS lines, count_if(changed) AS n FROM m GROUP BY page),
  z AS (SELECT t.page, t.n / lines AS changed_share, coalesce(regions, 0) AS regions, coalesce(big, 0) / lines AS largest_share FROM t LEFT JOIN (SELECT page, count(*) AS regions, max(n) AS big FROM r GROUP BY page) USING (page)),
  risks AS (SELECT *, CASE WHEN changed_share >= 0.2 OR largest_share >= 0.12 THEN 'high' WHEN changed_share >= 0.05 OR largest_share >= 0.03 OR regions >= 20 THEN 'medium' WHEN changed_share >= 0.005 OR regions > 0 THEN 'low' ELSE 'none' END AS risk FROM z)"""


@query("D09_changed_regions", f"WITH {_REGIONS_SQL} SELECT * FROM risks")
def d09_regions(spark, sf_dir):
    return am.changed_regions(*_versions(spark, sf_dir), "page", "pos", "line")


@query("G16_risk_summary", f"WITH {_REGIONS_SQL} SELECT risk, count(*) AS pages FROM risks GROUP BY risk")
def g16_risk(spark, sf_dir):
    return am.risk_summary(am.changed_regions(*_versions(spark, sf_dir), "page", "pos", "line"), "page")


@query("G10_repeated_drawings", """WITH d AS (
    SELECT user_id % 7 AS doc, CASE WHEN event_id // 300 % 3 = 0 THEN -(event_id // 300) ELSE 1 + event_id // 40 END AS page, event_type AS style, event_id % 2 AS j, event_id % 3 AS side FROM events),
  t AS (SELECT doc, count(DISTINCT page) AS total FROM d GROUP BY doc), o AS (SELECT doc, page FROM d GROUP BY doc, page HAVING count(*) <= 30),
  n AS (SELECT doc, style, min(side * 300 + j) AS x0, count(DISTINCT page) AS pages FROM d JOIN o USING (doc, page) GROUP BY doc, style)
  SELECT doc, CAST(x0 AS INTEGER) AS x0, CAST(10 AS INTEGER) AS y0, CAST(x0 + 50 AS INTEGER) AS x1, CAST(30 AS INTEGER) AS y1, style, pages, total FROM n JOIN t USING (doc) WHERE pages >= 10 AND pages >= 0.4 * total""")
def g10(spark, sf_dir):
    """Frames that jitter by a point and stand at one of three places of the page: of one size, so one drawing; every third run of 300 is a crowded page."""
    e, k = table(spark, sf_dir, "events"), c("event_id")
    x = (k % 3) * 300 + k % 2
    page = F.when(F.expr("event_id div 300 % 3 = 0"), -F.expr("event_id div 300")).otherwise(F.expr("1 + event_id div 40"))
    d = e.select((c("user_id") % 7).alias("doc"), page.alias("page"), (x + F.lit(0.25)).alias("x0"), F.lit(10.0).alias("y0"), (x + 50).alias("x1"), F.lit(30.0).alias("y1"), c("event_type").alias("style"))
    totals = d.groupBy("doc").agg(F.countDistinct("page").alias("total"))
    return am.repeated_drawings(d, "doc", totals, threshold=0.4, most=30)


_HASHES_SQL = """h AS (SELECT vec_id, label, [coalesce(list_sum([(CASE WHEN embedding[i] > t THEN 1 ELSE 0 END)::HUGEINT << (3 * (i - 1)) FOR i IN range(1, 21)]), 0) FOR t IN [-0.1, 0.0, 0.1, 0.2]] AS w FROM embeddings WHERE label % 3 > 0),
  f AS (SELECT min(vec_id) AS id, w FROM h GROUP BY w)"""


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four words of sign bits of a vector's first 20 components, for four thresholds, every third bit; what is missing is 0."""
    first = F.slice(F.coalesce("embedding", F.array().cast("array<float>")), 1, 20)
    word = lambda t: F.aggregate(F.transform(first, lambda x, i: F.when(x > t, F.call_function("shiftleft", F.lit(1).cast("long"), 3 * i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[word(t).alias(f"w{k}") for k, t in enumerate((-0.1, 0.0, 0.1, 0.2))])


@query("J15_hamming_join", f"""WITH {_HASHES_SQL} SELECT a.id AS "left", b.id AS "right", CAST(list_sum([bit_count(xor(a.w[k], b.w[k])) FOR k IN [1, 2, 3, 4]]) AS INTEGER) AS distance FROM f a JOIN f b ON a.id < b.id AND list_sum([bit_count(xor(a.w[k], b.w[k])) FOR k IN [1, 2, 3, 4]]) <= 12
  UNION ALL SELECT f.id, h.vec_id, 0 FROM h JOIN f ON h.w = f.w AND h.vec_id <> f.id""")
def j15(spark, sf_dir):
    return cp.hamming_pairs(_hashes(spark, sf_dir), "vec_id", ["w0", "w1", "w2", "w3"], 12, small=c("label") % 3 > 0)


@query("G11_perceptual_duplicates", f"""WITH RECURSIVE {_HASHES_SQL.replace(' WHERE label % 3 > 0', '')}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM h a JOIN h b ON a.vec_id <> b.vec_id AND a.label = b.label AND list_sum([bit_count(xor(a.w[k], b.w[k])) FOR k IN [1, 2, 3, 4]]) <= 12),
  r AS (SELECT a AS node, a AS low FROM p UNION SELECT p.b, r.low FROM r JOIN p ON p.a = r.node AND r.low < p.b), m AS (SELECT node, min(low) AS comp FROM r GROUP BY node)
  SELECT label AS doc, vec_id AS xref, CASE WHEN vec_id IN (SELECT node FROM m WHERE node <> comp) THEN 'PERCEPTUAL_DUP' ELSE 'CONTENT' END AS category FROM h""")
def g11_perceptual(spark, sf_dir):
    refs = _hashes(spark, sf_dir).select(c("label").alias("doc"), c("vec_id").alias("xref"), c("vec_id").alias("sha"), F.lit(1).alias("page"), F.lit(90).alias("width"), F.lit(80).alias("height"), "w0", "w1", "w2", "w3")
    return am.image_noise(refs, "doc", words=["w0", "w1", "w2", "w3"])


@query("G13_merged_ranges", """SELECT source, CAST(count_if(doc_id % 5 = 0 AND length(text) % 2 = 1) AS BIGINT) AS merged_data, CAST(count_if(doc_id % 5 = 0 AND length(text) % 2 = 0) AS BIGINT) AS merged_head, CASE WHEN count_if(doc_id % 5 = 0) > 0 THEN 'html' ELSE 'markdown' END AS representation FROM documents WHERE length(text) >= 0 GROUP BY source""")
def g13_merged(spark, sf_dir):
    k = c("doc_id")
    merged = F.when(k % 5 == 0, F.when(F.length("text") % 2 == 1, 9).otherwise(2))
    cells = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("source", F.lit("number").alias("kind"), "text", merged.alias("merged_min_row"), k.alias("row"), F.lit(4).alias("col"))
    return am.sheet_profile(cells, "source").select("source", "merged_data", "merged_head", "representation")


@query("W20_cad_and_width", "SELECT source AS doc, doc_id AS page, concat_ws(',', CASE WHEN doc_id % 6 = 0 THEN 'cad_like' END, CASE WHEN doc_id % 9 = 0 AND doc_id % 2 = 0 THEN 'images' END) AS reasons FROM documents WHERE doc_id % 6 = 0 OR (doc_id % 9 = 0 AND doc_id % 2 = 0)")
def w20_cad(spark, sf_dir):
    k = c("doc_id")
    pages = table(spark, sf_dir, "documents").select(c("source").alias("doc"), k.alias("page"), F.lit(1).alias("area"), F.when(k % 9 == 0, 0.5).otherwise(0.1).alias("image_area_ratio"), F.lit(1).alias("image_count"), F.lit(600).alias("width"), F.lit(900).alias("height"), F.lit(0).alias("drawing_count"), F.lit(0.0).alias("drawing_ratio"), (k % 6 == 0).alias("cad_like"), F.when(k % 2 == 0, 200).otherwise(80).alias("widest_image"))
    return am.plan_candidates(pages, "doc", "page")


@query("X01_refresh_and_documents", "SELECT 'orders' AS source, o_orderkey AS id, o_orderstatus AS status, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0")
def x01_refresh(spark, sf_dir):
    """Two sources; only one can refresh and list documents."""
    def fresh(s, items):
        return table(s, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status")).join(items.select("id"), "id", "left_semi")

    def documents(s, items):
        return table(s, sf_dir, "lineitem").select(c("l_orderkey").alias("id"), "l_linenumber").join(items.select("id"), "id", "left_semi")

    plain = lambda df: df.select(c("p_partkey").alias("id"))
    rd.register_source(rd.Source("orders", lambda s: table(s, sf_dir, "orders"), lambda df: df.select(c("o_orderkey").alias("id")), 1, fresh, documents))
    rd.register_source(rd.Source("parts", lambda s: table(s, sf_dir, "part"), plain, 2))
    items = rd.union_sources(spark, ["orders", "parts"]).filter("id % 2 = 0")
    listed = rd.document_index(spark, items, ["orders", "parts"]).groupBy("id").agg(F.count("*").alias("n"))
    return rd.refresh_watched(spark, items, ["orders", "parts"]).join(listed, "id").select("source", "id", "status", "n")
