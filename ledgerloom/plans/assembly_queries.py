"""Queries of the document assembly and bill of materials operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as am
from ..operators import corpus as cp
from ..operators import variants as va
from ..operators import ranking as rk
from .queries import NOISE_SQL, SECTIONS_SQL, _lines, c, packed_sql, query, sections, table

# Schedules: one array of three stages an order.
SCHEDULE_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS queries, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS proposals FROM orders"


@query("E13_key_dates", SCHEDULE_SQL)
def e13(spark, sf_dir):
    stage = lambda name, start, end: F.struct(F.lit(name).alias("stage"), start.alias("start"), end.alias("end"))
    k, none = c("o_orderkey"), F.lit(None).cast("string")
    when = lambda cond, v: F.when(cond, v)
    schedule = F.array(
        stage("Absolución de consultas", c("o_orderstatus"), none), stage("Consultas y aclaraciones", none, when(k % 2 == 0, c("o_orderpriority"))),
        stage("Registro de consultas", when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit("")), stage("Presentación de propuestas", when(k % 5 != 0, c("o_orderstatus")), none),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", am.key_dates(schedule).alias("d")).select("o_orderkey", "d.queries", "d.proposals")


@query("E14_parse_validity", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%d.%m.%y') END AS since, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%d.%m.%y') END AS until FROM orders")
def e14(spark, sf_dir):
    day = lambda d: F.date_format(d, "dd.MM.yy")
    text = F.when(c("o_orderkey") % 4 > 0, F.concat(F.lit("x Fecha de VIGENCIA:\n Desde "), day(c("o_orderdate")), F.lit("  hasta "), day(c("o_orderdate") + F.expr("INTERVAL 30 DAY")))).otherwise("sin fecha")
    return table(spark, sf_dir, "orders").select("o_orderkey", am.parse_validity(text).alias("v")).select("o_orderkey", "v.*")


@query("E28_build_query", "SELECT p_partkey, substr(concat_ws(' ', CASE WHEN p_type = 'PROMO' THEN 'special offer' END, CASE WHEN contains(p_name, 'red widget') THEN 'crimson device' END, CASE WHEN contains(replace(p_name, 'red widget', ''), 'small') THEN 'compact' END, CASE WHEN contains(replace(p_name, 'red widget', ''), 'red') THEN 'crimson' END, p_size || ' GHz') || ' datasheet', 1, 40) AS q FROM part")
def e28(spark, sf_dir):
    params = F.array(F.concat(F.lit("up to "), c("p_size").cast("string"), F.lit(" GHz")), F.lit("plain"), F.lit("3 kg"))
    q = am.build_query(c("p_name"), c("p_type"), params, {"red": "crimson", "red widget": "crimson device", "small": "compact"}, {"PROMO": "special offer"}, " datasheet", 40)
    return table(spark, sf_dir, "part").select("p_partkey", q.alias("q"))


@query("F13_valid_line_ranges", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS line_start, l_suppkey AS line_end FROM lineitem WHERE l_linenumber % 3 > 0 AND CAST(l_quantity AS BIGINT) > 0 AND l_suppkey >= CAST(l_quantity AS BIGINT)")
def f13(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(c("l_linenumber") % 3 > 0, c("l_quantity").cast("int").cast("string")).otherwise("x").alias("line_start"), c("l_suppkey").alias("line_end"))
    return am.valid_line_ranges(rows)


NESTED_SQL = f"{SECTIONS_SQL}, s AS (SELECT doc_id, turn, level, CAST(CASE WHEN level = 1 THEN 1 ELSE line_start END AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM sections)"
LEAF_SQL = f"""{NESTED_SQL}, l AS (SELECT * FROM s a WHERE NOT (level <= 1 OR line_end - line_start + 1 > 250) OR NOT EXISTS (SELECT 1 FROM s b WHERE a.doc_id = b.doc_id AND b.level > a.level AND b.line_start >= a.line_start AND b.line_end <= a.line_end)),
  leaf AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id, line_start, line_end ORDER BY level DESC, turn) = 1)"""


def _nested(spark, sf_dir):
    return sections(spark, sf_dir).withColumn("line_start", F.when(c("level") == 1, F.lit(1)).otherwise(c("line_start")))


@query("W10_leaf_sections", f"WITH {LEAF_SQL} SELECT doc_id, turn, line_start, line_end FROM leaf")
def w10(spark, sf_dir):
    return am.leaf_sections(_nested(spark, sf_dir), "doc_id", "turn").select("doc_id", "turn", "line_start", "line_end")


@query("W12_close_gaps", """WITH s AS (SELECT conv_id, turn, turn * 10 + 3 AS a, turn * 10 + 3 + length(text) % 20 AS b, turn % 4 = 3 AS cut FROM conversations), e AS (SELECT *, lead(a) OVER w AS nx FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY a)), f AS (SELECT *, greatest(b, coalesce(nx - 1, 200)) AS fb FROM e),
  g AS (SELECT *, lag(fb) OVER (PARTITION BY conv_id ORDER BY a) AS pv FROM f) SELECT conv_id, turn, CASE WHEN pv IS NULL THEN least(a, 1) WHEN cut AND a <= pv THEN a ELSE pv + 1 END AS line_start, fb AS line_end FROM g""")
def w12(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", (c("turn") * 10 + 3).alias("line_start"), (c("turn") * 10 + 3 + F.length("text") % 20).alias("line_end"), (c("turn") % 4 == 3).alias("cut"), F.lit(200).alias("total"))
    return am.close_gaps(s, "conv_id", "total", "cut").select("conv_id", "turn", "line_start", "line_end")


CHUNK_SQL = f"""{LEAF_SQL.replace("leaf AS (SELECT * FROM l", "leaf AS (SELECT * FROM l WHERE doc_id % 7 > 0")},
  {packed_sql("leaf")}, totals AS (SELECT conv_id AS doc_id, CAST(sum(length(text)) + 7 AS BIGINT) AS total FROM conversations GROUP BY conv_id),
  bare AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) AS INTEGER) AS chunk, a AS line_start, least(a + 499, total) AS line_end, FALSE AS split
    FROM (SELECT *, unnest(range(1, total + 1, 500)) AS a FROM totals) WHERE doc_id NOT IN (SELECT doc_id FROM packed)),
  e AS (SELECT *, row_number() OVER w AS k, lead(line_start) OVER w AS nx FROM (SELECT * FROM packed UNION ALL SELECT * FROM bare) JOIN totals USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY line_start, line_end)),
  f AS (SELECT *, greatest(line_end, coalesce(nx - 1, total)) AS fb FROM e), g AS (SELECT *, lag(fb) OVER (PARTITION BY doc_id ORDER BY k) AS pv FROM f),
  h AS (SELECT doc_id, chunk, k, split, CASE WHEN pv IS NULL THEN least(line_start, 1) WHEN split AND line_start <= pv THEN line_start ELSE pv + 1 END AS a, fb AS b FROM g),
  v AS (SELECT *, greatest(b - greatest(coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a - 1), a - 1), 0) AS fresh FROM h)"""


@query("D05_chunk_documents", f"WITH RECURSIVE {CHUNK_SQL} SELECT doc_id, chunk, a AS line_start, b AS line_end, split, CAST(sum(fresh) OVER (PARTITION BY doc_id) AS BIGINT) AS covered FROM v")
def d05(spark, sf_dir):
    totals = table(spark, sf_dir, "conversations").groupBy(c("conv_id").alias("doc_id")).agg((F.sum(F.length("text")) + 7).alias("total"))
    return am.chunk_documents(_nested(spark, sf_dir).filter("doc_id % 7 > 0"), "doc_id", "turn", totals=totals)


@query("W14_number_candidates", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN CAST(row_number() OVER (PARTITION BY l_orderkey, l_returnflag <> 'R' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) ELSE 0 END AS number FROM lineitem")
def w14(spark, sf_dir):
    return am.number_candidates(table(spark, sf_dir, "lineitem"), "l_orderkey", c("l_returnflag") != "R", [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "number")


@query("W15_assign_ids", "SELECT o_orderkey, printf('EXP-%03d', row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 > 0 THEN o_custkey END NULLS LAST, o_orderkey)) AS new_id FROM orders")
def w15(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_orderkey") % 3 > 0, c("o_custkey")).alias("old"))
    return rk.assign_ids(rows, "old", [F.asc("o_orderkey")]).select("o_orderkey", "new_id")


@query("W20_plan_candidates", """WITH p AS (SELECT source AS doc, doc_id AS page, n_chars AS area, CASE WHEN doc_id % 9 < 4 THEN 0.5 ELSE 0.1 END AS r, doc_id % 7 AS n FROM documents), m AS (SELECT *, r >= 0.4 AS heavy, median(area) OVER (PARTITION BY doc) AS med, avg(CAST(r >= 0.4 AS INTEGER)) OVER (PARTITION BY doc) AS share, row_number() OVER (PARTITION BY doc, r >= 0.4 ORDER BY page) AS k FROM p),
  g AS (SELECT *, count(*) OVER (PARTITION BY doc, heavy, page - k) AS run FROM m), o AS (SELECT doc, page, concat_ws(',', CASE WHEN area >= 1.4 * med THEN 'area' END, CASE WHEN page % 13 = 0 THEN 'width' END, CASE WHEN area > 5000 THEN 'drawings' END, CASE WHEN heavy AND share <= 0.7 AND run <= 5 AND n <= 4 THEN 'images' END) AS reasons FROM g) SELECT * FROM o WHERE reasons <> ''""")
def w20(spark, sf_dir):
    k = c("doc_id")
    pages = table(spark, sf_dir, "documents").select(c("source").alias("doc"), k.alias("page"), c("n_chars").alias("area"), F.when(k % 9 < 4, 0.5).otherwise(0.1).alias("image_area_ratio"), (k % 7).alias("image_count"), F.when(k % 13 == 0, 700).otherwise(600).alias("width"), F.lit(900).alias("height"), c("n_chars").alias("drawing_count"), F.lit(None).cast("double").alias("drawing_ratio"))
    return am.plan_candidates(pages, "doc", "page")


@query("G11_image_noise", """WITH r AS (SELECT l_suppkey % 50 AS doc_id, l_partkey % 300 AS xref, l_orderkey % 12 AS page FROM lineitem), u AS (SELECT doc_id, xref % 100 AS sha, xref, count(DISTINCT page) AS pages FROM r GROUP BY ALL), s AS (SELECT doc_id, xref % 100 AS sha, count(DISTINCT page) AS sp FROM r GROUP BY ALL),
  k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, sha) AS copies, bool_or(pages >= 5) OVER (PARTITION BY doc_id, sha) AS frequent FROM u JOIN s USING (doc_id, sha))
  SELECT doc_id, xref, CASE WHEN pages >= 5 THEN 'HIGH_FREQ' WHEN copies > 1 AND NOT frequent THEN 'DUPLICATE' WHEN xref % 5 = 0 THEN 'TINY' WHEN frequent THEN 'HIGH_FREQ' WHEN sp BETWEEN 2 AND 4 THEN 'SIGNATURE' ELSE 'CONTENT' END AS category FROM k""")
def g11(spark, sf_dir):
    x = c("l_partkey") % 300
    size = F.when(x % 5 == 0, 12).otherwise(200)
    refs = table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 50).alias("doc_id"), x.alias("xref"), (x % 100).alias("sha"), (c("l_orderkey") % 12).alias("page"), size.alias("width"), size.alias("height"))
    return am.image_noise(refs, "doc_id")


@query("G13_sheet_profile", "WITH g AS (SELECT source, count_if(doc_id % 3 > 0) AS texts, count_if(doc_id % 3 = 0) AS numbers, count(*) FILTER (WHERE doc_id % 3 > 0 AND length(text) >= 200) AS long_texts, count(*) AS f FROM documents GROUP BY source) SELECT source, texts, numbers, long_texts, CASE WHEN long_texts / f >= 0.4 THEN 'text' ELSE 'markdown' END AS representation FROM g")
def g13(spark, sf_dir):
    cells = table(spark, sf_dir, "documents").select("source", F.when(c("doc_id") % 3 > 0, "text").otherwise("number").alias("kind"), "text", F.lit(None).cast("int").alias("merged_min_row"), c("doc_id").alias("row"), (c("doc_id") % 3 + 1).alias("col"))
    return am.sheet_profile(cells, "source").select("source", "texts", "numbers", "long_texts", "representation")


DIFF_SQL = """a AS (SELECT user_id, event_type, count(*) AS a FROM events WHERE event_id % 3 < 2 AND user_id % 9 > 0 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS b FROM events WHERE event_id % 3 > 0 AND user_id % 7 > 0 GROUP BY ALL),
  d AS (SELECT user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (user_id, event_type)),
  p AS (SELECT user_id, CASE WHEN sum(a) = 0 THEN 'added' WHEN sum(b) = 0 THEN 'removed' WHEN sum(abs(a - b)) > 0 THEN 'changed' ELSE 'identical' END AS status, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS removed, CAST(sum(least(a, b)) AS BIGINT) AS same FROM d GROUP BY user_id)"""


def _line_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return am.version_line_diff(e.filter("event_id % 3 < 2 AND user_id % 9 > 0"), e.filter("event_id % 3 > 0 AND user_id % 7 > 0"), "user_id", "event_type")


@query("D09_version_line_diff", f"WITH {DIFF_SQL} SELECT * FROM p")
def d09(spark, sf_dir):
    return _line_diff(spark, sf_dir)


@query("G16_diff_summary", f"WITH {DIFF_SQL} SELECT status, count(*) AS pages, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM p GROUP BY status")
def g16(spark, sf_dir):
    return am.diff_summary(_line_diff(spark, sf_dir))


PLACED_SQL = "SELECT source, doc_id, pos, trim(l) AS line FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE length(trim(l)) >= 2"


@query("D01_clean_corpus", NOISE_SQL + f""", placed AS ({PLACED_SQL}), n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '\\s+', ' ', 'g'), '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}', 'DATE', 'g'), '[0-9]{{1,2}}:[0-9]{{2}}', 'TIME', 'g'), '[0-9]{{1,4}}', 'N', 'g')) AS norm FROM placed)
  SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS body FROM n WHERE NOT EXISTS (SELECT 1 FROM noise x WHERE x.source = n.source AND x.norm = n.norm) AND NOT regexp_matches(line, '^[0-9]+$') GROUP BY doc_id""")
def d01(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    noise = cp.repeated_lines(lines, "source", "doc_id", "norm", 0.1, 5)
    return am.clean_corpus(lines, noise, ["source", "norm"], "doc_id", "pos", "line", c("line").rlike("^[0-9]+$")).select("doc_id", F.md5("body").alias("body"))


@query("D02_assemble_markdown", """WITH f AS (SELECT conv_id, text, min(turn) AS p FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY ALL)
  SELECT conv_id, md5(string_agg('x' || chr(10) || chr(10) || '# ' || trim(text) || ' offin', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p)) AS body FROM f GROUP BY conv_id""")
def d02(spark, sf_dir):
    marked = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.trim("text") != "", F.concat(F.lit("x# "), F.trim("text"), F.lit(" o\ufb00in "))))
    out = am.assemble_markdown(marked, "conv_id", ["text"], "turn", "role", "text", ["system"])
    return out.select("conv_id", F.md5("body").alias("body"))


@query("D04_pick_section", "WITH s AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '_intro' ELSE lower(role) END AS title, text FROM conversations) SELECT conv_id, md5(substr(coalesce(min_by(text, turn) FILTER (contains(title, 'assist')), min_by(text, turn) FILTER (title = '_intro'), ''), 1, 200)) AS picked FROM s GROUP BY conv_id")
def d04(spark, sf_dir):
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(c("turn") == 0, "_intro").otherwise(F.lower("role")).alias("title"), c("text").alias("body"))
    return am.pick_section(s, "conv_id", "turn", ["assist", "help"], 200).select("conv_id", F.md5("picked").alias("picked"))


@query("D06_validate_entries", """WITH e AS (SELECT conv_id, turn // 2 AS entry, length(text) % 50 AS a, 40 AS b, CASE WHEN turn % 5 > 0 THEN text END AS v FROM conversations), n AS (SELECT *, count(*) OVER (PARTITION BY conv_id, entry) AS n FROM e)
  SELECT conv_id, entry, 'duplicate id' AS error FROM n WHERE n > 1 UNION ALL SELECT conv_id, entry, 'bad range' FROM n WHERE a > b UNION ALL SELECT conv_id, entry, 'past the end' FROM n WHERE b > conv_id % 60
  UNION ALL SELECT conv_id, entry, CASE WHEN coalesce(trim(v), '') = '' THEN 'no evidence' ELSE 'long evidence' END FROM n WHERE coalesce(trim(v), '') = '' OR length(v) > 400
  UNION ALL SELECT conv_id, NULL, 'plan leaves lines out' FROM conversations WHERE conv_id % 60 > 0 GROUP BY conv_id HAVING 10 * count(DISTINCT turn) FILTER (turn % 3 > 0 AND 10 * turn + 10 <= conv_id % 60) + count(DISTINCT turn) FILTER (turn % 3 > 0 AND 10 * turn < conv_id % 60 AND 10 * turn + 10 > conv_id % 60) * (conv_id % 10) < conv_id % 60
  UNION ALL SELECT DISTINCT conv_id, NULL, 'not read: ' || (10 * turn + 1) || '-' || (10 * turn + 10) FROM conversations WHERE turn % 3 = 1""")
def d06(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    entries = conv.select("conv_id", F.expr("turn div 2").alias("entry"), (F.length("text") % 50).alias("line_start"), F.lit(40).alias("line_end"), F.when(c("turn") % 5 > 0, c("text")).alias("evidence"))
    plan = conv.filter("turn % 3 > 0").select("conv_id", (10 * c("turn") + 1).alias("line_start"), (10 * c("turn") + 10).alias("line_end"))
    read = plan.filter("line_start % 30 <> 11")
    return am.validate_entries(entries, conv.select("conv_id", (c("conv_id") % 60).alias("total")), "conv_id", "entry", plan=plan, read=read)


@query("D07_entry_report", "WITH p AS (SELECT conv_id, CASE WHEN turn % 3 = 0 THEN 'unclear' ELSE role END AS phase, string_agg('- ' || text, chr(10) ORDER BY turn) AS b FROM conversations GROUP BY ALL) SELECT conv_id, md5(string_agg('## ' || phase || chr(10) || b, chr(10) ORDER BY phase)) AS report FROM p GROUP BY conv_id")
def d07(spark, sf_dir):
    entries = table(spark, sf_dir, "conversations").withColumn("phase", F.when(c("turn") % 3 > 0, c("role")).otherwise(" "))
    return am.entry_report(entries, "conv_id", "phase", "turn", "text").select("conv_id", F.md5("report").alias("report"))


@query("D10_apply_clarifications", "SELECT conv_id, md5(coalesce(string_agg(CASE turn % 4 WHEN 1 THEN 'new [v' || (1 + conv_id % 3) || ']' WHEN 2 THEN text || chr(10) || 'new [v' || (1 + conv_id % 3) || ']' ELSE text END, chr(10) ORDER BY turn), '')) AS body FROM conversations WHERE turn % 4 <> 3 GROUP BY conv_id")
def d10(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    action = F.element_at(F.array(F.lit("none"), F.lit("modify"), F.lit("add"), F.lit("delete")), (c("turn") % 4 + 1).cast("int"))
    last = lines.select("conv_id", "turn", action.alias("action"), F.lit("new").alias("new_text"), (c("conv_id") % 3 + 1).alias("version"))
    earlier = lines.select("conv_id", "turn", F.lit("delete").alias("action"), F.lit("old").alias("new_text"), F.lit(0).alias("version"))
    return am.apply_clarifications(lines, last.unionByName(earlier), "conv_id", "turn", "text", "version")[0].select("conv_id", F.md5("body").alias("body"))


@query("D11_staging_select", "SELECT d.doc_id, CASE WHEN quality = 1 THEN 'integrated' ELSE 'separate' END AS clarification FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0")
def d11(spark, sf_dir):
    manifest = table(spark, sf_dir, "labels").select("doc_id", (c("toxic") == 0).alias("include"), F.when(c("quality") == 1, "integrated").otherwise("separate").alias("clarification"))
    return am.staging_select(table(spark, sf_dir, "documents"), manifest, "doc_id").select("doc_id", "clarification")


@query("J14_bom_with_results", "SELECT p_partkey, p_brand AS spec, l_orderkey FROM part LEFT JOIN (SELECT l_partkey, l_orderkey FROM lineitem WHERE l_quantity > 40) ON l_partkey = p_partkey")
def j14(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    results = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(c("l_partkey").alias("p_partkey"), "l_orderkey")
    return am.bom_with_results(p.select("p_partkey"), p.select("p_partkey", c("p_brand").alias("spec")), results, "p_partkey")


@query("J16_missing_refs", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 > 0 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def j16(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(c("o_orderkey") % 4 > 0, c("o_orderpriority")).otherwise(" ").alias("ref"))
    refs = rows.filter("ref IN ('1-URGENT', '2-HIGH')").select("ref").distinct()
    return am.missing_refs(rows, refs, "ref").select("o_orderkey")


STATES_SQL = "s AS (SELECT l_partkey AS item, l_linestatus AS grp, CASE WHEN l_suppkey % 5 = 0 THEN 'VALIDO' WHEN l_suppkey % 5 = 1 THEN 'CONDICIONADO' ELSE 'SIN_CANDIDATO' END AS state FROM lineitem)"


@query("G06_group_totals", f"WITH {STATES_SQL}, f AS (SELECT grp, item, count(*) AS n, bool_or(state = 'VALIDO') AS v, bool_or(state = 'CONDICIONADO') AS k FROM s GROUP BY ALL) SELECT grp, CAST(sum(n) AS BIGINT) AS rows, count(*) AS items, count_if(v) AS resolved, count_if(k AND NOT v) AS conditional, count_if(NOT v AND NOT k) AS without FROM f GROUP BY grp")
def g06(spark, sf_dir):
    s = c("l_suppkey") % 5
    rows = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("item"), c("l_linestatus").alias("grp"), F.when(s == 0, "VALIDO").when(s == 1, "CONDICIONADO").otherwise("SIN_CANDIDATO").alias("state"))
    return am.group_totals(rows, "item", "grp")


@query("B11_classify_results", "SELECT p_partkey AS item, count(l_partkey) AS accepted, CASE WHEN count(l_partkey) > 0 THEN 'CON_CANDIDATOS' ELSE 'SIN_CANDIDATOS' END AS state FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_suppkey % 5 < 2 AND l_quantity > 47) ON l_partkey = p_partkey GROUP BY p_partkey")
def b11(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").filter("l_quantity > 47").select(c("l_partkey").alias("item"), F.when(c("l_suppkey") % 5 < 2, "VALIDO").otherwise("DESCARTADO").alias("class"))
    return am.classify_results(table(spark, sf_dir, "part").select(c("p_partkey").alias("item")), found, "item")


REQS_SQL = "q AS (SELECT l_partkey AS item, l_orderkey * 1000000000 + l_linenumber * 100000000 + l_suppkey * 10000 + CAST(l_quantity AS BIGINT) * 100 + CAST(round(l_discount * 100) AS BIGINT) AS pos, l_returnflag || l_shipdate AS text, CASE WHEN l_linestatus = 'F' THEN 'Hard' ELSE 'Soft' END AS hard_soft, CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag END AS parameter, CASE WHEN l_linenumber % 2 > 0 THEN CAST(l_suppkey AS VARCHAR) END AS value, l_linenumber AS w FROM lineitem)"


def _requirements(spark, sf_dir):
    n = c("l_linenumber")
    pos = c("l_orderkey") * 1_000_000_000 + n * 100_000_000 + c("l_suppkey") * 10_000 + c("l_quantity").cast("long") * 100 + F.round(c("l_discount") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("item"), pos.alias("pos"), F.concat("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("text"), F.when(c("l_linestatus") == "F", "Hard").otherwise("Soft").alias("hard_soft"), F.when(n % 3 > 0, c("l_returnflag")).alias("parameter"), F.when(n % 2 > 0, c("l_suppkey").cast("string")).alias("value"), n.alias("w"))


@query("B02_search_bom", f"WITH {REQS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY w DESC, pos) AS n FROM q WHERE hard_soft = 'Hard'), t AS (SELECT item, string_agg(text, '; ' ORDER BY n) FILTER (n <= 10) AS params, count(*) AS hard FROM h GROUP BY item) SELECT p_partkey AS item, md5(coalesce(params, '')) AS params, coalesce(hard, 0) AS hard FROM part LEFT JOIN t ON item = p_partkey WHERE p_type <> 'PROMO'")
def b02(spark, sf_dir):
    bom = table(spark, sf_dir, "part").select(c("p_partkey").alias("item"), c("p_type").alias("group"))
    return am.search_bom(bom, _requirements(spark, sf_dir), "item", c("w"), "PROMO").select("item", F.md5("params").alias("params"), "hard")


@query("B04_key_spec", f"WITH {REQS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos) AS n FROM q WHERE hard_soft = 'Hard'), f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY pos) AS k FROM h WHERE n <= 5 AND parameter IS NOT NULL) SELECT item, substr(string_agg(concat_ws(': ', parameter, value), '; ' ORDER BY k), 1, 120) AS spec FROM f WHERE k <= 3 GROUP BY item")
def b04(spark, sf_dir):
    return am.key_spec(_requirements(spark, sf_dir), "item", "pos")


@query("B09_audit_bom", """WITH s AS (SELECT p_partkey AS item FROM part WHERE p_partkey % 11 > 0), b AS (SELECT p_partkey AS item, CASE WHEN p_size % 4 = 0 THEN 'thing' ELSE 'good' END AS kind, CASE WHEN p_partkey % 5 = 0 THEN -1 WHEN p_partkey % 5 = 1 THEN p_partkey END AS parent, CASE WHEN p_partkey % 3 = 0 THEN 'zz' ELSE p_name END AS text, p_name || ' ' || p_type AS body FROM part WHERE p_partkey % 13 > 0)
  SELECT item, 'kind' AS finding FROM b WHERE kind = 'thing' UNION ALL SELECT item, 'missing' FROM s WHERE item NOT IN (SELECT item FROM b) UNION ALL SELECT item, 'extra' FROM b WHERE item NOT IN (SELECT item FROM s) UNION ALL SELECT item, 'parent' FROM b WHERE parent = -1 UNION ALL SELECT item, 'not verbatim' FROM b WHERE NOT contains(lower(body), lower(text))""")
def b09(spark, sf_dir):
    k, p = c("p_partkey"), table(spark, sf_dir, "part")
    bom = p.filter(k % 13 > 0).select(k.alias("item"), F.when(c("p_size") % 4 == 0, "thing").otherwise("good").alias("kind"), F.when(k % 5 == 0, F.lit(-1)).when(k % 5 == 1, k).alias("parent"), F.when(k % 3 == 0, "zz").otherwise(F.concat(F.lit(" "), F.upper("p_name"))).alias("text"), k.alias("doc"))
    return am.audit_bom(bom, p.filter(k % 11 > 0).select(k.alias("item")), p.select(k.alias("doc"), F.concat_ws("\n ", "p_name", "p_type").alias("body")), "item", ["good", "service"])


@query("B10_merge_cross_document", "SELECT p_name AS name, p_type AS type, min_by(p_brand || p_size, (p_partkey % 3, p_partkey)) AS wording, string_agg(DISTINCT CAST(p_partkey % 3 AS VARCHAR), ',' ORDER BY CAST(p_partkey % 3 AS VARCHAR)) AS sources, string_agg(DISTINCT CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR)) AS ids, count(DISTINCT p_partkey % 3) AS documents FROM part GROUP BY ALL")
def b10(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select(c("p_name").alias("name"), c("p_type").alias("type"), (c("p_partkey") % 3).alias("doc"), c("p_partkey").alias("entry"), F.concat("p_brand", c("p_size").cast("string")).alias("text"))
    return am.merge_cross_document(entries, ["name", "type"], "doc", "entry", "text")


MERGED_SQL = """SELECT 'EXP-' || lpad(CAST(k AS VARCHAR), CAST(greatest(3, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS new_id, p_type, p_brand, description, quantity, variants, notes, CAST(items AS BIGINT) AS items FROM (SELECT *, row_number() OVER (ORDER BY p_type, p_brand, description, last) AS k FROM m)"""
_ITEMS_SQL = "i AS (SELECT p_partkey, p_type, p_brand, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, lower(p_name) AS norm, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'some' END AS q, p_partkey % 4 AS v, CASE WHEN p_size % 3 = 0 THEN 'n' || p_size END AS note FROM part)"
_MERGE_SQL = """max_by(name, (length(name), name)) AS description, coalesce(max(q) FILTER (q <> 'some'), max(q)) AS quantity, string_agg(DISTINCT CAST(v AS VARCHAR), ',' ORDER BY CAST(v AS VARCHAR)) AS variants, coalesce(string_agg(DISTINCT note, '; ' ORDER BY note), '') AS notes, count(*) AS items"""


def _items(spark, sf_dir):
    """Parts as items of four variants: some names in capitals, some quantities as text."""
    k, size = c("p_partkey"), c("p_size")
    return table(spark, sf_dir, "part").select(
        "p_type", "p_brand", F.when(k % 3 == 0, F.upper("p_name")).otherwise(c("p_name")).alias("name"), F.when(size % 2 == 0, size.cast("string")).otherwise("some").alias("q"),
        (k % 4).alias("v"), F.when(size % 3 == 0, F.concat(F.lit("n"), size.cast("string"))).alias("note"),
    )


@query("B01_merge_variants", f"WITH {_ITEMS_SQL}, m AS (SELECT p_type, p_brand, norm AS last, {_MERGE_SQL} FROM i GROUP BY p_type, p_brand, norm) {MERGED_SQL}")
def b01_merge(spark, sf_dir):
    return va.merge_variants(_items(spark, sf_dir), ["p_type", "p_brand"], "name", "q", "v", "note")


@query("B01_fuzzy_variants", f"""WITH RECURSIVE {_ITEMS_SQL}, t AS (SELECT DISTINCT p_type, p_brand, norm FROM i),
  e AS (SELECT a.p_type, a.p_brand, a.norm AS x, b.norm AS y FROM t a JOIN t b ON a.p_type = b.p_type AND a.p_brand = b.p_brand AND levenshtein(a.norm, b.norm) <= 0.25 * greatest(length(a.norm), length(b.norm)) + 1e-9),
  w AS (SELECT p_type, p_brand, norm AS x, norm AS y FROM t UNION SELECT w.p_type, w.p_brand, w.x, e.y FROM w JOIN e ON e.p_type = w.p_type AND e.p_brand = w.p_brand AND e.x = w.y),
  g AS (SELECT p_type, p_brand, x AS norm, min(y) AS last FROM w GROUP BY ALL), j AS (SELECT i.*, last FROM i JOIN g USING (p_type, p_brand, norm)),
  m AS (SELECT p_type, p_brand, {_MERGE_SQL} FROM j GROUP BY p_type, p_brand, last) SELECT p_type, p_brand, description, quantity, variants, notes, CAST(items AS BIGINT) AS items FROM m""")
def b01_fuzzy(spark, sf_dir):
    return va.merge_variants(_items(spark, sf_dir), ["p_type", "p_brand"], "name", "q", "v", "note", least=0.75).drop("new_id")
