"""One query an operator over the given tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..operators import corpus as cp
from ..operators import feed as fd
from ..operators import listing as ls
from ..operators.ranking import shared_folder
from ..sources import readers as rd
from ..streaming import streams as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Status words of feed items.
ANALYZED, DOWNLOADED, PUBLISHED = "analizada", "descargada", "publicada"
NOW = "2024-01-20 12:00:00"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def scalar(name: str, source: str, key: str, column: Callable[[], Column], sql: str, alias: str = "out") -> None:
    """Register a query of a key and one computed column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, column().alias(alias))

    query(name, f"SELECT {key}, {sql} AS {alias} FROM {source}")(run)


c = F.col
FOLD = "lower(strip_accents(coalesce({0}, '')))"

scalar("E01_fold_text", "documents", "doc_id", lambda: F.md5(tx.fold_text(F.concat(c("text"), F.lit(" Việt ế й Άλφα")))), "md5(lower(strip_accents(text || ' Việt ế й Άλφα')))")
scalar("E02_contains_term", "documents", "doc_id", lambda: tx.contains_term(c("text"), "idiot"), "regexp_matches(lower(strip_accents(text)), '(^|[^a-z0-9])idiot([^a-z0-9]|$)')")
scalar("E03_normalize_key", "part", "p_partkey", lambda: tx.normalize_key(F.concat(F.lit("  "), c("p_name"), F.lit("   "), c("p_type"))), "upper(trim(regexp_replace('  ' || p_name || '   ' || p_type, '[\\s ]+', ' ', 'g')))")
scalar("E04_digits_only", "customer", "c_custkey", lambda: tx.digits_only(c("c_name")), "regexp_replace(c_name, '[^0-9]', '', 'g')")
scalar("E05_parse_local_ts", "orders", "o_orderkey", lambda: tx.parse_local_ts(F.date_format("o_orderdate", "d/M/yyyy H:m"), "America/Lima", now()), "CASE WHEN year(o_orderdate) BETWEEN 2000 AND 2026 THEN date_trunc('minute', o_orderdate) + INTERVAL 5 HOUR END")
scalar("E06_parse_ddmmyy", "orders", "o_orderkey", lambda: tx.parse_ddmmyy(F.date_format("o_orderdate", "dd/MM/yy")), "CAST(o_orderdate AS DATE)")
scalar("E07_default_since", "orders", "o_orderkey", lambda: tx.default_since(F.to_date("o_orderdate")), "CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE)")
scalar("E08_parse_prefix_ts", "events", "event_id", lambda: tx.parse_prefix_ts(F.concat(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"), F.lit(" tail"))), "date_trunc('second', ts)")
_DIRTY = """CASE p_partkey % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN p_size || ',2' || p_size || ' a' WHEN 2 THEN ' ' || p_size || 'd' WHEN 3 THEN '-' || p_size || '.50' WHEN 4 THEN p_size || 'e2' ELSE NULL END"""


def _dirty() -> Column:
    """Numbers as people write them, and what only looks like one."""
    k, n = c("p_partkey") % 6, c("p_size").cast("string")
    forms = [F.lit("n/a"), F.concat(n, F.lit(",2"), n, F.lit(" a")), F.concat(F.lit(" "), n, F.lit("d")), F.concat(F.lit("-"), n, F.lit(".50")), F.concat(n, F.lit("e2"))]
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(k == i, form).otherwise(out)
    return out


scalar("E09_int_or_zero", "part", "p_partkey", lambda: tx.int_or_zero(_dirty()), f"coalesce(CAST(nullif(regexp_replace({_DIRTY}, '[^0-9]', '', 'g'), '') AS BIGINT), 0)")
scalar(
    "E09_float_or_zero", "part", "p_partkey", lambda: tx.float_or_zero(F.when(c("p_size") % 5 == 0, F.format_number("p_retailprice", 2)).otherwise(_dirty())),
    "CASE WHEN p_size % 5 = 0 THEN round(p_retailprice, 2) WHEN p_partkey % 6 = 3 THEN -p_size - 0.5 WHEN p_partkey % 6 = 4 THEN 100.0 * p_size ELSE 0.0 END",
)
scalar("E10_nid_advances", "orders", "o_orderkey", lambda: tx.nid_advances(F.when(c("o_orderkey") % 5 == 0, F.lit("-")).otherwise(c("o_custkey").cast("string")), c("o_orderkey").cast("string")), "CASE WHEN o_orderkey % 5 = 0 THEN TRUE ELSE o_orderkey > o_custkey END")
scalar("E11_extract_year", "orders", "o_orderkey", lambda: tx.extract_year(F.concat(F.lit("LP-1-"), F.date_format("o_orderdate", "yyyy")), F.lit(1900)), "CASE WHEN year(o_orderdate) >= 2000 THEN CAST(year(o_orderdate) AS INTEGER) ELSE 1900 END")
scalar("E12_clean_stage", "part", "p_partkey", lambda: tx.remove_phrases(F.concat(c("p_type"), F.lit(" (SEE Notes)  "), c("p_brand")), ["(see notes)", "n/d"]), "trim(regexp_replace(p_type || '   ' || p_brand, '\\s+', ' ', 'g'))")
scalar("E15_url_param", "pages", "page_id", lambda: tx.url_param(c("url"), "page"), "nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '')")
_NAME = """CASE page_id % 4 WHEN 0 THEN 'dir\\a: ' || page_id || '  b?.docx ' WHEN 1 THEN url WHEN 2 THEN repeat('x', 190) || page_id || '.xlsx' ELSE ' .. ' END"""
_CLEAN = f"(regexp_replace(regexp_replace(regexp_replace(trim(list_last(string_split(regexp_replace(replace({_NAME}, chr(92), '/'), '/+$', ''), '/'))), '[<>:\"|?*]', '_', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'))"


def _file_name() -> Column:
    k = c("page_id")
    own = F.concat(F.lit("dir\\a: "), k.cast("string"), F.lit("  b?.docx "))
    return F.when(k % 4 == 0, own).when(k % 4 == 1, c("url")).when(k % 4 == 2, F.concat(F.repeat(F.lit("x"), F.lit(190)), k.cast("string"), F.lit(".xlsx"))).otherwise(" .. ")


scalar(
    "E16_sanitize_filename", "pages", "page_id", lambda: tx.sanitize_filename(_file_name()),
    f"""(WITH a AS (SELECT CASE WHEN {_CLEAN} = '' THEN 'documento' ELSE {_CLEAN} END AS n), e AS (SELECT n, regexp_extract(n, '^.+(\\.[^.]+)$', 1) AS x FROM a)
    SELECT CASE WHEN x = '' THEN substr(n, 1, 176) || '.pdf' ELSE substr(substr(n, 1, length(n) - length(x)), 1, 180 - length(x)) || x END FROM e)""",
)
scalar(
    "E17_looks_like_size_label", "events", "event_id",
    lambda: tx.looks_like_size_label(F.when(c("event_id") % 3 == 0, F.concat(F.lit("("), c("user_id").cast("string"), F.lit(" KB).pdf"))).when(c("event_id") % 3 == 1, F.concat(c("user_id").cast("string"), F.lit(".5mb"))).otherwise(c("event_type"))),
    "event_id % 3 < 2",
)
scalar(
    "E17_looks_like_uuid", "events", "event_id",
    lambda: tx.looks_like_uuid(F.concat(F.lit("a/"), F.regexp_replace(F.md5(c("event_id").cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.when(c("event_id") % 3 == 0, ".pdf").when(c("event_id") % 3 == 1, "").otherwise("x.pdf"))),
    "event_id % 3 < 2",
)
scalar("E18_score_name", "part", "p_partkey", lambda: tx.score_name(F.concat_ws(" ", "p_name", "p_type"), "part", {"small": 5, "large": 10, "promo": -5}), "CASE WHEN contains(lower(p_name || ' ' || p_type), 'part') THEN 20 + CASE WHEN contains(lower(p_name || ' ' || p_type), 'small') THEN 5 ELSE 0 END + CASE WHEN contains(lower(p_name || ' ' || p_type), 'large') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_name || ' ' || p_type), 'promo') THEN -5 ELSE 0 END ELSE -1 END")
scalar("E19_format_bytes", "documents", "doc_id", lambda: tx.format_bytes(c("n_chars")), "CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024.0) ELSE printf('%.1f MB', n_chars / 1048576.0) END")
_OCR = "'<::a' || chr(10) || 'b::> ' || text || chr(10) || chr(10) || chr(10) || chr(10)"
scalar(
    "E20_clean_ocr", "documents", "doc_id", lambda: F.md5(tx.clean_ocr_text(F.concat(F.lit("<::a\nb::> "), "text", F.lit("\n\n\n\n")))),
    f"md5(regexp_replace(regexp_replace(regexp_replace({_OCR}, '(?s)<::.*?::>', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g'))",
)
scalar(
    "E20_fix_ligatures", "documents", "doc_id", lambda: F.md5(tx.fix_ligatures(F.concat(F.lit("\ufb01n \\\\( 5 \\\\times 3^{2} \\\\) N^{circ}".replace("\\\\", "\\")), "text"))),
    "md5('fin 5 × 3^2 N°' || text)",
)
scalar(
    "E20_fix_spacing", "documents", "doc_id", lambda: F.md5(tx.fix_spacing(F.concat(F.lit("caso.1.2. ALCANCELa obra 2 ANEXO x# y"), F.md5("text")))),
    "md5('caso.' || chr(10) || chr(10) || '1.2. ALCANCE' || chr(10) || chr(10) || 'La obra' || chr(10) || chr(10) || 'ANEXO x' || chr(10) || chr(10) || '# y' || md5(text))",
)
scalar("E21_normalize_for_clustering", "documents", "doc_id", lambda: F.md5(tx.normalize_for_clustering(c("text"))), "md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}', 'DATE', 'g'), '[0-9]{1,2}:[0-9]{2}', 'TIME', 'g'), '[0-9]{1,4}', 'N', 'g')))")
_MARKS = ["Página {} de 99", "Hoja {} de 9", "Sheet {} of 9", "- Página {} -", "pág.{}", "PAGE {}", "folio {}", "{}", "page {} de 9", "Hoja {} x", "– PÁG {} —"]  # the first six and the last are page numbers


def _mark() -> Column:
    out = F.lit(None).cast("string")
    for i, form in enumerate(_MARKS):
        out = F.when(c("p_partkey") % 12 == i, F.format_string(form.replace("{}", "%s"), c("p_size").cast("string"))).otherwise(out)
    return out


scalar("E22_is_page_number", "part", "p_partkey", lambda: tx.is_page_number(_mark()), "p_partkey % 12 < 6 OR p_partkey % 12 = 10")
scalar("E23_slugify", "part", "p_partkey", lambda: tx.slugify(c("p_name"), 20), "substr(replace(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' ', '_'), 1, 20)")
scalar("E24_format_ts", "events", "event_id", lambda: tx.format_ts(F.when(c("event_id") % 3 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), "America/Lima"), "CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(ts - INTERVAL 5 HOUR, '%d/%m/%Y %H:%M') END")
scalar("E26_row_hash", "part", "p_partkey", lambda: tx.row_hash(c("p_name"), c("p_brand"), c("p_size")), "sha256(p_name || chr(1) || p_brand || chr(1) || p_size)")
scalar("E27_hard_soft", "documents", "doc_id", lambda: tx.hard_soft(c("text"), ["must", "than"], ["prefer", "tion"]), f"CASE WHEN regexp_matches({FOLD.format('text')}, 'prefer|tion') THEN 'Soft' WHEN regexp_matches({FOLD.format('text')}, 'must|than|[0-9]') THEN 'Hard' ELSE 'Soft' END")
scalar("E29_keyword_score", "documents", "doc_id", lambda: tx.keyword_score(c("text"), ["worthless", "trash", "éaux"]), f"CAST(contains({FOLD.format('text')}, 'worthless') AS INTEGER) + CAST(contains({FOLD.format('text')}, 'trash') AS INTEGER) + CAST(contains({FOLD.format('text')}, 'eaux') AS INTEGER)")
scalar("E30_clean_description", "part", "p_partkey", lambda: tx.remove_phrases(F.concat(c("p_name"), F.lit(" or similar "), c("p_type")), ["or similar"]), "trim(regexp_replace(p_name || '  ' || p_type, '\\s+', ' ', 'g'))")
scalar("E32_strip_preamble", "part", "p_partkey", lambda: tx.strip_preamble(F.concat(F.lit("\nClaro, "), c("p_brand"), F.lit("\na continuación:\n---\n \n*** x\n"), c("p_name"))), "p_name")
scalar("E32_strip_marker_section", "part", "p_partkey", lambda: tx.strip_marker_section(F.concat("p_name", F.when(c("p_partkey") % 2 == 0, "\n \n## Cronograma (ficha SEACE)\nx").otherwise(" \n"))), "p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || chr(10) END")
scalar("E33_doc_label", "orders", "o_orderkey", lambda: tx.doc_label(F.when(c("o_orderkey") % 2 == 0, c("o_orderpriority")), F.when(c("o_orderkey") % 3 == 0, c("o_orderstatus")), F.md5(c("o_orderkey").cast("string"))), "CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus || ' · ' || o_orderpriority WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) END")


@query("E34_diff_risk", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 3 >= 0.20 OR l_tax * 2 >= 0.12 THEN 'high' WHEN l_discount * 3 >= 0.05 OR l_tax * 2 >= 0.03 OR l_linenumber * 4 >= 20 THEN 'medium' WHEN l_discount * 3 >= 0.005 OR l_linenumber > 1 THEN 'low' ELSE 'none' END AS out FROM lineitem""")
def e34(spark, sf_dir):
    regions = F.when(c("l_linenumber") > 1, c("l_linenumber") * 4).otherwise(0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tx.diff_risk(c("l_discount") * 3, c("l_tax") * 2, regions).alias("out"))


FEED_SQL = f"""feed AS (SELECT o_orderkey AS id, o_custkey AS entity_id, o_orderpriority AS nkey,
  CASE o_orderstatus WHEN 'F' THEN '{ANALYZED}' WHEN 'P' THEN '{DOWNLOADED}' ELSE '{PUBLISHED}' END AS status,
  CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE -1 END AS progress,
  o_orderdate AS first_seen, o_totalprice AS amount, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS promoted_at FROM orders)"""
DECISIONS_SQL = "decisions AS (SELECT 't1' AS tenant_id, o_orderkey AS feed_item_id, CASE WHEN o_orderkey % 35 = 0 THEN 'exempt' ELSE 'autorejected' END AS decision FROM orders WHERE o_orderkey % 7 = 0)"
OVERLAY_SQL = f"WITH {FEED_SQL}, {DECISIONS_SQL}, rejected AS (SELECT feed.id FROM feed LEFT JOIN decisions ON feed.id = feed_item_id WHERE coalesce(decision, status) = 'autorejected')"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    s = c("o_orderstatus")
    return o.select(
        c("o_orderkey").alias("id"), c("o_custkey").alias("entity_id"), c("o_orderpriority").alias("nkey"),
        F.when(s == "F", ANALYZED).when(s == "P", DOWNLOADED).otherwise(PUBLISHED).alias("status"),
        F.when(s == "F", 2).when(s == "P", 1).otherwise(-1).alias("progress"),
        c("o_orderdate").alias("first_seen"), c("o_totalprice").alias("amount"), F.when(s != "O", c("o_orderdate")).alias("promoted_at"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0")
    return o.select(F.lit("t1").alias("tenant_id"), c("o_orderkey").alias("feed_item_id"), F.when(c("o_orderkey") % 35 == 0, "exempt").otherwise(fd.REJECTED).alias("decision"))


@query("J04", OVERLAY_SQL + """, kept AS (SELECT * FROM feed WHERE id NOT IN (SELECT id FROM rejected)),
  best AS (SELECT *, row_number() OVER (PARTITION BY entity_id, upper(nkey) ORDER BY progress DESC, id DESC) AS n FROM kept)
  SELECT id, entity_id, nkey, status, amount FROM best WHERE n = 1""")
def j04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the preferred item of each business key among those not rejected for the tenant."""
    kept = fd.not_rejected(feed(spark, sf_dir), decisions(spark, sf_dir), "t1")
    best = fd.preferred(kept.withColumn("key", tx.normalize_key(c("nkey"))), ["entity_id", "key"], [F.desc("progress"), F.desc("id")])
    return best.select("id", "entity_id", "nkey", "status", "amount")


@query("J04_effective_rejected", OVERLAY_SQL + " SELECT id FROM rejected")
def j04_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.effective_rejected(feed(spark, sf_dir), decisions(spark, sf_dir), "t1")


@query("F01_date_filter", f"WITH {FEED_SQL} SELECT id FROM feed WHERE year(coalesce(promoted_at, first_seen)) = 2024")
def f01(spark, sf_dir):
    return fd.date_filter(feed(spark, sf_dir), "promoted_at", "first_seen", "year", now()).select("id")


def _part_fields() -> dict[str, Column]:
    return {"objeto": F.col("p_name"), "descripcion": F.col("p_type"), "marca": F.col("p_brand")}


def _word(field: str, word: str) -> str:
    return f"regexp_matches(lower({field}), '(^|[^a-z0-9]){word}([^a-z0-9]|$)')"


_BOTH = "(p_name || ' ' || p_type)"


@query("F02_match_query", f"SELECT p_partkey FROM part WHERE ({_word('p_type', 'promo')} OR {_word('p_type', 'small')}) AND NOT {_word(_BOTH, 'brass')}")
def f02(spark, sf_dir):
    rule = "descripcion:(promo OR small) -brass"
    return table(spark, sf_dir, "part").filter(rules.match_query(rule, _part_fields(), ["objeto", "descripcion"])).select("p_partkey")


@query("F04_by_status", f"WITH {FEED_SQL} SELECT id, status FROM feed WHERE status IN ('{ANALYZED}', '{PUBLISHED}') AND promoted_at IS NULL")
def f04(spark, sf_dir):
    return fd.by_status(feed(spark, sf_dir), [ANALYZED, PUBLISHED], "feed_pure").select("id", "status")


@query("F05_listing_filter", f"WITH {FEED_SQL} SELECT id FROM feed WHERE status = '{PUBLISHED}' AND nkey = '1-URGENT' AND entity_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def f05(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("entity_id"))
    return ls.listing_filter(feed(spark, sf_dir), PUBLISHED, wanted, "1-URGENT", [ANALYZED, DOWNLOADED, PUBLISHED], column="nkey").select("id")


@query("F06_exclude_ids", OVERLAY_SQL + " SELECT id FROM feed WHERE id NOT IN (SELECT id FROM rejected)")
def f06(spark, sf_dir):
    seen = decisions(spark, sf_dir).filter(c("decision") == fd.REJECTED).select(c("feed_item_id").alias("id"))
    return fd.exclude_ids(feed(spark, sf_dir), seen).select("id")


@query("F07_due_for_refresh", f"""SELECT event_id FROM events WHERE CASE WHEN event_id % 11 = 0 THEN TRUE ELSE
  epoch(date_trunc('second', ts)) < epoch(TIMESTAMP '{NOW}') - CASE WHEN abs(epoch(date_trunc('second', ts + INTERVAL 1 DAY)) - epoch(TIMESTAMP '{NOW}')) <= 172800
    OR event_id % 5 = 0 AND abs(epoch(date_trunc('second', ts - INTERVAL 90 DAY)) - epoch(TIMESTAMP '{NOW}')) <= 172800 THEN 2700 ELSE 10800 END END""")
def f07(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(c("event_id") % 11 != 0, c("ts")).alias("checked"), (c("ts") + F.expr("INTERVAL 1 DAY")).alias("deadline"),
        F.when(c("event_id") % 5 == 0, c("ts") - F.expr("INTERVAL 90 DAY")).alias("queries"),
    )
    return fd.due_for_refresh(e, now(), "checked", ["queries", "deadline"]).select("event_id")


@query("F08_stale", f"SELECT event_id FROM events WHERE epoch(date_trunc('second', ts)) < epoch(TIMESTAMP '{NOW}') - 86400")
def f08(spark, sf_dir):
    return fd.stale(table(spark, sf_dir, "events"), "ts", now(), 86_400).select("event_id")


_BYTES = "CASE WHEN l_linenumber % 7 = 6 THEN 0 ELSE CAST(l_quantity AS BIGINT) * 1050000 END"


@query("F12_batch_limits", f"""SELECT CAST(l_partkey * 4 + l_linenumber % 4 AS BIGINT) AS batch, count(*) AS files, CAST(sum({_BYTES}) AS BIGINT) AS bytes,
  CASE WHEN count(*) > 8 THEN 'too many files' WHEN sum({_BYTES}) <= 0 THEN 'empty batch' WHEN min({_BYTES}) <= 0 THEN 'empty file'
  WHEN max({_BYTES}) > 52428800 THEN 'file too large' WHEN sum({_BYTES}) > 50331648 THEN 'batch too large' ELSE 'ok' END AS reason FROM lineitem GROUP BY 1""")
def f12(spark, sf_dir):
    size = F.when(c("l_linenumber") % 7 == 6, F.lit(0).cast("long")).otherwise(c("l_quantity").cast("long") * 1_050_000)
    batch = (c("l_partkey") * 4 + c("l_linenumber") % 4).cast("long")
    return ls.batch_limits(table(spark, sf_dir, "lineitem").select(batch.alias("batch"), size.alias("size")), "batch", "size")


@query("J01_with_entity", f"WITH {FEED_SQL} SELECT id, c_name, c_mktsegment FROM feed LEFT JOIN customer ON entity_id = c_custkey")
def j01(spark, sf_dir):
    e = table(spark, sf_dir, "customer").select(c("c_custkey").alias("entity_id"), "c_name", "c_mktsegment")
    return ls.with_entity(feed(spark, sf_dir), e).select("id", "c_name", "c_mktsegment")


@query("J01_with_analysis", f"""WITH {FEED_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS n FROM lineitem WHERE l_returnflag = 'R')
  SELECT id, l_linenumber AS version, l_linenumber IS NOT NULL AS has_analysis FROM feed LEFT JOIN (SELECT * FROM a WHERE n = 1) ON id = l_orderkey""")
def j01_analysis(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("version"))
    return ls.with_analysis(feed(spark, sf_dir), a, "id", [F.desc("version")]).select("id", "version", "has_analysis")


@query("J02_find_by_ref", "SELECT l.l_orderkey, l.l_linenumber, o.o_custkey FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus")
def j02(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), c("o_orderstatus").alias("l_linestatus"), "o_custkey")
    return ls.find_by_ref(table(spark, sf_dir, "lineitem"), o, ["l_orderkey", "l_linestatus"], "o_custkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("J03_match_business_key", f"""WITH {FEED_SQL}, b AS (SELECT entity_id, upper(nkey) AS k, max_by(id, (progress, id)) AS other FROM feed WHERE progress >= 0 OR id % 3 = 0 GROUP BY ALL)
  SELECT id, other FROM feed a JOIN b ON a.entity_id = b.entity_id AND upper(a.nkey) = b.k WHERE id <> other""")
def j03(spark, sf_dir):
    f = feed(spark, sf_dir)
    return ls.match_business_key(f, f.filter("progress >= 0 OR id % 3 = 0"), "entity_id", "nkey", "id", [F.desc("progress"), F.desc("id")])


@query("J05_active_entities", f"WITH {FEED_SQL} SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT entity_id FROM feed WHERE status = '{PUBLISHED}')")
def j05(spark, sf_dir):
    items = feed(spark, sf_dir).withColumnRenamed("entity_id", "c_custkey")
    return ls.active_entities(items, table(spark, sf_dir, "customer"), "c_custkey", [PUBLISHED]).select("c_custkey", "c_name")


@query("J06_orphan_decisions", f"WITH {DECISIONS_SQL} SELECT feed_item_id FROM decisions WHERE feed_item_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def j06(spark, sf_dir):
    return ls.orphan_decisions(decisions(spark, sf_dir), feed(spark, sf_dir).filter(c("status") == ANALYZED)).select("feed_item_id")


@query("J07_first_matching_rule", f"SELECT p_partkey, CASE WHEN {_word('p_type', 'promo')} THEN 'r1' WHEN {_word(_BOTH, 'steel')} THEN 'r2' WHEN {_word('p_brand', '11')} THEN 'r3' END AS rule FROM part")
def j07(spark, sf_dir):
    found = rules.first_matching_rule([("r1", "descripcion:promo"), ("r2", "steel"), ("r3", 'marca:"11"')], _part_fields(), ["objeto", "descripcion"])
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("rule"))


SNAPSHOTS_SQL = """old AS (SELECT user_id, event_type, max_by(value, ts) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 10 <> 1 GROUP BY ALL),
  new AS (SELECT user_id, event_type, max_by(value, ts) AS value FROM events WHERE ts < TIMESTAMP '2024-01-30' AND user_id % 10 <> 0 GROUP BY ALL)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    last = lambda df: df.groupBy("user_id", "event_type").agg(F.max_by("value", "ts").alias("value"))
    return last(e.filter("ts < TIMESTAMP '2024-01-15' AND user_id % 10 <> 1")), last(e.filter("ts < TIMESTAMP '2024-01-30' AND user_id % 10 <> 0"))


@query("J08_diff_join", f"""WITH {SNAPSHOTS_SQL} SELECT user_id, event_type, old.value AS old_value, new.value AS new_value,
  CASE WHEN old.user_id IS NULL THEN 'added' WHEN new.user_id IS NULL THEN 'removed' WHEN old.value IS NOT DISTINCT FROM new.value THEN 'same' ELSE 'modified' END AS kind
  FROM old FULL JOIN new USING (user_id, event_type)""")
def j08(spark, sf_dir):
    return fd.diff_join(*snapshots(spark, sf_dir), ["user_id", "event_type"], ["value"])


@query("C05_changelog", f"""WITH {SNAPSHOTS_SQL}, d AS (SELECT user_id, event_type, round(old.value * 100) AS o, round(new.value * 100) AS n, old.user_id AS a, new.user_id AS b FROM old FULL JOIN new USING (user_id, event_type))
  SELECT user_id, event_type, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'modified' END AS kind,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'value' END AS field, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN coalesce(CAST(CAST(o AS BIGINT) AS VARCHAR), '—') END AS old,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN coalesce(CAST(CAST(n AS BIGINT) AS VARCHAR), '—') END AS new FROM d WHERE a IS NULL OR b IS NULL OR o IS DISTINCT FROM n""")
def c05(spark, sf_dir):
    old, new = (s.withColumn("value", F.round(c("value") * 100).cast("bigint")) for s in snapshots(spark, sf_dir))
    return fd.changelog(old, new, ["user_id", "event_type"], ["value"])


@query("C01_changed_rows", f"WITH {SNAPSHOTS_SQL} SELECT CASE WHEN old.user_id IS NULL THEN 'new' WHEN old.value = new.value THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM new LEFT JOIN old USING (user_id, event_type) GROUP BY 1")
def c01(spark, sf_dir):
    old, new = (s.withColumn("hash", tx.row_hash(c("value"))) for s in snapshots(spark, sf_dir))
    change = F.when(c("old_hash").isNull(), "new").when(c("old_hash") == c("new_hash"), "same").otherwise("changed")
    return fd.diff_join(old, new, ["user_id", "event_type"], ["hash"]).filter("new_hash IS NOT NULL").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("M01_upsert_feed", f"""WITH {SNAPSHOTS_SQL} SELECT user_id, event_type, CASE WHEN new.user_id IS NULL THEN 'keep' WHEN old.user_id IS NULL THEN 'insert' WHEN old.value IS DISTINCT FROM new.value THEN 'update' ELSE 'touch' END AS action,
  CASE WHEN new.user_id IS NULL THEN old.value ELSE new.value END AS value FROM old FULL JOIN new USING (user_id, event_type)""")
def m01(spark, sf_dir):
    old, new = (s.withColumn("digest", tx.row_hash(c("value"))) for s in snapshots(spark, sf_dir))
    key = ["user_id", "event_type"]
    nxt, actions = fd.upsert_feed(old, new, key, "digest", ["value"], [F.asc("value")])
    return nxt.join(actions, key).select(*key, "action", "value")


@query("M03_upsert_decisions", f"""WITH {DECISIONS_SQL}, raw AS (SELECT 't1' AS tenant_id, l_orderkey AS feed_item_id, l_linenumber AS n,
    CASE WHEN (l_orderkey + l_linenumber) % 4 = 0 THEN 'exempt' WHEN l_linenumber % 3 = 0 THEN 'pending' ELSE 'autorejected' END AS decision FROM lineitem WHERE l_orderkey % 5 = 0),
  new AS (SELECT tenant_id, feed_item_id, max_by(decision, n) AS last, max_by(decision, n) FILTER (decision <> 'autorejected') AS other FROM raw GROUP BY ALL)
  SELECT tenant_id, feed_item_id, CASE WHEN last = 'autorejected' AND coalesce(other, d.decision) = 'exempt' THEN 'exempt' ELSE coalesce(last, d.decision) END AS decision FROM decisions d FULL JOIN new USING (tenant_id, feed_item_id)""")
def m03(spark, sf_dir):
    line, item = c("l_linenumber"), c("l_orderkey")
    decision = F.when((item + line) % 4 == 0, "exempt").when(line % 3 == 0, "pending").otherwise(fd.REJECTED)
    new = table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 = 0").select(F.lit("t1").alias("tenant_id"), item.alias("feed_item_id"), line.alias("n"), decision.alias("decision"))
    return fd.upsert_decisions(decisions(spark, sf_dir), new, "n")


@query("M04_promote", f"WITH {FEED_SQL} SELECT id, coalesce(promoted_at, CASE WHEN id % 3 = 0 THEN TIMESTAMP '{NOW}' END) AS promoted_at FROM feed")
def m04(spark, sf_dir):
    items = feed(spark, sf_dir)
    return fd.promote(items, items.filter("id % 3 = 0").select("id"), now()).select("id", "promoted_at")


@query("M06_sync_catalog", """WITH k AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0),
  r AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 4 = 1 THEN lower(s_name) ELSE upper(s_name) END AS name, CASE WHEN s_suppkey % 4 = 1 THEN s_acctbal < 5000 ELSE s_acctbal > 0 END AS active FROM supplier WHERE s_suppkey % 5 <> 0)
  SELECT id, coalesce(nullif(r.name, ''), k.name) AS name, CASE WHEN k.name IS NULL THEN 'added' WHEN r.name IS NULL THEN 'kept' ELSE 'updated' END AS action FROM k FULL JOIN r USING (id) WHERE k.name IS NOT NULL OR active""")
def m06(spark, sf_dir):
    """Every fourth supplier has a second row later in the catalog, which counts."""
    s, k = table(spark, sf_dir, "supplier"), c("s_suppkey")
    known = s.filter("s_suppkey % 2 = 0").select(k.alias("id"), c("s_name").alias("name"))
    name = lambda case: F.when(k % 3 == 0, "").otherwise(case("s_name")).alias("name")
    first = s.filter("s_suppkey % 5 <> 0").select(k.alias("id"), name(F.upper), (c("s_acctbal") > 0).alias("active"), F.lit(1).alias("n"))
    again = s.filter("s_suppkey % 5 <> 0 AND s_suppkey % 4 = 1").select(k.alias("id"), name(F.lower), (c("s_acctbal") < 5000).alias("active"), F.lit(2).alias("n"))
    return fd.sync_catalog(known, again.unionByName(first), "id", ["name"], "active", "n")


@query("M09_backfill_defaults", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'none' ELSE p_brand END AS brand FROM part")
def m09(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(c("p_size") % 4 != 0, c("p_brand")).alias("brand"))
    return fd.backfill_defaults(p, {"brand": "none"})


@query("M11_recover_transitions", f"WITH {FEED_SQL} SELECT id, CASE WHEN status = '{DOWNLOADED}' AND first_seen < TIMESTAMP '2022-01-01' THEN CASE WHEN id % 2 = 0 THEN '{ANALYZED}' ELSE '{PUBLISHED}' END ELSE status END AS next_status FROM feed")
def m11(spark, sf_dir):
    items = feed(spark, sf_dir).withColumn("has_file", c("id") % 2 == 0)
    return fd.recover_transitions(items, "status", "has_file", "first_seen", F.lit("2022-01-02").cast("timestamp"), 86_400, {DOWNLOADED: (ANALYZED, PUBLISHED)}).select("id", "next_status")


@query("J10_backfill_link", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE o_custkey END AS link FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def j10(spark, sf_dir):
    child = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(c("l_linenumber") % 2 == 0, c("l_suppkey")).alias("link"))
    return fd.backfill_link(child, table(spark, sf_dir, "orders").select(c("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "link", "o_custkey")


@query("G01_status_counts", OVERLAY_SQL + f""", s AS (SELECT unnest(['{ANALYZED}', '{DOWNLOADED}', '{PUBLISHED}', 'autorejected', 'archivada']) AS status),
  n AS (SELECT CASE WHEN id IN (SELECT id FROM rejected) THEN 'autorejected' ELSE status END AS status, count(*) AS n FROM feed GROUP BY 1) SELECT status, coalesce(n, 0) AS n FROM s LEFT JOIN n USING (status)""")
def g01(spark, sf_dir):
    return fd.status_counts(feed(spark, sf_dir), decisions(spark, sf_dir), "t1", [ANALYZED, DOWNLOADED, PUBLISHED, fd.REJECTED, "archivada"])


@query("G02_badges", f"WITH {FEED_SQL} SELECT entity_id, count_if(status = '{ANALYZED}') AS ready, count_if(promoted_at IS NULL) AS unread FROM feed GROUP BY entity_id")
def g02(spark, sf_dir):
    return ls.badges(feed(spark, sf_dir), ["entity_id"], c("promoted_at").isNull(), c("status") == ANALYZED)


@query("G04_facets", "SELECT 'c_mktsegment' AS facet, c_mktsegment AS value FROM customer GROUP BY 2 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer GROUP BY 2")
def g04(spark, sf_dir):
    return ls.facets(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"])


@query("G05_multi_counts", """SELECT 'l_returnflag' AS dim, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2""")
def g05(spark, sf_dir):
    return cp.multi_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("G07_dominant", """WITH n AS (SELECT source, lang, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS k FROM n) SELECT source, lang, n FROM r WHERE k = 1""")
def g07(spark, sf_dir):
    return cp.dominant(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id")


@query("G08_median_area", "WITH m AS (SELECT source, median(n_chars) AS median FROM documents GROUP BY source) SELECT doc_id, median, CASE WHEN median = 0 THEN 1.0 ELSE n_chars / median END AS ratio FROM documents JOIN m USING (source)")
def g08(spark, sf_dir):
    return ls.median_ratio(table(spark, sf_dir, "documents"), ["source"], "n_chars").select("doc_id", "median", "ratio")


LINES_SQL = """lines AS (SELECT source, doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(l), '\\s+', ' ', 'g'), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}', 'DATE', 'g'), '[0-9]{1,2}:[0-9]{2}', 'TIME', 'g'), '[0-9]{1,4}', 'N', 'g')) AS norm
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) >= 2)"""
NOISE_SQL = f"""WITH {LINES_SQL}, t AS (SELECT source, count(DISTINCT doc_id) AS total FROM lines GROUP BY source),
  noise AS (SELECT source, norm, count(DISTINCT doc_id) AS pages, any_value(total) AS total FROM lines JOIN t USING (source) GROUP BY source, norm HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.1 * any_value(total))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cp.doc_lines(table(spark, sf_dir, "documents"), ["source", "doc_id"]).withColumn("norm", tx.normalize_for_clustering(c("line")))


@query("G09_repeated_lines", NOISE_SQL + " SELECT source, md5(norm) AS norm, pages, total FROM noise")
def g09(spark, sf_dir):
    found = cp.page_repeats(table(spark, sf_dir, "documents"), "source", "text", tx.normalize_for_clustering, 0.1, 5)
    return found.select("source", F.md5("norm").alias("norm"), "pages", "total")


@query("G09_line_report", NOISE_SQL + """, f AS (SELECT DISTINCT source, norm, doc_id FROM lines), p AS (SELECT source, norm, list(doc_id ORDER BY doc_id)[1:10] AS first_pages FROM f GROUP BY ALL)
  SELECT source, md5(norm) AS norm, CASE WHEN regexp_matches(norm, '^N$') THEN 'PAGE_NUMBER' ELSE 'TEXT_REPEAT' END AS category, pages, total, array_to_string(first_pages, ',') AS first_pages FROM noise JOIN p USING (source, norm)""")
def g09_report(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    found = cp.line_report(lines, ["source"], "doc_id", "norm", "line", c("line").rlike("^[0-9]{1,4}$"), 0.1, 5)
    return found.select("source", F.md5("norm").alias("norm"), "category", "pages", "total", F.array_join(F.transform("first_pages", lambda x: x.cast("string")), ",").alias("first_pages"))


@query("J13_filter_noise", NOISE_SQL + " SELECT doc_id, count(*) AS kept FROM lines l WHERE NOT EXISTS (SELECT 1 FROM noise n WHERE n.source = l.source AND n.norm = l.norm) GROUP BY doc_id")
def j13(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    noise = cp.page_repeats(d, "source", "text", tx.normalize_for_clustering, 0.1, 5)
    return cp.filter_noise(_lines(spark, sf_dir), noise, ["source", "norm"]).groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("G12_page_signals", """WITH m AS (SELECT *, median(n_chars) OVER (PARTITION BY source) AS m FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN n_chars >= 1.4 * m THEN 'large' END, CASE WHEN n_chars < 200 THEN 'sparse' END, CASE WHEN contains(text, '|') THEN 'table' END) AS signals FROM m""")
def g12(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return cp.page_signals(ls.median_ratio(d, ["source"], "n_chars"), {"large": c("ratio") >= 1.4, "sparse": c("n_chars") < 200, "table": c("text").contains("|")}).select("doc_id", "signals")


COMPLIANCE_SQL = "m AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'CUMPLE' WHEN 'R' THEN 'PARCIAL' ELSE 'NO_CUMPLE' END AS result, CASE l_linestatus WHEN 'F' THEN 'Hard' ELSE 'Soft' END AS hard_soft, CASE WHEN l_linenumber % 2 = 0 THEN 'sin_info' ELSE 'otro' END AS subtype FROM lineitem)"


@query("G14_compliance_summary", f"""WITH {COMPLIANCE_SQL} SELECT l_orderkey, count_if(result = 'CUMPLE') AS met, count_if(result = 'PARCIAL') AS partly, count_if(result = 'NO_CUMPLE') AS failed,
  CASE WHEN count_if(hard_soft = 'Hard' AND result = 'NO_CUMPLE') > 0 THEN 'DESCARTADO' WHEN count_if(result = 'PARCIAL' AND subtype <> 'sin_info') > 0 THEN 'CONDICIONADO' ELSE 'VALIDO' END AS class FROM m GROUP BY l_orderkey""")
def g14(spark, sf_dir):
    flag = c("l_returnflag")
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(flag == "A", "CUMPLE").when(flag == "R", "PARCIAL").otherwise("NO_CUMPLE").alias("result"), F.when(c("l_linestatus") == "F", "Hard").otherwise("Soft").alias("hard_soft"), F.when(c("l_linenumber") % 2 == 0, "sin_info").otherwise("otro").alias("subtype"))
    return cp.compliance_summary(m, ["l_orderkey"])


SECTIONS_SQL = """sections AS (SELECT conv_id AS doc_id, turn, CASE WHEN role = 'assistant' THEN 2 ELSE 1 END AS level,
  coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS line_start, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS line_end FROM conversations)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    total = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    s = table(spark, sf_dir, "conversations").select(c("conv_id").alias("doc_id"), "turn", F.when(c("role") == "assistant", 2).otherwise(1).alias("level"), total.alias("line_end"), F.length("text").alias("_n"))
    return s.withColumn("line_start", c("line_end") - c("_n") + 1).drop("_n")


@query("G15_coverage", f"WITH {SECTIONS_SQL} SELECT doc_id, CAST(sum(line_end - line_start + 1) AS BIGINT) AS covered FROM sections GROUP BY doc_id")
def g15(spark, sf_dir):
    return cp.coverage(sections(spark, sf_dir), ["doc_id"], "line_start", "line_end")


@query("J12_range_contains", f"""WITH {SECTIONS_SQL}, s AS (SELECT doc_id, turn, level, CAST(CASE WHEN level = 1 THEN 1 ELSE line_start END AS BIGINT) AS line_start, CAST(line_end AS BIGINT) AS line_end FROM sections)
  SELECT doc_id, turn FROM s a WHERE EXISTS (SELECT 1 FROM s b WHERE a.doc_id = b.doc_id AND b.level > a.level AND b.line_start >= a.line_start AND b.line_end <= a.line_end)""")
def j12(spark, sf_dir):
    s = sections(spark, sf_dir).withColumn("line_start", F.when(c("level") == 1, F.lit(1)).otherwise(c("line_start")))
    return cp.range_contains(s).select("doc_id", "turn")


def packed_sql(atoms: str, target: int = 500, hard: int = 750, overlap: int = 50) -> str:
    """Recursive SQL of greedy packing: ``packed`` (doc_id, chunk, line_start, line_end, split) of the rows of ``atoms`` (doc_id, line_start, line_end).

    The open chunk is (ha, hl, hb): its start, the end of its last section and its farthest end.
    """
    step = target - overlap
    cuts = f"range(0, 1 + CAST(ceil(greatest(b - a + 1 - {target}, 0) / {step}.0) AS BIGINT))"
    pieces = f"list_transform({cuts}, lambda k: {{'a': a + {step} * k, 'b': least(a + {step} * k + {target - 1}, b), 'split': TRUE}})"
    held = "CASE WHEN ha IS NULL THEN [] ELSE [{'a': ha, 'b': hb, 'split': FALSE}] END"
    large = f"b - a + 1 > {hard}"
    full = f"ha IS NOT NULL AND (greatest(hl, b) - ha + 1 > {hard} OR (hl - ha + 1 >= {int(0.75 * target)} AND greatest(hl, b) - ha + 1 > {target}))"
    return f"""atoms AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start, line_end) AS i, CAST(line_start AS BIGINT) AS a, CAST(line_end AS BIGINT) AS b FROM {atoms}),
  walk AS (
    SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS ha, CAST(NULL AS BIGINT) AS hl, CAST(NULL AS BIGINT) AS hb, CAST([] AS STRUCT(a BIGINT, b BIGINT, split BOOLEAN)[]) AS done FROM atoms
    UNION ALL
    SELECT walk.doc_id, atoms.i, CASE WHEN {large} THEN NULL WHEN {full} OR ha IS NULL THEN a ELSE ha END, CASE WHEN {large} THEN NULL ELSE b END,
      CASE WHEN {large} THEN NULL WHEN {full} OR ha IS NULL THEN b ELSE greatest(b, hb) END,
      CASE WHEN {large} THEN list_concat(list_concat(done, {held}), {pieces}) WHEN {full} THEN list_concat(done, {held}) ELSE done END
    FROM walk JOIN atoms ON atoms.doc_id = walk.doc_id AND atoms.i = walk.i + 1),
  ends AS (SELECT doc_id, list_concat(done, {held}) AS done FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS last FROM walk) WHERE last = 1),
  packed AS (
    SELECT doc_id, CAST(k AS INTEGER) AS chunk, done[k].a AS line_start, done[k].b AS line_end, done[k].split AS split
    FROM (SELECT *, unnest(range(1, len(done) + 1)) AS k FROM ends))"""


@query("W11_pack_chunks", f"WITH RECURSIVE {SECTIONS_SQL}, {packed_sql('sections')} SELECT doc_id, chunk, line_start, line_end, split FROM packed")
def w11(spark, sf_dir):
    return cp.pack_chunks(sections(spark, sf_dir), "doc_id")


@query("W01_preferred_claimed", f"WITH {FEED_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id, upper(nkey) ORDER BY progress DESC, id DESC) AS n FROM feed WHERE status <> '{PUBLISHED}') SELECT entity_id, nkey, id FROM r WHERE n = 1")
def w01(spark, sf_dir):
    f = feed(spark, sf_dir).filter(c("status") != PUBLISHED).withColumn("key", tx.normalize_key(c("nkey")))
    return fd.preferred(f, ["entity_id", "key"], [F.desc("progress"), F.desc("id")]).select("entity_id", "nkey", "id")


@query("W02_preferred_published", f"{OVERLAY_SQL} SELECT entity_id, nkey, max(id) AS id FROM feed WHERE status = '{PUBLISHED}' AND promoted_at IS NULL AND id NOT IN (SELECT id FROM rejected) GROUP BY entity_id, nkey")
def w02(spark, sf_dir):
    return ls.preferred_published(fd.with_overlay(feed(spark, sf_dir), decisions(spark, sf_dir), "t1"), ["entity_id", "nkey"], PUBLISHED)


@query("W04_dedupe_keep_first", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) SELECT l_partkey, l_orderkey, l_linenumber FROM r WHERE n = 1")
def w04(spark, sf_dir):
    return fd.preferred(table(spark, sf_dir, "lineitem"), ["l_partkey"], [F.asc("l_orderkey"), F.asc("l_linenumber")]).select("l_partkey", "l_orderkey", "l_linenumber")


@query("W05_append_rank", f"WITH {FEED_SQL}, l AS (SELECT entity_id, count(*) AS n FROM feed WHERE status = '{ANALYZED}' GROUP BY 1) SELECT id, coalesce(n, 0) + row_number() OVER (PARTITION BY entity_id ORDER BY id) AS list_rank FROM feed LEFT JOIN l USING (entity_id) WHERE status = '{DOWNLOADED}'")
def w05(spark, sf_dir):
    items = feed(spark, sf_dir)
    listed = fd.renumber(items.filter(c("status") == ANALYZED), ["entity_id"], [F.asc("id")])
    return fd.append_rank(listed, items.filter(c("status") == DOWNLOADED), ["entity_id"], "list_rank", [F.asc("id")]).select("id", "list_rank")


@query("W06_renumber", f"WITH {FEED_SQL} SELECT id, CAST(row_number() OVER (PARTITION BY status, entity_id ORDER BY amount, id) AS INTEGER) AS list_rank FROM feed")
def w06(spark, sf_dir):
    return fd.renumber(feed(spark, sf_dir), ["status", "entity_id"], [F.asc("amount"), F.asc("id")]).select("id", "list_rank")


ISLANDS_SQL = "p AS (SELECT DISTINCT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS d FROM events), g AS (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS k FROM p)"


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("d")).distinct()


@query("W08_contiguous_ranges", f'WITH {ISLANDS_SQL} SELECT user_id, min(d) AS "start", max(d) AS "end" FROM g GROUP BY user_id, k')
def w08(spark, sf_dir):
    return cp.contiguous_ranges(_days(spark, sf_dir), ["user_id"], "d")


@query("W09_long_runs", f'WITH {ISLANDS_SQL} SELECT user_id, min(d) AS "start", max(d) AS "end" FROM g GROUP BY user_id, k HAVING count(*) > 5')
def w09(spark, sf_dir):
    return cp.long_runs(_days(spark, sf_dir), ["user_id"], "d", 5)


@query("W13_fixed_windows", 'SELECT doc_id, CAST("start" AS INTEGER) AS "start", CAST(least("start" + 199, n_chars) AS INTEGER) AS "end" FROM (SELECT doc_id, n_chars, unnest(range(1, n_chars + 1, 150)) AS "start" FROM documents)')
def w13(spark, sf_dir):
    return cp.fixed_windows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars").select("doc_id", "start", "end")


@query("W16_top_k", "WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS place FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, place FROM r WHERE place <= 10")
def w16(spark, sf_dir):
    return fd.top_k(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 10).select("l_suppkey", "l_orderkey", "l_linenumber", "place")


@query("S01_sort_listing", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END, s_acctbal DESC, lower(s_name), s_suppkey) AS INTEGER) AS position FROM supplier")
def s01(spark, sf_dir):
    return fd.sort_listing(table(spark, sf_dir, "supplier"), c("s_acctbal") < 0, F.desc("s_acctbal"), F.lower("s_name"), c("s_suppkey")).select("s_suppkey", "position")


@query("S03_recent", OVERLAY_SQL + " SELECT id, first_seen FROM feed WHERE id NOT IN (SELECT id FROM rejected) ORDER BY first_seen DESC, id DESC LIMIT 10")
def s03(spark, sf_dir):
    return fd.recent(fd.not_rejected(feed(spark, sf_dir), decisions(spark, sf_dir), "t1")).select("id", "first_seen")


@query("U01_selection_diff", "SELECT o_custkey AS id, 'added' AS kind FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT o_custkey, 'removed' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def u01(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("id"), "o_orderstatus")
    return fd.selection_diff(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), "id")


@query("B01_consolidate_variants", "SELECT p_type, p_brand, max_by(p_name, (length(p_name), p_name)) AS description, CAST(max(CAST(p_size AS VARCHAR)) AS VARCHAR) AS quantity, string_agg(DISTINCT CAST(p_partkey % 4 AS VARCHAR), ',' ORDER BY CAST(p_partkey % 4 AS VARCHAR)) AS variants FROM part GROUP BY p_type, p_brand")
def b01(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("q", c("p_size").cast("string")).withColumn("v", c("p_partkey") % 4)
    return cp.consolidate_variants(p, ["p_type", "p_brand"], "p_name", "q", "v")


CANDIDATES_SQL = "cand AS (SELECT DISTINCT l_partkey AS item_id, l_suppkey AS pos, CASE WHEN l_suppkey % 3 = 0 THEN 'VALIDO' WHEN l_suppkey % 3 = 1 AND l_partkey % 2 = 0 THEN 'CONDICIONADO' ELSE 'DESCARTADO' END AS class FROM lineitem)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = c("l_suppkey")
    kind = F.when(s % 3 == 0, "VALIDO").when((s % 3 == 1) & (c("l_partkey") % 2 == 0), "CONDICIONADO").otherwise("DESCARTADO")
    return table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("item_id"), s.alias("pos"), kind.alias("class")).distinct()


@query("B03_consolidate", f"""WITH {CANDIDATES_SQL}, g AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) AS INTEGER) AS n FROM cand WHERE class <> 'DESCARTADO')
  SELECT p_partkey AS item_id, coalesce(n, 0) AS candidate, coalesce(class, 'SIN_CANDIDATO') AS state, CASE WHEN class IS NOT NULL THEN '' WHEN p_partkey % 5 = 0 THEN '{cp.NO_RESULT}' WHEN p_partkey % 3 = 0 THEN p_type ELSE '{cp.NO_CANDIDATE}' END AS notes
  FROM part LEFT JOIN g ON p_partkey = item_id WHERE p_size > 5 UNION ALL SELECT p_partkey, 0, 'SERVICIO', '{cp.NO_SEARCH}' FROM part WHERE p_size <= 5""")
def b03(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("item_id", c("p_partkey"))
    results = p.filter("p_partkey % 5 <> 0").select("item_id", F.when(c("item_id") % 3 == 0, c("p_type")).alias("diagnosis"))
    return cp.consolidate(p.filter("p_size > 5").select("item_id"), candidates(spark, sf_dir), ["VALIDO", "CONDICIONADO"], results, p.filter("p_size <= 5"))


@query("B08_inherit_deep", """WITH bom AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 40 > 0 THEN p_partkey - 1 END AS parent_id FROM part), up AS (SELECT a.p_partkey AS item_id, b.p_partkey AS source, a.p_partkey - b.p_partkey AS distance, b.p_brand AS text, b.p_size % 3 AS kind FROM part a JOIN part b ON a.p_partkey // 40 = b.p_partkey // 40 AND a.p_partkey >= b.p_partkey),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY distance) AS n FROM up WHERE distance = 0 OR kind < 2), f AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance) AS k FROM r WHERE n = 1)
  SELECT item_id, text, CASE WHEN distance = 0 THEN 'DIRECTO' ELSE 'HEREDADO' END AS origin, CASE WHEN distance > 0 THEN source END AS parent, printf('R-%03d', k) AS requirement_id FROM f""")
def b08_deep(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), c("p_partkey")
    bom = p.select(k.alias("item_id"), F.when(k % 40 > 0, k - 1).alias("parent_id"))
    kinds = p.select((c("p_size") % 3).alias("kind")).filter("kind < 2")
    return cp.inherit_requirements(bom, p.select(k.alias("item_id"), c("p_brand").alias("text"), (c("p_size") % 3).alias("kind")), kinds, numbered=True)


@query("B08_inherit_requirements", """WITH RECURSIVE bom AS (SELECT p_partkey AS item_id, nullif(p_partkey // 10, 0) AS parent_id FROM part), chain AS (SELECT item_id, item_id AS source, parent_id AS next, 0 AS distance FROM bom UNION ALL SELECT chain.item_id, chain.next, bom.parent_id, distance + 1 FROM chain JOIN bom ON bom.item_id = chain.next),
  r AS (SELECT chain.item_id, p_brand AS text, distance, source, row_number() OVER (PARTITION BY chain.item_id, p_brand ORDER BY distance, source) AS n FROM chain JOIN part ON p_partkey = source)
  SELECT item_id, text, CASE WHEN distance = 0 THEN 'DIRECTO' ELSE 'HEREDADO' END AS origin, CASE WHEN distance > 0 THEN source END AS parent FROM r WHERE n = 1""")
def b08(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    bom = p.select(c("p_partkey").alias("item_id"), F.expr("nullif(p_partkey div 10, 0)").alias("parent_id"))
    return cp.inherit_requirements(bom, p.select(c("p_partkey").alias("item_id"), c("p_brand").alias("text")))


QA_SQL = f"""{CANDIDATES_SQL}, g AS (SELECT item_id, pos, class, CAST(row_number() OVER (PARTITION BY item_id ORDER BY pos) AS INTEGER) AS n FROM cand WHERE class <> 'DESCARTADO'),
  bom AS (SELECT p_partkey AS item_id, CASE WHEN p_size <= 5 THEN 'Servicios' ELSE p_type END AS grp FROM part WHERE p_partkey % 50 <> 1),
  rows AS (SELECT item_id, n AS candidate, class AS state, CASE WHEN pos % 7 = 0 THEN '' ELSE CAST(pos AS VARCHAR) END AS brand, CASE WHEN pos % 11 = 0 THEN NULL ELSE 'm' || pos END AS model, CASE WHEN pos % 13 = 0 THEN ' ' ELSE 'u' END AS url, CASE WHEN item_id % 4 = 0 THEN 'n' END AS notes, CASE WHEN pos % 5 = 0 THEN 'M' || pos END AS matrix FROM g WHERE item_id % 20 <> 3 AND NOT (n = 2 AND item_id % 6 = 0)
    UNION ALL SELECT p_partkey, p_partkey % 2, CASE WHEN p_size <= 5 THEN 'SERVICIO' ELSE 'SIN_CANDIDATO' END, '', '', '', CASE WHEN p_partkey % 4 = 0 THEN 'n' END, NULL FROM part WHERE p_partkey NOT IN (SELECT item_id FROM g) AND p_partkey % 20 <> 3),
  items AS (SELECT DISTINCT item_id FROM rows), smp AS (SELECT item_id FROM bom WHERE item_id % 3 = 0), good AS (SELECT g.*, CASE WHEN pos % 7 = 0 THEN '' ELSE CAST(pos AS VARCHAR) END AS brand, CASE WHEN pos % 11 = 0 THEN NULL ELSE 'm' || pos END AS model FROM g JOIN smp USING (item_id)),
  held AS (SELECT item_id, count_if(candidate > 0) AS h, bool_or(state = 'SIN_CANDIDATO') AS none FROM rows GROUP BY item_id), fnd AS (SELECT item_id, count(*) AS f FROM good GROUP BY item_id),
  sampled AS (SELECT item_id, coalesce(f, 0) AS f, h, none FROM smp LEFT JOIN fnd USING (item_id) LEFT JOIN held USING (item_id))"""


@query("B05_qa_findings", f"""WITH {QA_SQL}, o AS (
  SELECT 'CRITICO' AS severity, 'ITEM_FALTANTE' AS kind, CAST(item_id AS VARCHAR) AS item, '' AS detail FROM bom WHERE item_id NOT IN (SELECT item_id FROM items)
  UNION ALL SELECT 'MENOR', 'ITEM_EXTRA', CAST(item_id AS VARCHAR), '' FROM items WHERE item_id NOT IN (SELECT item_id FROM bom)
  UNION ALL SELECT 'CRITICO', 'DISCREPANCIA_CANDIDATOS', CAST(item_id AS VARCHAR), f || '/' || coalesce(h, 0) FROM sampled WHERE f > 0 AND coalesce(h, 0) <> f
  UNION ALL SELECT 'CRITICO', 'DISCREPANCIA_CANDIDATO', CAST(item_id AS VARCHAR), brand || ' ' || model FROM good x WHERE brand <> '' AND model IS NOT NULL AND NOT EXISTS (SELECT 1 FROM rows r WHERE r.candidate > 0 AND r.item_id = x.item_id AND r.brand = x.brand AND r.model = x.model)
  UNION ALL SELECT 'CRITICO', 'DISCREPANCIA_ESTADO', CAST(item_id AS VARCHAR), '' FROM sampled WHERE f = 0 AND h IS NOT NULL AND NOT coalesce(none, FALSE)
  UNION ALL SELECT 'CRITICO', 'CAMPO_VACIO', CAST(item_id AS VARCHAR), 'brand' FROM rows WHERE state IN ('VALIDO', 'CONDICIONADO') AND coalesce(brand, '') = ''
  UNION ALL SELECT 'CRITICO', 'CAMPO_VACIO', CAST(item_id AS VARCHAR), 'model' FROM rows WHERE state IN ('VALIDO', 'CONDICIONADO') AND coalesce(model, '') = ''
  UNION ALL SELECT 'MENOR', 'CAMPO_VACIO', CAST(item_id AS VARCHAR), 'url' FROM rows WHERE state IN ('VALIDO', 'CONDICIONADO') AND trim(coalesce(url, '')) = ''
  UNION ALL SELECT 'MENOR', 'SIN_DIAGNOSTICO', CAST(item_id AS VARCHAR), '' FROM rows WHERE state = 'SIN_CANDIDATO' AND notes IS NULL
  UNION ALL SELECT 'CRITICO', 'CAMPO_INCORRECTO', CAST(item_id AS VARCHAR), '' FROM rows WHERE state = 'SIN_CANDIDATO' AND candidate <> 0
  UNION ALL SELECT 'CRITICO', 'SERVICIO_FALTANTE', CAST(item_id AS VARCHAR), '' FROM bom WHERE grp = 'Servicios' AND item_id NOT IN (SELECT item_id FROM items)
  UNION ALL SELECT 'MENOR', 'ESTADO_INCORRECTO', CAST(item_id AS VARCHAR), state FROM rows WHERE state <> 'SERVICIO' AND item_id IN (SELECT item_id FROM bom WHERE grp = 'Servicios')
  UNION ALL SELECT 'CRITICO', 'TSV_FILAS', '', '7/' || (SELECT count(*) FROM rows) UNION ALL SELECT 'MENOR', 'MD_FALTANTE', '', ''
  UNION ALL SELECT 'MENOR', 'MATRIZ_FALTANTE', CAST(item_id AS VARCHAR), matrix FROM rows WHERE matrix IS NOT NULL AND CAST(substr(matrix, 2) AS INTEGER) % 2 = 1)
  SELECT severity, kind, item, detail, count(*) AS n FROM o GROUP BY ALL""")
def b05(spark, sf_dir):
    p, pos, item = table(spark, sf_dir, "part").withColumn("item_id", c("p_partkey")), c("pos"), c("item_id")
    bom = p.filter("p_partkey % 50 <> 1").select("item_id", F.when(c("p_size") <= 5, "Servicios").otherwise(c("p_type")).alias("group"))
    brand, model = F.when(pos % 7 == 0, "").otherwise(pos.cast("string")), F.when(pos % 11 != 0, F.concat(F.lit("m"), pos.cast("string")))
    found = candidates(spark, sf_dir).withColumns({"brand": brand, "model": model})
    good = cp.consolidate(found.select("item_id").distinct(), found, ["VALIDO", "CONDICIONADO"]).filter("candidate > 0").withColumnRenamed("candidate", "n").drop("state")
    numbered = fd.renumber(found.filter("class <> 'DESCARTADO'"), ["item_id"], [F.asc("pos")], "candidate").join(good.withColumnRenamed("n", "candidate"), ["item_id", "candidate"], "left_semi")
    notes = F.when(item % 4 == 0, "n")
    rows = numbered.filter("item_id % 20 <> 3 AND NOT (candidate = 2 AND item_id % 6 = 0)").select("item_id", "candidate", c("class").alias("state"), "brand", "model", F.when(pos % 13 == 0, " ").otherwise("u").alias("url"), notes.alias("notes"), F.when(pos % 5 == 0, F.concat(F.lit("M"), pos.cast("string"))).alias("matrix"))
    none = p.join(good, "item_id", "left_anti").filter("item_id % 20 <> 3")
    rows = rows.unionByName(none.select("item_id", (item % 2).cast("int").alias("candidate"), F.when(c("p_size") <= 5, "SERVICIO").otherwise("SIN_CANDIDATO").alias("state"), F.lit("").alias("brand"), F.lit("").alias("model"), F.lit("").alias("url"), notes.alias("notes"), F.lit(None).cast("string").alias("matrix")))
    matrices = found.filter(pos % 2 == 0).select(F.concat(F.lit("M"), pos.cast("string")).alias("matrix")).distinct()
    outputs = spark.createDataFrame([("TSV", "CRITICO", 7), ("MD", "MENOR", None), ("JSON", "CRITICO", rows.count())], "format string, severity string, rows long")
    checks = cp.qa_checks(bom, rows, bom.filter("item_id % 3 = 0"), found, matrices, outputs)
    return checks.groupBy("severity", "kind", "item", "detail").agg(F.count("*").alias("n"))


@query("B07_deterministic_sample", "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256(CAST(p_partkey AS VARCHAR) || 's1')) AS n FROM part) SELECT p_partkey FROM r WHERE n <= greatest((SELECT CAST(floor(0.3 * count(*)) AS BIGINT) FROM part), 20)")
def b07(spark, sf_dir):
    return cp.deterministic_sample(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "s1", 0.3, 20)


@query("D03_split_sections", "WITH l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), s AS (SELECT *, length(line) < 20 AS h, sum(CAST(length(line) < 20 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l) SELECT doc_id, CAST(k AS BIGINT) AS section, md5(coalesce(max(lower(line)) FILTER (h), '_intro')) AS title, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT h), '')) AS body FROM s GROUP BY doc_id, k")
def d03(spark, sf_dir):
    out = cp.split_sections(table(spark, sf_dir, "documents"), "doc_id", "text", r"\A[^\n]{0,19}\z")
    return out.select("doc_id", "section", F.md5("title").alias("title"), F.md5("body").alias("body"))


@query("A03_extract_links", """WITH l AS (SELECT page_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS href FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS x FROM pages)), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS n FROM l) SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM r WHERE n = 1""")
def a03(spark, sf_dir):
    return rd.extract_links(table(spark, sf_dir, "pages"))


@query("A08_union_paged", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber, l_orderkey) AS n FROM lineitem) SELECT l_partkey, l_suppkey, l_orderkey FROM r WHERE n = 1")
def a08(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("k", F.struct("l_partkey", "l_suppkey"))
    return rd.union_paged(l, "k", "l_linenumber", "l_orderkey").select("l_partkey", "l_suppkey", "l_orderkey")


@query("A09_triage", "SELECT page_id, CASE lower(regexp_extract(url || CASE WHEN page_id % 3 = 0 THEN '.PDF' WHEN page_id % 3 = 1 THEN '.docx?x=1' ELSE '/' END, '\\.([A-Za-z0-9]+)(?:[?#].*)?$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'office' ELSE 'UNKNOWN' END AS branch FROM pages")
def a09(spark, sf_dir):
    k = c("page_id") % 3
    name = F.concat("url", F.when(k == 0, ".PDF").when(k == 1, ".docx?x=1").otherwise("/"))
    return table(spark, sf_dir, "pages").select("page_id", rd.triage(name, {"pdf": "pdf", "docx": "office"}).alias("branch"))


@query("A07_parse_json_list", """WITH e AS (SELECT *, props LIKE '{%' AS own FROM events),
  r AS (SELECT event_id, 1 AS pos, trim(json_extract_string(props, '$.k')) AS k, '3' AS kind FROM e WHERE own AND event_id % 7 > 0
    UNION ALL SELECT event_id, CASE WHEN own THEN 2 ELSE 1 END, user_id || ' x', CAST(value AS VARCHAR) FROM e WHERE event_id % 7 > 0)
  SELECT event_id, CAST(pos AS INTEGER) AS pos, k, kind FROM r""")
def a07(spark, sf_dir):
    """The list of an event: its object, if any, then texts and numbers that look like one, then one with all keys; every seventh is cut off."""
    second = F.concat(F.lit('{"k": "  '), c("user_id").cast("string"), F.lit(' x ", "kind": "'), c("value").cast("string"), F.lit('"}'))
    text = F.concat(F.lit("["), F.coalesce("props", F.lit("7")), F.lit(', "{\\"k\\": 1}", 3, null, '), second, F.when(c("event_id") % 7 > 0, "]").otherwise(""))
    parsed = tx.parse_json_list(text, {"k": "", "kind": "3"})
    return table(spark, sf_dir, "events").select("event_id", F.posexplode(parsed).alias("pos", "o")).select("event_id", (c("pos") + 1).alias("pos"), "o.k", "o.kind")


@query("T03_first_last_seen", "SELECT user_id, event_type, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def t03(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: st.first_last_seen(s, ["user_id", "event_type"], "ts"), "complete")


@query("T06_status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def t06(spark, sf_dir):
    return _streamed(spark, sf_dir, lambda s: st.status_counts(s, "event_type"), "complete")


def _streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Final state of a stream over the events table's files, written batch by batch to the shared folder."""
    shared = shared_folder(spark, "stream")
    like = table(spark, sf_dir, "events")
    stream = build(spark.readStream.schema(like.schema).parquet(f"{sf_dir}/events.parquet*"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{shared}/state")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{shared}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{shared}/state")

