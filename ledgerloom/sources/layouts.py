"""Structure out of landed text: detail pages, variants of a bill, layout blocks and chunks.

All of it is built-in expressions on whole texts.  Null, empty and malformed
texts give no rows; repeated input rows give repeated output rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Header of a schedule table, start of a schedule date, what is noise in a stage's name, form of validity dates, marks of image notes.
SCHEDULE_HEADER = ("Etapa", "Fecha Inicio", "Fecha Fin")
DATE_START = r"^\d{2}/\d{2}/\d{4}"
STAGE_NOISE = (r"(?i)\s*A TRAV[EÉ]S DEL SEACE\s*", r"(?i)\s*\(Electr[oó]nica\)\s*")
SCHEDULE_ID = r'^[^>]*\bid="[^"]*tbFicha:j_idt\d+"'
VALIDITY = r"(?is)Fecha de vigencia:\s*Desde\s+(\d{2}\.\d{2}\.\d{2})\s+Hasta\s+(\d{2}\.\d{2}\.\d{2})"
IMAGE_MARKS = ("__START_OF_ANNOTATION__", "**Image Description")


def plain(c: Column) -> Column:
    """Text of a piece of markup, entities of markup signs resolved."""
    out = F.regexp_replace(c, "<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def cells(c: Column, tag: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), plain)


def inner_tables(html: Column) -> Column:
    """Insides of the tables that hold no other table: what lies between an opening and the next closing tag."""
    pieces = F.split(F.regexp_replace(html, "(?i)<(/?)table", "<$1table"), "</table>")
    closed = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.transform(F.filter(closed, lambda p: F.contains(p, F.lit("<table"))), lambda p: F.substring_index(p, "<table", -1))


def _stage(c: Column) -> Column:
    for noise in STAGE_NOISE:
        c = F.regexp_replace(c, noise, "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _schedule(inside: Column) -> Column:
    rows = F.transform(F.split(inside, "(?i)</tr>"), lambda r: cells(r, "td"))
    good = F.filter(rows, lambda r: (F.size(r) == 3) & F.regexp_like(F.try_element_at(r, F.lit(2)), F.lit(DATE_START)))
    named = F.transform(good, lambda r: F.struct(_stage(r[0]).alias("stage"), r[1].alias("starts"), r[2].alias("ends")))
    return F.when(cells(inside, "th") == F.array(*map(F.lit, SCHEDULE_HEADER)), named).otherwise(F.slice(named, 1, 0))


def extract_schedule(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, place, stage, starts, ends): the first schedule table with the expected id, else the one with most rows, two at least."""
    tables = F.transform(inner_tables(F.col(html)), lambda t: F.struct(F.regexp_like(t, F.lit(SCHEDULE_ID)).alias("named"), _schedule(t).alias("rows")))
    found = pages.select(page, F.filter(tables, lambda t: F.size(t["rows"]) > 0).alias("_t"))
    first = F.try_element_at(F.filter("_t", lambda t: t["named"]), F.lit(1))["rows"]
    most = F.array_max(F.transform("_t", lambda t: F.size(t["rows"])))
    longest = F.when(most >= 2, F.try_element_at(F.filter("_t", lambda t: F.size(t["rows"]) == most), F.lit(1))["rows"])
    return found.select(page, F.posexplode(F.coalesce(first, longest)).alias("place", "_r")).select(page, "place", "_r.stage", "_r.starts", "_r.ends")


# Id of a listing's table body, what opens a process, a link's parameters, a download's call, the listing's cells in order and parameters with their defaults.
LISTING_BODY = r'(?is)<tbody[^>]*\bid="formBuscador:dtProcesos_data"[^>]*>(.*?)</tbody>'
OPENS_PROCESS = "nidConvocatoria"
PARAMETER = r"'([^']+)':'([^']*)'"
DOWNLOAD = r"descargaDocGeneral\('([^']+)','(\d+)','([^']*)'\)"
LISTING_CELLS = ("numero", "fecha_publicacion", "nomenclatura", "reiniciado_desde", "objeto", "descripcion", "cuantia", "moneda", "version_seace")
LISTING_PARAMETERS = {"nid_proceso": ("nidProceso", ""), "nid_convocatoria": ("nidConvocatoria", ""), "nid_sistema": ("nidSistema", "3"), "ntipo": ("ntipo", "0")}


def extract_listing_rows(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, row_index, nine cells, four parameters, link_id): rows of a listing table.

    Rows with fewer than ten cells, without a link that opens a process or without
    its id go; of rows of a page with the same id the first stays.
    """
    rows = F.split(F.regexp_extract(html, LISTING_BODY, 1), "(?i)</tr>")
    row = pages.select(page, F.posexplode(rows).alias("_at", "_tr"))
    link = F.regexp_extract("_tr", rf'(?is)<a\b[^>]*\bonclick="[^"]*{OPENS_PROCESS}[^"]*"[^>]*>', 0)
    call = F.regexp_extract(link, r'(?is)\bonclick="([^"]*)"', 1)
    names, values = (F.regexp_extract_all(call, F.lit(PARAMETER), F.lit(k)) for k in (1, 2))
    index = F.regexp_extract("_tr", r'(?is)<tr\b[^>]*\bdata-ri="(\d+)"', 1).try_cast("int")
    row = row.select(page, F.coalesce(index, F.col("_at")).alias("row_index"), "_at", cells(F.col("_tr"), "td").alias("_td"), link.alias("_a"), names.alias("_names"), values.alias("_values"))

    def parameter(name: str, default: str) -> Column:
        return F.coalesce(F.try_element_at("_values", F.array_position("_names", name).cast("int")), F.lit(default))

    own_link = F.array_max(F.transform(F.arrays_zip("_names", "_values"), lambda p: F.when(p["_names"].startswith("formBuscador:dtProcesos") & (p["_names"] == p["_values"]), p["_names"])))
    found = row.filter((F.size("_td") >= 10) & (F.col("_a") != "")).select(
        page, "row_index", "_at", *[F.col("_td")[k].alias(n) for k, n in enumerate(LISTING_CELLS)],
        *[F.when(F.array_contains("_names", p), parameter(p, d)).otherwise(F.lit(d)).alias(n) for n, (p, d) in LISTING_PARAMETERS.items()],
        F.coalesce(own_link, F.regexp_extract("_a", r'(?is)\bid="([^"]*)"', 1)).alias("link_id"),
    ).filter("nid_proceso <> ''")
    first = F.row_number().over(Window.partitionBy(page, "nid_proceso").orderBy("_at"))
    return found.withColumn("_n", first).filter("_n = 1").drop("_n", "_at")


def extract_documents(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, place, uuid, name, stage, kind, size, date, access): documents that a detail page's links download.

    Stage, kind and date are the second, third and fifth cell of the link's row,
    blank where it has fewer than five; a link without a name is named by its kind.
    """
    row = pages.select(page, F.posexplode(F.split(html, "(?i)</tr>")).alias("_tr_at", "_tr"))
    links = F.regexp_extract_all("_tr", F.lit(r"(?is)(<a\b[^>]*descargaDocGeneral[^>]*>.*?</a>)"), F.lit(1))
    # the innermost row: what follows the last opening of one
    own = F.when(F.contains("_tr", F.lit("<tr")), F.substring_index("_tr", "<tr", -1)).otherwise("")
    row = row.select(page, "_tr_at", cells(own, "td").alias("_td"), F.posexplode(links).alias("_at", "_a"))
    part = lambda k: F.regexp_extract("_a", DOWNLOAD, k)
    cell = lambda k: F.when(F.size("_td") >= 5, F.col("_td")[k]).otherwise("")
    size = F.replace(F.regexp_replace(plain(F.col("_a")), r"^[()]+|[()]+$", ""), F.lit(" KB"))
    found = row.filter(part(1) != "").select(page, "_tr_at", "_at", part(1).alias("uuid"), F.coalesce(F.nullif(part(3), F.lit("")), cell(2)).alias("name"), cell(1).alias("stage"), cell(2).alias("kind"), size.alias("size"), cell(4).alias("date"), part(2).alias("access"))
    place = F.row_number().over(Window.partitionBy(page).orderBy("_tr_at", "_at")) - 1
    return found.withColumn("place", place).select(page, "place", "uuid", "name", "stage", "kind", "size", "date", "access")


def label_value(html: Column, label: str) -> Column:
    """Text of the cell after the first cell that holds the label; blank if there is none."""
    row = F.try_element_at(F.filter(F.split(html, "(?i)</tr>"), lambda r: F.contains(r, F.lit(label))), F.lit(1))
    texts = cells(row, "td")
    at = F.array_position(F.transform(texts, lambda t: F.contains(t, F.lit(label.rstrip(":")))), True)
    return F.coalesce(F.try_element_at(texts, (at + 1).cast("int")), F.lit(""))


def read_bom_variants(files: DataFrame, tag: str, body: str, rescued: str, fields: Sequence[str]) -> DataFrame:
    """(tag, place, fields): items of each variant's text, of the rescued text where the first cannot be read.

    A text is a list of items or an object with ``items``; ``groups`` lists the
    object's own groups, or the items' ones sorted.
    """
    item = "array<struct<" + ", ".join(f"`{f}`: string" for f in dict.fromkeys([*fields, "grupo"])) + ">>"

    def items(c: Column) -> Column:
        bare = F.from_json(c, item)
        return F.when(F.startswith(F.ltrim(c), F.lit("[")), bare).otherwise(F.from_json(c, f"items {item}")["items"])

    def groups(c: Column) -> Column:
        return F.from_json(c, "grupos_identificados array<string>")["grupos_identificados"]

    got = files.withColumn("_first", items(F.col(body))).withColumn("_text", F.when(F.col("_first").isNotNull(), F.col(body)).otherwise(F.col(rescued)))
    got = got.withColumn("_items", F.coalesce("_first", items(F.col(rescued))))
    derived = F.array_sort(F.array_distinct(F.transform("_items", lambda i: F.coalesce(i["grupo"], F.lit("Unknown")))))
    got = got.withColumn("groups", F.coalesce(groups(F.col("_text")), derived))
    return got.select(tag, "groups", F.posexplode("_items").alias("place", "_i")).select(tag, "place", *[F.col("_i")[f].alias(f) for f in fields], "groups")


_CELLS = "array<struct<cells: array<struct<blocks: array<struct<textBlock: struct<text: string>>>>>>>"
_BLOCKS = f"array<struct<blockId: string, textBlock: struct<text: string, type: string>, tableBlock: struct<headerRows: {_CELLS}, bodyRows: {_CELLS}>>>"
_NOTES = "array<struct<text: string>>"
_CHUNKS = f"array<struct<chunkId: string, content: string, pageSpan: struct<pageStart: int, pageEnd: int>, sourceBlockIds: array<string>, pageHeaders: {_NOTES}, pageFooters: {_NOTES}>>"


def _table_rows(rows: Column) -> Column:
    text = lambda cell: F.trim(F.array_join(F.transform(cell["blocks"], lambda b: F.coalesce(b["textBlock"]["text"], F.lit(""))), " "))
    return F.transform(F.coalesce(rows, F.from_json(F.lit("[]"), _CELLS)), lambda r: F.transform(r["cells"], lambda cell: F.coalesce(text(cell), F.lit(""))))


def parse_layout_blocks(files: DataFrame, key: str, body: str, offset: str) -> DataFrame:
    """(key, place, block_id, type, text, semantic_type, table_rows, page_offset) of a layout's blocks; ``type`` is null for other blocks."""
    got = files.select(key, F.col(offset).alias("page_offset"), F.posexplode(F.from_json(body, _BLOCKS)).alias("place", "b"))
    is_text, is_table = F.col("b.textBlock").isNotNull(), F.col("b.tableBlock").isNotNull()
    return got.select(
        key, "place", F.coalesce("b.blockId", F.lit("")).alias("block_id"), F.when(is_text, "text").when(is_table, "table").alias("type"),
        F.when(is_text, F.coalesce("b.textBlock.text", F.lit(""))).alias("text"), F.when(is_text, F.coalesce("b.textBlock.type", F.lit("paragraph"))).alias("semantic_type"),
        F.when(~is_text & is_table, F.concat(_table_rows(F.col("b.tableBlock.headerRows")), _table_rows(F.col("b.tableBlock.bodyRows")))).alias("table_rows"), "page_offset",
    )


def parse_chunks(files: DataFrame, key: str, body: str, offset: str) -> DataFrame:
    """(key, place, chunk_id, content, page_start, page_end, is_image_annotation, source_block_ids, page_headers, page_footers), pages with the offset added."""
    got = files.select(key, F.col(offset).alias("_at"), F.posexplode(F.from_json(body, _CHUNKS)).alias("place", "b"))
    content = F.coalesce("b.content", F.lit(""))
    image = F.contains(content, F.lit(IMAGE_MARKS[0])) | F.contains(content, F.lit(IMAGE_MARKS[1]))
    notes = lambda c: F.coalesce(F.transform(c, lambda n: F.coalesce(n["text"], F.lit(""))), F.array().cast("array<string>"))
    page = lambda c: F.when(F.col("b.pageSpan").isNotNull(), F.coalesce(F.col(c), F.lit(1)) + F.col("_at")).cast("int")
    return got.select(
        key, "place", F.col("b.chunkId").alias("chunk_id"), content.alias("content"), page("b.pageSpan.pageStart").alias("page_start"), page("b.pageSpan.pageEnd").alias("page_end"), image.alias("is_image_annotation"),
        F.coalesce("b.sourceBlockIds", F.array().cast("array<string>")).alias("source_block_ids"), notes(F.col("b.pageHeaders")).alias("page_headers"), notes(F.col("b.pageFooters")).alias("page_footers"),
    )


def _span(c: Column, kind: str) -> Column:
    return plain(F.regexp_extract(c, rf'(?is)<span[^>]*class="[^"]*\b{kind}\b[^"]*"[^>]*>(.*?)</span>', 1))


def _query_value(href: Column, name: str) -> Column:
    found = F.nullif(F.regexp_extract(F.replace(href, F.lit("&amp;"), F.lit("&")), rf"[?&]{name}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(found), found)


def extract_nested_processes(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, process, code, description, place, title, valid_from, valid_to, href, file, name): processes of a list and their documents.

    A process without a title goes; one without documents has one row with null
    document columns.  A document goes if its link names no file.  ``process``
    and ``place`` count what the markup holds, so they can have gaps.
    """
    # The list's class names and its download link.
    parts = lambda c, mark: F.slice(F.split(c, mark), F.lit(2), F.greatest(F.size(F.split(c, mark)) - 1, F.lit(0)))
    item = pages.select(page, F.posexplode(parts(F.col(html), "parent-main-competition")).alias("process", "_li"))
    item = item.withColumn("_docs", parts(F.col("_li"), "container-participations-item")).withColumn("_head", F.split("_li", "container-participations-item")[0])
    item = item.withColumns({"code": _span(F.col("_head"), "title"), "description": _span(F.col("_head"), "excerpt")}).filter(F.contains("_head", F.lit("container-title-competition")) & F.regexp_like("_head", F.lit(r'(?is)<span[^>]*class="[^"]*\btitle\b')))

    def document(d: Column) -> Column:
        href = F.trim(F.regexp_extract(d, r'(?is)<a[^>]*href="([^"]*getFile_store_competition_download[^"]*)"', 1))
        file = _query_value(href, "name_file")
        date = lambda n: F.nullif(F.regexp_extract(_span(d, "excerpt"), VALIDITY, n), F.lit(""))
        return F.struct(_span(d, "title").alias("title"), date(1).alias("valid_from"), date(2).alias("valid_to"), href.alias("href"), file.alias("file"), F.coalesce(_query_value(href, "new_name"), file).alias("name"))

    docs = F.filter(F.transform("_docs", document), lambda d: d["file"].isNotNull())
    out = item.select(page, "process", "code", "description", F.posexplode_outer(docs).alias("place", "_d"))
    return out.select(page, "process", "code", "description", "place", *[F.col("_d")[n].alias(n) for n in ("title", "valid_from", "valid_to", "href", "file", "name")])
