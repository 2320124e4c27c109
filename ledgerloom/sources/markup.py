"""Markup as tables: one row an element, with what encloses it, and rules over these rows.

``elements`` reads each page once with a tokenizer of tags, which knows quoted
attributes, comments and scripts and closes what HTML lets a page leave open (cells,
rows, list items).  Everything after it is DataFrame work on (page, at): what an
element encloses are the rows whose ``path`` names it.  A page is read by one task;
its elements are rows like any others from there on.

Defined results: null and empty pages give no rows; broken markup gives what its tags
say; repeated pages (equal page keys) would mix, so keys should be unique; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import materialise
from .layouts import DATE_START, DOWNLOAD, LISTING_CELLS, LISTING_PARAMETERS, OPENS_PROCESS, PARAMETER, SCHEDULE_HEADER, VALIDITY, _query_value, _stage

TAGS = ("table", "tbody", "tr", "td", "th", "a", "li", "div", "span")
TEXT = "#text"
# Which open elements a tag ends, and where that stops.
ENDS = {
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "tbody": ({"tbody", "tr", "td", "th"}, {"table"}), "li": ({"li"}, {"ul", "ol"}),
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Reader(HTMLParser):
    """Elements of a page in order: (tag, attributes, ordinals of what encloses it, pieces of text)."""

    def __init__(self, kept: frozenset[str], texts: bool):
        super().__init__(convert_charrefs=True)
        self.kept, self.texts, self.found, self.open = kept, texts, [], []

    def path(self) -> list[int]:
        return [k for _, k in self.open if k is not None]

    def handle_starttag(self, tag, attrs):
        closes, stops = ENDS.get(tag, ((), ()))
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] in stops or not closes:
                break
            if self.open[depth][0] in closes:
                del self.open[depth:]
        number = None
        if tag in self.kept:
            number = len(self.found)
            self.found.append((tag, {k: v or "" for k, v in attrs}, self.path(), []))
        if tag not in VOID:
            self.open.append((tag, number))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return
            if self.open[depth][0] == "table" and tag in ENDS:
                return  # what encloses the table is not ended from inside it

    def handle_data(self, data):
        path = self.path()
        for k in path:
            self.found[k][3].append(data)
        if self.texts and data.strip():
            self.found.append((TEXT, {}, path, [data]))


def elements(pages: DataFrame, page: str, html: str, tags: Sequence[str] = TAGS, texts: bool = False) -> DataFrame:
    """(page, at, up, tag, attrs, path, text, joined): elements of the given tags, in order.

    ``up`` is the nearest of them that encloses it, ``path`` all that do.  ``text``: its
    text with blanks made one, ``joined``: its pieces of text trimmed and put together.
    With ``texts`` pieces of text are rows too, of the tag ``TEXT``.
    """
    kept = frozenset(tags)
    names = ["page", "at", "up", "tag", "attrs", "path", "text", "joined"]

    def run(it):
        import pyarrow as pa

        def batch_of(key, kind, begin: int, part: list) -> pa.RecordBatch:
            tag, attrs, path, pieces = zip(*part, strict=True)
            columns = [
                pa.array([key] * len(part), kind), pa.array(range(begin, begin + len(part)), pa.int32()), pa.array([p[-1] if p else None for p in path], pa.int32()),
                pa.array(tag), pa.array([list(a.items()) for a in attrs], pa.map_(pa.string(), pa.string())), pa.array(path, pa.list_(pa.int32())),
                pa.array([" ".join("".join(x).split()) for x in pieces]), pa.array(["".join(y.strip() for y in x) for x in pieces]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in it:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                reader = _Reader(kept, texts)
                reader.feed(value.as_py() or "")
                reader.close()
                rows = reader.found
                for begin in range(0, len(rows), 5000):
                    yield batch_of(key.as_py(), batch.schema.field(0).type, begin, rows[begin : begin + 5000])

    kind = pages.schema[page].dataType.simpleString()
    schema = f"page {kind}, at int, up int, tag string, attrs map<string, string>, path array<int>, text string, joined string"
    return pages.select(F.col(page).alias("page"), F.col(html).cast("string").alias("html")).filter("html <> ''").mapInArrow(run, schema)


def read_once(found: DataFrame, wanted: Column, *columns: str | Column) -> DataFrame:
    """The elements and columns that a rule reads, written once: what reads them again does not read the pages again."""
    return materialise(found.filter(wanted).select("page", "at", *columns), "elements")


def attribute(name: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))


def has_class(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.array_contains(F.split(attribute("class"), r"\s+"), n)
    return out


def inside(found: DataFrame, name: str = "of") -> DataFrame:
    """``found`` once for every element that encloses it, whose ordinal is ``name``."""
    return found.withColumn(name, F.explode("path"))


def in_order(value: Column) -> Column:
    """Aggregate: values in the order of their elements.  For what one row or table holds."""
    return F.transform(F.array_sort(F.collect_list(F.struct("at", value.alias("v")))), lambda x: x["v"])


def first_by(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first element of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).filter("_n = 1").drop("_n")


def listing_rows(found: DataFrame) -> DataFrame:
    """(page, row_index, nine cells, four parameters, link_id) of the elements of listing pages.

    Rows are those of the listing's own body, cells those of the row itself; a row's
    link may stand anywhere in it.  Rows with fewer than ten cells, without a link that
    opens a process or without its id go; of rows of a page with the same id the first stays.
    """
    found = read_once(found, F.col("tag").isin("tbody", "tr", "td") | ((F.col("tag") == "a") & attribute("onclick").contains(OPENS_PROCESS)), "up", "tag", F.when(F.col("tag") != "td", F.col("attrs")).alias("attrs"), F.when(F.col("tag") == "a", F.col("path")).alias("path"), F.when(F.col("tag") == "td", F.col("joined")).alias("joined"))
    body = first_by(found.filter((F.col("tag") == "tbody") & (attribute("id") == "formBuscador:dtProcesos_data")), ["page"]).select("page", F.col("at").alias("up"))
    rows = found.filter("tag = 'tr'").join(body, ["page", "up"]).select("page", F.col("at").alias("row"), attribute("data-ri").try_cast("int").alias("_ri"))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("page").orderBy("row")) - 1)
    cells = found.filter("tag = 'td'").groupBy("page", F.col("up").alias("row")).agg(in_order(F.col("joined")).alias("_td")).filter(F.size("_td") >= 10)
    links = found.filter((F.col("tag") == "a") & attribute("onclick").contains(OPENS_PROCESS))
    links = inside(links.select("page", "at", "path", attribute("onclick").alias("_call"), attribute("id").alias("_id")), "row")
    first = links.groupBy("page", "row").agg(F.min_by(F.struct("_call", "_id"), "at").alias("_a"))
    names, values = (F.regexp_extract_all("_a._call", F.lit(PARAMETER), F.lit(k)) for k in (1, 2))
    met = rows.join(cells, ["page", "row"]).join(first, ["page", "row"]).withColumns({"_names": names, "_values": values})
    # of a name that is given twice the last value counts
    last = lambda p: F.try_element_at("_values", (F.size("_names") + 1 - F.array_position(F.reverse("_names"), p)).cast("int"))
    itself = lambda n: F.exists(F.arrays_zip("_names", "_values"), lambda p: (p["_names"] == n) & (p["_values"] == n))
    own = F.try_element_at(F.filter("_names", lambda n: n.startswith("formBuscador:dtProcesos") & itself(n)), F.lit(1))
    out = met.select(
        "page", F.coalesce("_ri", "_place").alias("row_index"), "row", *[F.col("_td")[k].alias(n) for k, n in enumerate(LISTING_CELLS)],
        *[F.when(F.array_contains("_names", p), last(p)).otherwise(F.lit(d)).alias(n) for n, (p, d) in LISTING_PARAMETERS.items()], F.coalesce(own, "_a._id").alias("link_id"),
    ).filter("nid_proceso <> ''")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("page", "nid_proceso").orderBy("row"))).filter("_n = 1").drop("_n", "row")


def _row_cells(found: DataFrame) -> DataFrame:
    """(page, row, cells): all cells in each row, those of tables inside it too."""
    rows = found.filter("tag = 'tr'").select("page", F.col("at").alias("row"))
    cells = inside(found.filter("tag = 'td'").select("page", "at", "path", "joined"), "row").join(rows, ["page", "row"])
    return cells.groupBy("page", "row").agg(in_order(F.col("joined")).alias("cells"))


def schedules(found: DataFrame) -> DataFrame:
    """(page, place, stage, starts, ends): the schedule table with the expected id, if it has rows, else the first with most rows, two at least."""
    found = read_once(found, F.col("tag").isin("table", "tr", "th", "td"), "tag", "path", F.when(F.col("tag") == "table", F.col("attrs")).alias("attrs"), F.when(F.col("tag").isin("th", "td"), F.col("joined")).alias("joined"))
    tables = found.filter("tag = 'table'").select("page", F.col("at").alias("table"), attribute("id").rlike(r"tbFicha:j_idt\d+$").alias("_named"))
    heads = inside(found.filter("tag = 'th'").select("page", "at", "path", "joined"), "table").groupBy("page", "table").agg(in_order(F.col("joined")).alias("_th"))
    good = tables.join(heads, ["page", "table"]).filter(F.col("_th") == F.array(*map(F.lit, SCHEDULE_HEADER))).drop("_th")
    rows = inside(found.filter("tag = 'tr'").select("page", "at", "path"), "table").join(good, ["page", "table"]).withColumnRenamed("at", "row")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("page", "table").orderBy("row"))).filter("_n > 1")
    dated = rows.join(_row_cells(found), ["page", "row"]).filter((F.size("cells") == 3) & F.regexp_like(F.try_element_at("cells", F.lit(2)), F.lit(DATE_START)))
    counts = dated.groupBy("page", "table").agg(F.count("*").alias("_rows"), F.first("_named").alias("_own"))
    # only the first table with such an id has it
    named = tables.filter("_named").groupBy("page").agg(F.min("table").alias("_first"))
    ranked = counts.join(named, "page", "left").withColumn("_it", F.coalesce(F.col("table") == F.col("_first"), F.lit(False)))
    chosen = ranked.filter(F.col("_it") | (F.col("_rows") >= 2)).withColumn("_n", F.row_number().over(Window.partitionBy("page").orderBy(F.desc("_it"), F.desc("_rows"), "table"))).filter("_n = 1")
    out = dated.join(chosen.select("page", "table"), ["page", "table"], "left_semi")
    place = F.row_number().over(Window.partitionBy("page").orderBy("row")) - 1
    return out.select("page", place.alias("place"), _stage(F.translate(F.col("cells")[0], "\u00a0", " ")).alias("stage"), F.col("cells")[1].alias("starts"), F.col("cells")[2].alias("ends"))


def documents(found: DataFrame) -> DataFrame:
    """(page, place, uuid, name, stage, kind, size, date, access): documents that a detail page's links download.

    Stage, kind and date are the second, third and fifth cell of the link's own row, blank
    where that has fewer than five; a link without a name is named by its kind.
    """
    found = read_once(found, F.col("tag").isin("tr", "td", "a"), "tag", "path", F.when(F.col("tag") == "a", F.col("attrs")).alias("attrs"), F.when(F.col("tag") != "tr", F.col("joined")).alias("joined"))
    rows = found.filter("tag = 'tr'").select("page", F.col("at").alias("row"))
    part = lambda k: F.regexp_extract("_call", DOWNLOAD, k)
    links = found.filter("tag = 'a'").select("page", "at", "path", "joined", attribute("onclick").alias("_call")).filter(part(1) != "")
    nearest = inside(links.select("page", "at", "path"), "row").join(rows, ["page", "row"]).groupBy("page", "at").agg(F.max("row").alias("row"))
    met = links.drop("path").join(nearest, ["page", "at"], "left").join(_row_cells(found), ["page", "row"], "left")
    cell = lambda k: F.when(F.size("cells") >= 5, F.col("cells")[k]).otherwise("")
    size = F.replace(F.regexp_replace("joined", r"^[()]+|[()]+$", ""), F.lit(" KB"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("at")) - 1
    return met.select(
        "page", place.alias("place"), part(1).alias("uuid"), F.coalesce(F.nullif(part(3), F.lit("")), cell(2)).alias("name"),
        cell(1).alias("stage"), cell(2).alias("kind"), size.alias("size"), cell(4).alias("date"), part(2).alias("access"),
    )


def label_values(found: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(page, label, value): of each page's first text with the label, the cell after the row's first cell with it, else what follows the row's first colon; ``found`` with texts.

    Labels that no row holds have no row.
    """
    found = read_once(found, F.col("tag").isin("tr", "td", TEXT), "tag", "path", F.when(F.col("tag") != "td", F.col("text")).alias("text"), F.when(F.col("tag") == "td", F.col("joined")).alias("joined"))
    rows = found.filter("tag = 'tr'").select("page", F.col("at").alias("row"), F.col("text").alias("_whole"))
    texts = found.filter(F.col("tag") == TEXT).select("page", "at", "path", "text", F.explode(F.array(*map(F.lit, labels))).alias("label")).filter(F.contains("text", F.col("label")))
    first = first_by(texts, ["page", "label"])
    own = inside(first.select("page", "label", "path"), "row").join(rows, ["page", "row"]).groupBy("page", "label").agg(F.max_by(F.struct("row", "_whole"), "row").alias("_r"))
    met = own.select("page", "label", "_r.row", "_r._whole").join(_row_cells(found), ["page", "row"], "left")
    bare = F.rtrim(F.regexp_replace("label", ":+$", ""))
    after = F.try_element_at(F.filter("cells", lambda x, i: (i > 0) & F.coalesce(F.contains(F.element_at("cells", i), bare), F.lit(False))), F.lit(1))
    rest = F.when(F.contains("_whole", F.lit(":")), F.trim(F.regexp_replace("_whole", "^[^:]*:", ""))).otherwise("")
    return met.select("page", "label", F.coalesce(after, rest).alias("value"))


def nested_processes(found: DataFrame) -> DataFrame:
    """(page, process, code, description, place, title, valid_from, valid_to, href, file, name): processes of a list and their documents.

    A process without a title goes; one without documents has one row with null document
    columns.  A document goes if its link names no file.  ``process`` and ``place`` count
    what the markup holds, so they can have gaps.
    """
    marks = ("parent-main-competition", "container-title-competition", "container-text-pdf-title", "title", "excerpt", "container-competition", "container-agreements")
    downloads = (F.col("tag") == "a") & attribute("href").contains("getFile_store_competition_download")
    marked = F.arrays_overlap(F.split(attribute("class"), r"\s+"), F.array(*map(F.lit, marks)))
    found = read_once(found, marked | downloads, "tag", "attrs", "path", F.when(F.col("tag") == "span", F.col("joined")).alias("joined"))

    def under(of: DataFrame, name: str, rows: DataFrame) -> DataFrame:
        """The first of ``rows`` in each element of ``of`` (page, name), with its ordinal."""
        return first_by(inside(rows, name).join(of.select("page", name), ["page", name], "left_semi"), ["page", name])

    place = lambda *keys: F.row_number().over(Window.partitionBy("page", *keys).orderBy("at")) - 1
    # The list's class names and its download link.
    items = found.filter((F.col("tag") == "li") & has_class("parent-main-competition")).select("page", F.col("at").alias("li"), place().alias("process"))
    span = lambda kind: found.filter((F.col("tag") == "span") & has_class(kind)).select("page", "at", "path", "joined")
    box = lambda *names: found.filter(has_class(*names)).select("page", "at", "path")
    head = under(items, "li", box("container-title-competition")).select("page", "li", F.col("at").alias("head"))
    words = under(head, "head", box("container-text-pdf-title")).select("page", "head", F.col("at").alias("words"))
    title = under(words, "words", span("title")).select("page", "words", F.col("joined").alias("code"))
    about = under(words, "words", span("excerpt")).select("page", "words", F.col("joined").alias("description"))
    named = items.join(head, ["page", "li"]).join(words, ["page", "head"]).join(title, ["page", "words"]).join(about, ["page", "words"], "left")
    named = named.select("page", "li", "process", "code", F.coalesce("description", F.lit("")).alias("description"))
    lists = under(items, "li", box("container-competition")).select("page", "li", F.col("at").alias("list"))
    docs = found.filter((F.col("tag") == "div") & has_class("container-agreements", "container-participations-item")).select("page", "at", "path")
    docs = inside(docs, "list").join(lists, ["page", "list"]).select("page", "li", F.col("at").alias("doc"), place("li").alias("place"))
    link = found.filter((F.col("tag") == "a") & attribute("href").contains("getFile_store_competition_download")).select("page", "at", "path", F.trim(attribute("href")).alias("href"))
    file = under(docs, "doc", link).select("page", "doc", "href", _query_value(F.col("href"), "name_file").alias("file")).filter("file IS NOT NULL")
    file = file.withColumn("name", F.coalesce(_query_value(F.col("href"), "new_name"), "file"))
    text = under(docs, "doc", box("container-text-pdf-title")).select("page", "doc", F.col("at").alias("words"))
    head_of = text.join(under(text, "words", span("title")).select("page", "words", F.col("joined").alias("title")), ["page", "words"], "left")
    head_of = head_of.join(under(text, "words", span("excerpt")).select("page", "words", F.col("joined").alias("_valid")), ["page", "words"], "left").drop("words")
    date = lambda n: F.nullif(F.regexp_extract("_valid", VALIDITY, n), F.lit(""))
    whole = docs.join(file, ["page", "doc"]).join(head_of, ["page", "doc"], "left")
    whole = whole.select("page", "li", "place", F.coalesce("title", F.lit("")).alias("title"), date(1).alias("valid_from"), date(2).alias("valid_to"), "href", "file", "name")
    return named.join(whole, ["page", "li"], "left").select("page", "process", "code", "description", "place", "title", "valid_from", "valid_to", "href", "file", "name")
