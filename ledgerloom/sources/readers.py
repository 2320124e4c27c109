"""Sources and sinks: catalogs, landed pages, snapshots, exports and a registry of adapters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import digits_only


# Where the Western European code page differs from Latin-1: rule-built, undefined bytes as replacement signs.
HIGH_CONTROLS = "".join(map(chr, range(0x80, 0xA0)))
WINDOWS_SIGNS = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def decode_bytes(c: Column) -> Column:
    """UTF-8 (without its mark) where valid, else Western European single bytes (code page 1252)."""
    body = F.when(F.hex(F.substring(c, 1, 3)) == "EFBBBF", F.substring(c, 4, 2_147_483_647)).otherwise(c)
    single = F.translate(F.decode(body, "ISO-8859-1"), HIGH_CONTROLS, WINDOWS_SIGNS)
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(single)


def read_entity_catalog(spark: SparkSession, path: str, required: tuple[str, ...] = ("RUC", "NOMBRE_DE_ENTIDAD", "ESTADO")) -> DataFrame:
    """Pipe-separated catalog with a header; short rows and rows without digits in the key go."""
    lines = spark.read.text(path)
    head = lines.first()
    names = [x.strip().upper() for x in (head[0] if head else "").split("|")]
    if missing := [r for r in required if r not in names]:
        raise ValueError(f"the catalog lacks {', '.join(missing)}")
    parts = F.split("value", "\\|")
    rows = lines.filter(F.col("value") != head[0]).withColumn("_p", parts).filter(F.size("_p") >= len(names))
    out = rows.select(*[F.trim(F.col("_p")[k]).alias(n) for k, n in enumerate(names)])
    return out.withColumn(required[0], digits_only(F.col(required[0]))).filter(F.col(required[0]) != "")


def extract_links(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page, pos, href) of each link, the first of equal ones on a page."""
    links = pages.select(page, F.posexplode(F.regexp_extract_all(F.col(html), F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return links.withColumn("_n", F.row_number().over(Window.partitionBy(page, "href").orderBy("pos"))).filter("_n = 1").drop("_n")


def extract_total_pages(html: Column) -> Column:
    script = F.nullif(F.regexp_extract(html, r"totalPages:\s*(\d+)", 1), F.lit(""))
    label = F.nullif(F.regexp_extract(html, r"P[áa]gina:?\s*\d+/(\d+)", 1), F.lit(""))
    return F.coalesce(script.cast("int"), label.cast("int"), F.lit(1))


def triage(c: Column, branches: dict[str, str], other: str = "UNKNOWN") -> Column:
    """Branch of a file by its extension."""
    extension = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    out = F.lit(other)
    for e, b in branches.items():
        out = F.when(extension == e, b).otherwise(out)
    return out


def union_paged(df: DataFrame, key: str, page: str, pos: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(page, pos))).filter("_n = 1").drop("_n")


def write_snapshot(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/v={version}")


def read_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={version}")


def consolidated_markdown(rows: DataFrame, group: str, item: str, name: str, candidate: str, label: str, state: str, notes: str) -> DataFrame:
    """(group, body): a section for each item of a group with its candidates, or why it has none.  A group's text is one row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = (
        F.when(F.col(candidate) > 0, F.concat(F.lit("  - **Candidato "), F.col(candidate).cast("string"), F.lit("**: "), text(label), F.lit(" — **"), text(state), F.lit("**")))
        .when(F.col(state) == "SIN_CANDIDATO", F.concat(F.lit("  - **SIN CANDIDATO**: "), F.substring(text(notes), 1, 200)))
        .otherwise(F.lit("  - Servicio"))
    )
    lines = F.collect_list(F.struct(F.col(candidate).alias("k"), line.alias("v")))
    items = rows.groupBy(group, item).agg(F.min(name).alias("_name"), F.array_join(F.transform(F.array_sort(lines), lambda x: x["v"]), "\n").alias("_lines"))
    section = F.concat(F.lit("### "), F.col(item).cast("string"), F.lit(" — "), F.substring(text("_name"), 1, 80), F.lit("\n"), F.col("_lines"))
    sections = F.collect_list(F.struct(F.col(item).alias("k"), section.alias("v")))
    return items.groupBy(group).agg(F.concat(F.lit("## "), F.first(group), F.lit("\n\n"), F.array_join(F.transform(F.array_sort(sections), lambda x: x["v"]), "\n\n")).alias("body"))


def write_consolidated(df: DataFrame, path: str, columns: list[str], markdown: DataFrame | None = None) -> None:
    """JSON with all columns, tab-separated text with the fixed ones, and grouped Markdown (group, body), a file a group's partition, where given."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.select(*columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/tsv")
    if markdown is not None:
        markdown.select(F.col("body").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(f"{path}/md")


# What a source can do.
SCAN, REFRESH, DOCUMENTS = "scan", "refresh", "documents"


@dataclass(frozen=True)
class Source:
    """A source adapter: how to read it, how its rows become the feed's, and what else it can do.

    ``refresh(spark, items)`` gives fresh rows of watched items, ``documents(spark, items)``
    their document index; a source without them lacks that capability.
    """

    name: str
    read: Callable[[SparkSession], DataFrame]
    map: Callable[[DataFrame], DataFrame]
    priority: int = 100
    refresh: Callable[[SparkSession, DataFrame], DataFrame] | None = None
    documents: Callable[[SparkSession, DataFrame], DataFrame] | None = None

    @property
    def capabilities(self) -> frozenset[str]:
        return frozenset({SCAN} | ({REFRESH} if self.refresh else set()) | ({DOCUMENTS} if self.documents else set()))


_SOURCES: dict[str, Source] = {}


def register_source(source: Source) -> None:
    _SOURCES[source.name] = source


def source(name: str) -> Source:
    if name not in _SOURCES:
        raise KeyError(f"unknown source {name}; known: {', '.join(sorted(_SOURCES))}")
    return _SOURCES[name]


def union_sources(spark: SparkSession, names: list[str]) -> DataFrame:
    """One feed of several sources, by priority."""
    out = None
    for s in sorted((source(n) for n in names), key=lambda s: s.priority):
        df = s.map(s.read(spark)).withColumn("source", F.lit(s.name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def _by_source(spark: SparkSession, items: DataFrame, names: list[str], capability: str) -> DataFrame | None:
    out = None
    for s in sorted((source(n) for n in names), key=lambda s: s.priority):
        if capability in s.capabilities:
            ask = s.refresh if capability == REFRESH else s.documents
            df = ask(spark, items.filter(F.col("source") == s.name)).withColumn("source", F.lit(s.name))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no source of {', '.join(names)} can give {capability}")
    return out


def refresh_watched(spark: SparkSession, items: DataFrame, names: list[str]) -> DataFrame:
    """Fresh rows of the watched items of every source that can refresh, by priority; ``items`` has ``source``."""
    return _by_source(spark, items, names, REFRESH)


def document_index(spark: SparkSession, items: DataFrame, names: list[str]) -> DataFrame:
    """Documents of the items of every source that can list them."""
    return _by_source(spark, items, names, DOCUMENTS)
