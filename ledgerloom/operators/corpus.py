"""Operators on documents as lines, pages, sections and bills of materials."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import holding, pack_chunks  # noqa: F401  packing is an operator on sections too
from .hamming import hamming_pairs  # noqa: F401  pairs of an image corpus
from .ranking import materialise


def doc_lines(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """(keep..., pos, line) of lines with two or more characters."""
    return docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("line", F.trim("line")).filter(F.length("line") >= 2)


def long_lines(text: Column) -> Column:
    """Trimmed lines of a text with two or more characters, as a list."""
    return F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: F.length(x) >= 2)


def repeated_lines(lines: DataFrame, group: str, page: str, norm: str, threshold: float, min_pages: int) -> DataFrame:
    """(group, norm, pages, total): lines that recur on enough pages of their group."""
    totals = lines.groupBy(group).agg(F.countDistinct(page).alias("total"))
    counts = lines.groupBy(group, norm).agg(F.countDistinct(page).alias("pages"))
    return counts.join(totals, group).filter((F.col("pages") >= min_pages) & (F.col("pages") >= threshold * F.col("total")))


def page_repeats(pages: DataFrame, group: str, text: str, clean: Callable[[Column], Column], threshold: float, min_pages: int) -> DataFrame:
    """``repeated_lines`` of whole pages, one row a page: lines are made distinct inside the page, so plain counts suffice.

    Each page also counts once under a null line, which gives the pages of its group in
    the same pass.  A line of the group is compared with that total by a join of the counts, not of the lines.
    """
    norms = F.array_distinct(F.transform(long_lines(F.col(text)), clean))
    lines = pages.select(group, norms.alias("_norms")).filter(F.size("_norms") > 0).select(group, F.explode(F.concat("_norms", F.array(F.lit(None).cast("string")))).alias("norm"))
    counts = materialise(lines.groupBy(group, "norm").agg(F.count("*").alias("pages")).filter((F.col("pages") >= min_pages) | F.col("norm").isNull()), "line-counts")
    totals = counts.filter("norm IS NULL").select(group, F.col("pages").alias("total"))
    return counts.filter("norm IS NOT NULL").join(totals, group).filter(F.col("pages") >= threshold * F.col("total"))


def line_report(lines: DataFrame, groups: Sequence[str], page: str, norm: str, line: str, page_number: Column, threshold: float, min_pages: int, samples: int = 3, pages: int = 10) -> DataFrame:
    """Repeated lines by zone and text: category, pages, three samples and the first pages they are on.

    ``groups``: the document, then the zone.  Samples and pages of a line are kept as
    the smallest ones by partial aggregates of its different values.
    """
    doc = groups[0]
    totals = lines.groupBy(doc).agg(F.countDistinct(page).alias("total"))
    least = lambda c, n: F.slice(F.array_sort(F.collect_set(c)), 1, n)
    by_page = lines.groupBy(*groups, norm, page).agg(F.min(line).alias("_line"), F.bool_or(page_number).alias("_number"))
    found = by_page.groupBy(*groups, norm).agg(F.count("*").alias("pages"), F.bool_and("_number").alias("_number"))
    kept = found.join(totals, doc).filter((F.col("pages") >= min_pages) & (F.col("pages") >= threshold * F.col("total")))
    w = Window.partitionBy(*groups, norm).orderBy(page)
    first = by_page.join(kept.select(*groups, norm), [*groups, norm], "left_semi").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= pages)
    shown = first.groupBy(*groups, norm).agg(least("_line", samples).alias("samples"), least(page, pages).alias("first_pages"))
    category = F.when(F.col("_number"), "PAGE_NUMBER").otherwise("TEXT_REPEAT")
    return kept.join(shown, [*groups, norm]).select(*groups, norm, category.alias("category"), "pages", "total", "samples", "first_pages")


def filter_noise(lines: DataFrame, noise: DataFrame, on: Sequence[str]) -> DataFrame:
    return lines.join(noise.select(*on), list(on), "left_anti")


def contiguous_ranges(df: DataFrame, groups: Sequence[str], pos: str) -> DataFrame:
    """Gaps and islands: (groups, start, end)."""
    island = F.col(pos) - F.row_number().over(Window.partitionBy(*groups).orderBy(pos))
    return df.withColumn("_island", island).groupBy(*groups, "_island").agg(F.min(pos).alias("start"), F.max(pos).alias("end")).drop("_island")


def long_runs(df: DataFrame, groups: Sequence[str], pos: str, longest: int) -> DataFrame:
    return contiguous_ranges(df, groups, pos).filter(F.col("end") - F.col("start") + 1 > longest)


def fixed_windows(df: DataFrame, total: str, size: int = 200, overlap: int = 50) -> DataFrame:
    starts = F.sequence(F.lit(1), F.greatest(F.col(total).cast("int"), F.lit(1)), F.lit(size - overlap))
    return df.withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + size - 1, F.col(total).cast("int")))


def dominant(df: DataFrame, groups: Sequence[str], value: str, first: str) -> DataFrame:
    """The most frequent value of each group and its count; ties go to the one seen first."""
    counts = df.groupBy(*groups, value).agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    best = counts.withColumn("_place", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("n"), "_first")))
    return best.filter("_place = 1").drop("_place", "_first")


def coverage(ranges: DataFrame, groups: Sequence[str], start: str, end: str) -> DataFrame:
    """Lines covered by the union of the ranges of each group."""
    before = Window.partitionBy(*groups).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(end).over(before), F.col(start) - 1)
    fresh = F.greatest(F.col(end) - F.greatest(seen, F.col(start) - 1), F.lit(0))
    return ranges.withColumn("_fresh", fresh).groupBy(*groups).agg(F.sum("_fresh").alias("covered"))


def range_contains(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sections that hold a deeper section of the same document."""
    return holding(sections, doc, True)


def multi_counts(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dim, value, n): independent counts of several columns in one pass of grouping sets."""
    counted = df.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"))
    full = (1 << len(dims)) - 1
    dim, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, d in enumerate(dims):
        mine = F.col("_id") == full - (1 << (len(dims) - 1 - k))
        dim, value = F.when(mine, F.lit(d)).otherwise(dim), F.when(mine, F.col(d).cast("string")).otherwise(value)
    return counted.select(dim.alias("dim"), value.alias("value"), "n")


def compliance_summary(matrix: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by result, and the class: no failure on a hard requirement, and partial only for want of information, is VALIDO."""
    failed = F.count_if((F.col("hard_soft") == "Hard") & (F.col("result") == "NO_CUMPLE"))
    partial = F.count_if((F.col("result") == "PARCIAL") & (F.col("subtype") != "sin_info"))
    out = matrix.groupBy(*keys).agg(F.count_if(F.col("result") == "CUMPLE").alias("met"), F.count_if(F.col("result") == "PARCIAL").alias("partly"), F.count_if(F.col("result") == "NO_CUMPLE").alias("failed"), failed.alias("_f"), partial.alias("_p"))
    return out.withColumn("class", F.when(F.col("_f") > 0, "DESCARTADO").when(F.col("_p") > 0, "CONDICIONADO").otherwise("VALIDO")).drop("_f", "_p")


def consolidate_variants(items: DataFrame, keys: Sequence[str], text: str, quantity: str, variant: str) -> DataFrame:
    """Equal items of several variants as one: longest description, a numeric quantity first, variants listed."""
    numeric = F.when(F.col(quantity).try_cast("double").isNotNull(), F.col(quantity))
    return items.groupBy(*keys).agg(
        F.max_by(text, F.struct(F.length(text), F.col(text))).alias("description"),
        F.coalesce(F.max(numeric), F.max(quantity)).alias("quantity"),
        F.array_join(F.array_sort(F.collect_set(F.col(variant).cast("string"))), ",").alias("variants"),
    )


NO_RESULT = "Sin archivo de resultado disponible"  # fixed value, as the two below
NO_CANDIDATE = "Sin candidatos válidos tras búsqueda"
NO_SEARCH = "Servicio — no requiere búsqueda de producto"


def consolidate(bom: DataFrame, candidates: DataFrame, accepted: Sequence[str], results: DataFrame | None = None, services: DataFrame | None = None) -> DataFrame:
    """A row for each item and accepted candidate, numbered; items without one get state SIN_CANDIDATO and number 0.

    ``results`` (item_id, diagnosis) says which items were searched: ``notes`` tells
    why one has no candidate.  ``services`` (item_id) are appended with state SERVICIO.
    """
    good = candidates.filter(F.col("class").isin(*accepted))
    good = good.withColumn("candidate", F.row_number().over(Window.partitionBy("item_id").orderBy("pos")))
    rows = bom.join(good, "item_id", "left")
    if results is None:
        return rows.select("item_id", F.coalesce("candidate", F.lit(0)).alias("candidate"), F.coalesce("class", F.lit("SIN_CANDIDATO")).alias("state"))
    rows = rows.join(results.select("item_id", F.coalesce("diagnosis", F.lit(NO_CANDIDATE)).alias("_why")), "item_id", "left")
    notes = F.when(F.col("class").isNull(), F.coalesce("_why", F.lit(NO_RESULT))).otherwise("")
    out = rows.select("item_id", F.coalesce("candidate", F.lit(0)).alias("candidate"), F.coalesce("class", F.lit("SIN_CANDIDATO")).alias("state"), notes.alias("notes"))
    if services is None:
        return out
    return out.unionByName(services.select("item_id", F.lit(0).alias("candidate"), F.lit("SERVICIO").alias("state"), F.lit(NO_SEARCH).alias("notes")))


def ancestors(tree: DataFrame, item: str = "item_id", parent: str = "parent_id") -> DataFrame:
    """(item, source, distance): each item with itself and all its ancestors, of whatever depth.

    Pointers are doubled: after round k every pair up to a distance of 2^k is
    known, so a tree of depth d takes log2(d) written rounds.  In a cycle of parents an item is its own
    ancestor once, at distance 0.  Repeated rows count once.
    """
    spark = tree.sparkSession
    edges = tree.filter(F.col(parent).isNotNull()).select(F.col(item).alias("_from"), F.col(parent).alias("_to"), F.lit(1).cast("long").alias("_step"))
    jump = materialise(edges.distinct(), "jump")
    known = tree.select(F.col(item).alias("item_id"), F.col(item).alias("source"), F.lit(0).cast("long").alias("distance")).distinct()
    exists = tree.select(F.col(item).alias("_to")).distinct()
    count = -1
    while (pairs := known.count()) != count and jump.limit(1).count():
        count = pairs
        further = jump.join(known.withColumnRenamed("item_id", "_to"), "_to").select(F.col("_from").alias("item_id"), "source", (F.col("_step") + F.col("distance")).alias("distance"))
        known = materialise(known.unionByName(further).groupBy("item_id", "source").agg(F.min("distance").alias("distance")), "known")
        onward = jump.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_step").alias("_more"))
        jump = materialise(jump.join(onward, "_to").select("_from", F.col("_next").alias("_to"), (F.col("_step") + F.col("_more")).alias("_step")).join(exists, "_to", "left_semi").distinct(), "jump")
    return spark.createDataFrame([], known.schema).unionByName(known)


def inherit_requirements(bom: DataFrame, requirements: DataFrame, applies: DataFrame | None = None, numbered: bool = False) -> DataFrame:
    """(item_id, text, origin, parent): own requirements and those of all ancestors, equal texts once, nearest first.

    With ``applies`` (kind) only requirements of these kinds are inherited.  With
    ``numbered`` each item's requirements get ids R-001, R-002, ... in that order.
    """
    reqs = requirements.withColumnRenamed("item_id", "source")
    found = ancestors(bom).join(reqs, "source")
    if applies is not None:
        passed = applies.select("kind").distinct().withColumn("_passes", F.lit(True))
        found = found.join(passed, "kind", "left").filter((F.col("distance") == 0) | F.col("_passes"))
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("item_id", "text").orderBy("distance", "source"))).filter("_n = 1")
    columns = ["item_id", "text", F.when(F.col("distance") == 0, "DIRECTO").otherwise("HEREDADO").alias("origin"), F.when(F.col("distance") > 0, F.col("source")).alias("parent")]
    if numbered:
        place = F.row_number().over(Window.partitionBy("item_id").orderBy("distance", "source", "text"))
        columns.append(F.format_string("R-%03d", place).alias("requirement_id"))
    return found.select(*columns)


def qa_findings(expected: DataFrame, actual: DataFrame, key: str, mandatory: Sequence[str]) -> DataFrame:
    """(severity, kind, item): missing and extra items, and empty mandatory fields."""
    row = lambda df, severity, kind: df.select(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.col(key).alias("item"))
    out = row(expected.select(key).distinct().join(actual, key, "left_anti"), "CRITICO", "missing")
    out = out.unionByName(row(actual.select(key).distinct().join(expected, key, "left_anti"), "MENOR", "extra"))
    for c in mandatory:
        out = out.unionByName(row(actual.filter(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")), "CRITICO", f"empty {c}"))
    return out


def qa_checks(bom: DataFrame, rows: DataFrame, sample: DataFrame, candidates: DataFrame, matrices: DataFrame, outputs: DataFrame, services: str = "Servicios", accepted: Sequence[str] = ("VALIDO", "CONDICIONADO")) -> DataFrame:
    """(severity, kind, item, detail): the findings of ten checks of a consolidated table.

    ``bom`` (item_id, group), ``rows`` (item_id, candidate, state, brand, model, url,
    notes, matrix), ``sample`` (item_id) of items that were searched, ``candidates``
    (item_id, class, brand, model) of their results, ``matrices`` (matrix) that exist,
    ``outputs`` (format, severity, rows): what was written, rows null if it is missing.
    """
    empty = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    item = F.col("item_id")

    def finding(df: DataFrame, severity: str | Column, kind: str | Column, detail: Column | str = "", of: Column | None = item) -> DataFrame:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(lit(severity).alias("severity"), lit(kind).alias("kind"), (F.lit("") if of is None else of.cast("string")).alias("item"), lit(detail).alias("detail"))

    rows = materialise(rows.select("item_id", "candidate", "state", "brand", "model", "url", "notes", "matrix"), "rows")  # many checks read it
    good = candidates.filter(F.col("class").isin(*accepted)).join(sample.select("item_id").distinct(), "item_id", "left_semi")
    good = materialise(good.select("item_id", "brand", "model"), "good")
    items = rows.select("item_id").distinct()
    none = rows.filter("state = 'SIN_CANDIDATO'")
    found = good.groupBy("item_id").agg(F.count("*").alias("_found"))
    held = rows.groupBy("item_id").agg(F.count_if(F.col("candidate") > 0).alias("_held"), F.bool_or(F.col("state") == "SIN_CANDIDATO").alias("_none"))
    sampled = sample.select("item_id").distinct().join(found, "item_id", "left").join(held, "item_id", "left").na.fill(0, ["_found"])
    named = good.filter(~empty("brand") & ~empty("model")).select("item_id", "brand", "model")
    listed = rows.filter("candidate > 0").select("item_id", "brand", "model")
    full = rows.filter(F.col("state").isin(*accepted))
    is_service = bom.filter(F.col("group") == services).select("item_id")
    referred = rows.filter(~empty("matrix"))
    written = outputs.withColumn("_rows", F.lit(rows.count()))
    parts = [
        finding(bom.select("item_id").distinct().join(items, "item_id", "left_anti"), "CRITICO", "ITEM_FALTANTE"),
        finding(items.join(bom, "item_id", "left_anti"), "MENOR", "ITEM_EXTRA"),
        finding(sampled.filter("_found > 0 AND coalesce(_held, 0) <> _found"), "CRITICO", "DISCREPANCIA_CANDIDATOS", F.concat_ws("/", "_found", F.coalesce("_held", F.lit(0)))),
        finding(named.join(listed, ["item_id", "brand", "model"], "left_anti"), "CRITICO", "DISCREPANCIA_CANDIDATO", F.concat_ws(" ", "brand", "model")),
        finding(sampled.filter("_found = 0 AND _held IS NOT NULL AND NOT coalesce(_none, FALSE)"), "CRITICO", "DISCREPANCIA_ESTADO"),
        *[finding(full.filter(empty(c)), severity, "CAMPO_VACIO", c) for c, severity in (("brand", "CRITICO"), ("model", "CRITICO"), ("url", "MENOR"))],
        finding(none.filter(empty("notes")), "MENOR", "SIN_DIAGNOSTICO"),
        finding(none.filter("coalesce(candidate, 0) <> 0"), "CRITICO", "CAMPO_INCORRECTO"),
        finding(is_service.join(items, "item_id", "left_anti"), "CRITICO", "SERVICIO_FALTANTE"),
        finding(rows.join(is_service, "item_id", "left_semi").filter("coalesce(state, '') <> 'SERVICIO'"), "MENOR", "ESTADO_INCORRECTO", F.coalesce("state", F.lit(""))),
        finding(written.filter("rows IS NULL"), F.col("severity"), F.concat(F.col("format"), F.lit("_FALTANTE")), of=None),
        finding(written.filter("rows <> _rows"), "CRITICO", F.concat(F.col("format"), F.lit("_FILAS")), F.concat_ws("/", "rows", "_rows"), of=None),
        finding(referred.join(matrices.select("matrix"), "matrix", "left_anti"), "MENOR", "MATRIZ_FALTANTE", F.col("matrix")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def qa_verdict(findings: DataFrame) -> DataFrame:
    return findings.agg(F.when(F.count_if(F.col("severity") == "CRITICO") > 0, "NO_OK").when(F.count("*") > 0, "OK_CON_OBSERVACIONES").otherwise("OK").alias("verdict"))


def deterministic_sample(df: DataFrame, key: str, seed: str, share: float, least: int) -> DataFrame:
    """The rows with the smallest seeded digests: ``share`` of them, ``least`` at least.

    Counts of rows by the digests' first four hex digits (65,536 at most) give
    the one bucket in which the cut lies; only that one is ranked.
    """
    marked = df.withColumn("_digest", F.sha2(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)), 256)).withColumn("_bucket", F.substring("_digest", 1, 4))
    sizes = marked.groupBy("_bucket").agg(F.count("*").alias("_n"))
    upto = sizes.withColumn("_upto", F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = sizes.agg(F.greatest(F.floor(F.coalesce(F.sum("_n"), F.lit(0)) * share), F.lit(least)).alias("_wanted")).first()["_wanted"]
    room = upto.select("_bucket", (F.lit(wanted) - F.col("_upto") + F.col("_n")).alias("_room"), "_n").filter("_room > 0")
    j = marked.join(F.broadcast(room), "_bucket")
    whole = j.filter("_n <= _room")
    cut = j.filter("_n > _room").withColumn("_place", F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))).filter("_place <= _room").drop("_place")
    return whole.unionByName(cut).drop("_digest", "_bucket", "_room", "_n")


def split_sections(docs: DataFrame, doc: str, text: str, heading: str) -> DataFrame:
    """(doc, section, title, body): lines under each heading line; section 0 is what comes before the first."""
    lines = docs.select(doc, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("_head", F.col("line").rlike(heading))
    section = F.sum(F.col("_head").cast("int")).over(Window.partitionBy(doc).orderBy("pos"))
    lines = lines.withColumn("section", section)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_head"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy(doc, "section").agg(F.coalesce(F.max(F.when(F.col("_head"), F.lower("line"))), F.lit("_intro")).alias("title"), body.alias("body"))


def rescue_json_objects(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, object): every complete top-level object of a list that may be cut off."""
    import json

    def objects(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for pdf in it:
            out = []
            for k, body in zip(pdf[key], pdf[text], strict=True):
                at, place = 0, 0
                while body and (at := body.find("{", at)) >= 0:
                    try:
                        _, end = decoder.raw_decode(body, at)
                    except ValueError:
                        break
                    out.append((k, place, body[at:end]))
                    at, place = end, place + 1
            yield pd.DataFrame(out, columns=[key, "place", "object"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(objects, f"{key} {kind}, place int, object string")


def page_signals(pages: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Names of the rules that hold for each page, joined by commas."""
    return pages.withColumn("signals", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])), ","))
