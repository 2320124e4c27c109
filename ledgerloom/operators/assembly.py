"""Operators that put documents, chunk plans and bills of materials together and check them.

Nulls in a text count as blank, in a flag as false; empty tables give empty
results (or one row of zeros where the result is a total).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.layouts import VALIDITY
from . import corpus as cp
from .chunks import close_gaps, holding, pack_chunks, tied
from .ranking import materialise
from .upkeep import blank, flag


def joined_in_order(value: Column, order: Sequence[Column], glue: str) -> Column:
    """Aggregate: values joined in order.  For groups of the size of one document."""
    rows = F.collect_list(F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)], value.alias("_v")))
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["_v"]), glue)


def key_dates(schedule: Column) -> Column:
    """struct(queries, proposals) of a schedule array of struct(stage, start, end); the end falls back to the start.

    Queries: the best scored stage that has a date (presenting or registering
    queries before other query stages, never their answers), the first of equals.
    """
    date = lambda s: F.coalesce(F.nullif(s["end"], F.lit("")), F.nullif(s["start"], F.lit("")))
    name = lambda s: F.lower(F.coalesce(s["stage"], F.lit("")))
    answers, asks = lambda n: n.rlike("absoluci[oó]n"), lambda n: n.contains("consulta")
    presents = lambda n: n.rlike("presentaci[oó]n")
    score = lambda n: F.when(answers(n), -1).when(asks(n) & (presents(n) | n.contains("registro")), 100).when(n.rlike("consulta|aclaraci[oó]n"), 50).otherwise(-1)
    dated = F.filter(F.coalesce(schedule, F.array().cast("array<struct<stage:string,start:string,end:string>>")), lambda s: date(s).isNotNull())
    scored = F.transform(dated, lambda s, k: F.struct(score(name(s)).alias("score"), (-k).alias("place"), date(s).alias("date")))
    queries = F.array_max(F.filter(scored, lambda s: s["score"] >= 0))["date"]
    proposals = F.get(F.filter(dated, lambda s: ~asks(name(s)) & (presents(name(s)) | name(s).contains("propuesta"))), F.lit(0))
    return F.struct(queries.alias("queries"), date(proposals).alias("proposals"))


# The units of technical values.
UNITS = ("GHz", "MHz", "W", "dB", "V", "A", "Mbps", "Gbps", "rpm", "mm", "cm", "m", "kg")


def parse_validity(c: Column) -> Column:
    """struct(since, until), nulls where the text has no period."""
    part = lambda k: F.nullif(F.regexp_extract(c, VALIDITY, k), F.lit(""))
    return F.struct(part(1).alias("since"), part(2).alias("until"))


def tech_tokens(c: Column) -> Column:
    """Numbers with a unit, in order."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"[\d.]+\s*(?:{'|'.join(UNITS)})"), F.lit(0))


def build_query(description: Column, group: Column, params: Column, glossary: Mapping[str, str], groups: Mapping[str, str], tail: str, most: int = 300) -> Column:
    """Search text: the group's words, glossary words found (longest term first, each taken out), values of two parameters."""
    rest, found = F.lower(F.coalesce(description, F.lit(""))), []
    for term in sorted(glossary, key=lambda t: (-len(t), t)):
        found.append(F.when(rest.contains(term), F.lit(glossary[term])))
        rest = F.replace(rest, F.lit(term))
    lead = F.lit(None).cast("string")
    for g, words in groups.items():
        lead = F.when(group == g, F.lit(words)).otherwise(lead)
    tokens = F.flatten(F.transform(F.slice(F.coalesce(params, F.array().cast("array<string>")), 1, 2), tech_tokens))
    parts = F.concat(F.array_compact(F.array(lead, *found)), tokens)
    body = F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(F.substring(F.coalesce(description, F.lit("")), 1, 80))
    return F.substring(F.concat(body, F.lit(tail)), 1, most)


def valid_line_ranges(sections: DataFrame, start: str = "line_start", end: str = "line_end") -> DataFrame:
    """Rows whose range is whole numbers, from 1 on and not backwards."""
    whole = sections.withColumns({n: F.col(n).cast("string").try_cast("bigint") for n in (start, end)})
    return whole.filter((F.col(start) > 0) & (F.col(end) >= F.col(start)))


def leaf_sections(sections: DataFrame, doc: str, tie: str) -> DataFrame:
    """Sections without chapters that others fill (level 1 or over 250 lines); of equal ranges the deepest."""
    large = (F.col("level") <= 1) | (F.col("line_end") - F.col("line_start") + 1 > 250)
    return tied(holding(sections, doc, False, large), doc, [F.col(tie)])


def chunk_documents(sections: DataFrame, doc: str, tie: str, target: int = 500, hard: int = 750, overlap: int = 50, totals: DataFrame | None = None) -> DataFrame:
    """Valid leaf sections packed into chunks without gaps, with the lines that each document's chunks cover.

    ``totals`` (doc, total): the lines of each document; without it a document ends
    with its last section.  A document without sections becomes chunks of ``target``
    lines.  Pieces of a forced cut (``split``) keep their overlap.
    """
    good = valid_line_ranges(sections)
    ends = good.groupBy(doc).agg(F.max("line_end").alias("_end"))
    known = ends.withColumnRenamed("_end", "total") if totals is None else totals.select(doc, F.col("total").cast("long").alias("total"))
    chunks = pack_chunks(leaf_sections(good, doc, tie), doc, target, hard, overlap, known)
    closed = close_gaps(chunks.join(known, doc, "left"), doc, "total", "split")
    return closed.join(cp.coverage(closed, [doc], "line_start", "line_end"), doc, "left").select(doc, "chunk", "line_start", "line_end", "split", "covered")


def number_candidates(rows: DataFrame, item: str, accepted: Column, order: Sequence[Column]) -> DataFrame:
    """``number``: 1..k over an item's accepted candidates, 0 for the others."""
    ok = flag(accepted)
    place = F.row_number().over(Window.partitionBy(item, ok).orderBy(*order))
    return rows.withColumn("number", F.when(ok, place).otherwise(0))


def plan_candidates(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Pages that look like drawings, with their reasons.

    Image-heavy pages (image share 0.4 or more) count unless over 70 % of the
    document is so, they lie in a run of over 5, or hold over 4 images; where
    ``widest_image`` is given, their widest image must take 15 % of the page's width.
    ``cad_like`` marks pages whose own profile says so.
    """
    wide = F.coalesce(F.col("widest_image") >= 0.15 * F.col("width"), F.lit(False)) if "widest_image" in pages.columns else F.lit(True)
    cad = flag("cad_like") if "cad_like" in pages.columns else F.lit(False)
    heavy = F.coalesce(F.col("image_area_ratio") >= 0.4, F.lit(False))
    per = pages.groupBy(doc).agg(F.median("area").alias("_median"), F.avg(heavy.cast("double")).alias("_share"))
    marked = pages.withColumn("_heavy", heavy).withColumn("_place", F.row_number().over(Window.partitionBy(doc, "_heavy").orderBy(page)))
    marked = marked.withColumn("_run", F.count("*").over(Window.partitionBy(doc, "_heavy", F.col(page) - F.col("_place"))))
    m = marked.join(per, doc)
    image = F.col("_heavy") & (F.col("_share") <= 0.7) & (F.col("_run") <= 5) & (F.coalesce("image_count", F.lit(0)) <= 4) & wide
    rules = {"area": F.col("area") >= 1.4 * F.col("_median"), "width": F.col("width") >= 700, "height": F.col("height") >= 1000, "drawings": F.col("drawing_count") > 5000, "drawing_ratio": F.col("drawing_ratio") > 0.3, "cad_like": cad, "images": image}
    return cp.page_signals(m, rules).filter("signals <> ''").select(doc, page, F.col("signals").alias("reasons"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node of the edges, by repeated hooking of neighbours' labels.

    Tables of nodes are small on disk where nodes are alike, and large in memory, so their joins are by sorting.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("_to")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("_to"))).distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("_to")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("_to"), F.col("component").alias("_c")).hint("merge"), "_to").groupBy("node").agg(F.min("_c").alias("_c"))
        hooked = labels.join(near.hint("merge"), "node").select("node", F.least("component", "_c").alias("component"))
        jumped = hooked.alias("h").join(labels.alias("l").hint("merge"), F.col("h.component") == F.col("l.node"), "left").select("h.node", F.least("h.component", F.coalesce("l.component", "h.component")).alias("component"), "h.component")
        after = materialise(jumped.toDF("node", "component", "_own").drop("_own"), "labels")
        if not after.join(labels.withColumnRenamed("component", "_before").hint("merge"), "node").filter("component <> _before").limit(1).count():
            return after
        labels = after


def image_noise(refs: DataFrame, doc: str, min_freq: int = 5, tiny: int = 20, words: Sequence[str] = (), near: int = 12, small: int = 300) -> DataFrame:
    """(doc, xref, category), the first that holds.

    HIGH_FREQ: on ``min_freq`` pages or more, or with the digest of such an image and nothing else before
    SIGNATURE.  DUPLICATE: every reference of a digest with several (none of them
    frequent).  PERCEPTUAL_DUP (where ``words`` of a perceptual hash are given): of
    images up to ``small`` pixels a side whose hashes are connected by at most ``near`` bits, all but the
    most used.  TINY.  SIGNATURE: its digest is on 2 to ``min_freq - 1`` pages.  CONTENT.
    """
    first_words = [F.min(w).alias(w) for w in words]
    use = refs.groupBy(doc, "sha", "xref").agg(F.countDistinct("page").alias("pages"), F.max("width").alias("width"), F.max("height").alias("height"), *first_words)
    spread = refs.groupBy(doc, "sha").agg(F.countDistinct("page").alias("sha_pages"))
    by_sha = use.groupBy(doc, "sha").agg(F.count("*").alias("_copies"), F.bool_or(F.col("pages") >= min_freq).alias("_frequent"))
    m = use.join(spread, [doc, "sha"]).join(by_sha, [doc, "sha"])
    frequent, copied = F.col("pages") >= min_freq, (F.col("_copies") > 1) & ~F.col("_frequent")
    like = F.lit(False)
    if words:
        node = F.concat_ws("|", F.col(doc).cast("string"), F.col("xref").cast("string"))
        free = m.filter(~frequent & ~copied & (F.col("width") <= small) & (F.col("height") <= small)).withColumn("_node", node)
        pairs = cp.hamming_pairs(free, "_node", words, near, by=[doc], forest=True)
        place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("pages"), "xref"))
        drops = free.join(components(pairs, "left", "right").withColumnRenamed("node", "_node"), "_node").withColumn("_k", place).filter("_k > 1").select(doc, "xref", F.lit(True).alias("_like"))
        m = m.join(drops, [doc, "xref"], "left")
        like = flag("_like")
    category = (
        F.when(frequent, "HIGH_FREQ").when(copied, "DUPLICATE").when(like, "PERCEPTUAL_DUP").when((F.col("width") < tiny) & (F.col("height") < tiny), "TINY")
        .when(F.col("_frequent"), "HIGH_FREQ").when(F.col("sha_pages").between(2, min_freq - 1), "SIGNATURE").otherwise("CONTENT")
    )
    return m.select(doc, "xref", category.alias("category"))


def repeated_drawings(drawings: DataFrame, doc: str, totals: DataFrame, threshold: float = 0.5, min_pages: int = 10, most: int = 500, tolerance: int = 2) -> DataFrame:
    """(doc, x0, y0, x1, y1, style, pages, total): drawings on enough pages of their document.

    ``drawings`` has page, x0, y0, x1, y1 and style (fill, colour and kinds of strokes
    as one text), ``totals`` (doc, total) the pages of each document.  Pages with
    over ``most`` drawings do not count.  Rectangles are rounded to points.  Those of one style within
    ``tolerance`` of each other are one drawing (connected components over
    neighbouring grid cells); then those of like width and height are, if together
    they are on enough pages.  The smallest rectangle of a component names it.
    """
    crowded = drawings.groupBy(doc, "page").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select(doc, "page")
    corners = ["x0", "y0", "x1", "y1"]
    d = drawings.join(crowded, [doc, "page"], "left_anti").withColumns({x: F.round(x).cast("int") for x in corners})
    node = F.struct(doc, *corners, "style")
    on_pages = d.select(doc, "page", node.alias("node")).distinct()
    keys = materialise(on_pages.select("node").distinct(), "drawings")

    def linked(nodes: DataFrame, values: Sequence[tuple[str, Column]]) -> DataFrame:
        """Edges that connect the nodes of one document and style whose values differ by ``tolerance`` at most.

        Nodes of equal values are connected through the smallest of them.  Different
        values are whole numbers and meet by cells of all of them, so that a cell holds
        (tolerance + 1) to the power of their number at most, however many nodes there are.
        """
        cell = tolerance + 1
        names = [n for n, _ in values]
        named = nodes.select("node", F.col(f"node.{doc}").alias("_d"), F.col("node.style").alias("_s"), *[v.alias(n) for n, v in values])
        one = materialise(named.groupBy("_d", "_s", *names).agg(F.min("node").alias("_first")), "places")
        n, o = named.alias("n"), one.alias("o")
        equal = (F.col("n._d") == F.col("o._d")) & F.col("n._s").eqNullSafe(F.col("o._s"))
        for x in names:
            equal = equal & (F.col(f"n.{x}") == F.col(f"o.{x}"))
        stars = n.join(o.hint("merge"), equal & (F.col("n.node") != F.col("o._first"))).select(F.col("o._first").alias("a"), F.col("n.node").alias("b"))
        around = here = one.withColumns({f"_c_{x}": F.floor(F.col(x) / cell) for x in names})
        for x in names:
            around = around.withColumn(f"_c_{x}", F.explode(F.array_distinct(F.array(*[F.floor((F.col(x) + k) / cell) for k in (-tolerance, 0, tolerance)]))))
        a, b = here.alias("a"), around.alias("b")
        near = (F.col("a._d") == F.col("b._d")) & F.col("a._s").eqNullSafe(F.col("b._s")) & (F.col("a._first") < F.col("b._first"))
        for x in names:
            near = near & (F.col(f"a._c_{x}") == F.col(f"b._c_{x}")) & (F.abs(F.col(f"a.{x}") - F.col(f"b.{x}")) <= tolerance)
        return stars.unionByName(a.join(b.hint("merge"), near).select(F.col("a._first").alias("a"), F.col("b._first").alias("b")))

    def fused(rows: DataFrame, edges: DataFrame) -> DataFrame:
        found = components(edges)
        return rows.join(found.hint("merge"), "node", "left").select(doc, "page", F.coalesce("component", "node").alias("node")).distinct()

    near = materialise(fused(on_pages, linked(keys, [(x, F.col(f"node.{x}")) for x in corners])), "near")
    size = [("w", F.col("node.x1") - F.col("node.x0")), ("h", F.col("node.y1") - F.col("node.y0"))]
    alike = fused(near, linked(near.select("node").distinct(), size))

    def enough(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(doc, "node").agg(F.count("*").alias("pages")).join(totals, doc)
        return counts.filter((F.col("pages") >= min_pages) & (F.col("pages") >= threshold * F.col("total")))

    kept = enough(alike)
    return kept.select(doc, *[F.col(f"node.{x}").alias(x) for x in corners], F.col("node.style").alias("style"), "pages", "total")


def sheet_profile(cells: DataFrame, sheet: str, long_text: int = 200, ratio: float = 0.4) -> DataFrame:
    """Counts of cells by kind, merged ranges in the head (rows 1 to 3) and below, shares, and the representation that follows.

    ``merged_min_row`` is set on the first cell of a merged range.
    """
    text = F.col("kind") == "text"
    out = cells.groupBy(sheet).agg(
        F.count_if(text).alias("texts"), F.count_if(F.col("kind") == "number").alias("numbers"), F.count_if(text & (F.length("text") >= long_text)).alias("long_texts"),
        F.coalesce(F.sum(F.when(text, F.length("text"))), F.lit(0)).alias("text_chars"), F.count_if(F.col("merged_min_row") <= 3).alias("merged_head"), F.count_if(F.col("merged_min_row") > 3).alias("merged_data"),
        F.max("row").alias("rows"), F.max("col").alias("cols"), F.count_if(F.col("kind").isNotNull()).alias("_filled"),
    )
    out = out.withColumn("long_ratio", F.when(F.col("_filled") > 0, F.col("long_texts") / F.col("_filled")).otherwise(F.lit(0.0)))
    out = out.withColumn("aspect", F.when(F.col("cols") > 0, F.col("rows") / F.col("cols")).otherwise(F.lit(0.0)))
    merged = (F.col("merged_head") > 0) | (F.col("merged_data") > 0)
    decision = F.when(F.col("_filled") == 0, "empty").when((F.col("long_ratio") >= ratio) & (F.col("cols") <= 3), "text").when(merged, "html").otherwise("markdown")
    return out.withColumn("representation", decision).drop("_filled")


def version_line_diff(old: DataFrame, new: DataFrame, page: str, line: str) -> DataFrame:
    """(page, status, added, removed, same): lines as multisets, page by page; status is added, removed, changed or identical."""
    a = old.groupBy(page, line).agg(F.count("*").alias("_a"))
    b = new.groupBy(page, line).agg(F.count("*").alias("_b"))
    d = a.join(b, [page, line], "full_outer").na.fill(0, ["_a", "_b"])
    out = d.groupBy(page).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum(F.greatest(F.col("_b") - F.col("_a"), F.lit(0))).alias("added"), F.sum(F.greatest(F.col("_a") - F.col("_b"), F.lit(0))).alias("removed"), F.sum(F.least("_a", "_b")).alias("same"))
    status = F.when(F.col("_a") == 0, "added").when(F.col("_b") == 0, "removed").when(F.col("added") + F.col("removed") > 0, "changed").otherwise("identical")
    return out.select(page, status.alias("status"), "added", "removed", "same")


def changed_regions(old: DataFrame, new: DataFrame, page: str, pos: str, line: str) -> DataFrame:
    """(page, changed_share, regions, largest_share, risk) of each page that both versions have.

    A line changed if the other version lacks it (or has it less often: the later
    ones count).  Runs of changed lines of one version are its regions; shares are of the lines of both versions.
    """
    side = lambda df, k: df.select(page, pos, line, F.lit(k).alias("_side"))
    # all windows and aggregates are by page, so its rows are dealt once
    rows = side(old, 0).unionByName(side(new, 1)).filter(F.col(page).isNotNull()).repartition(page)
    alike, whole = Window.partitionBy(page, line), Window.partitionBy(page)
    times = F.count_if(F.col("_side") == 1).over(alike), F.count_if(F.col("_side") == 0).over(alike)
    rows = rows.withColumns({"_both": F.min("_side").over(whole) < F.max("_side").over(whole), "_times": F.when(F.col(line).isNull(), 0).when(F.col("_side") == 0, times[0]).otherwise(times[1])})
    nth = F.row_number().over(Window.partitionBy(page, line, "_side").orderBy(pos))
    marked = rows.filter("_both").withColumn("_changed", nth > F.col("_times")).select(page, pos, "_side", "_changed")
    place = F.row_number().over(Window.partitionBy(page, "_side", "_changed").orderBy(pos))
    run = F.when(F.col("_changed"), F.col(pos) - place)
    runs = marked.withColumn("_run", run).groupBy(page, "_side", "_changed", "_run").agg(F.count("*").alias("_rows"), (F.max(pos) - F.min(pos) + 1).alias("_size"))
    changed = lambda c: F.when(F.col("_changed"), F.col(c))
    out = runs.groupBy(page).agg(F.sum("_rows").alias("_lines"), F.coalesce(F.sum(changed("_rows")), F.lit(0)).alias("_n"), F.count(changed("_rows")).alias("regions"), F.coalesce(F.max(changed("_size")), F.lit(0)).alias("_largest"))
    share, largest = F.col("_n") / F.col("_lines"), F.col("_largest") / F.col("_lines")
    return out.select(page, share.alias("changed_share"), "regions", largest.alias("largest_share"), tx.diff_risk(share, largest, F.col("regions")).alias("risk"))


def diff_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("status").agg(F.count("*").alias("pages"), F.sum("added").alias("added"), F.sum("removed").alias("removed"))


def risk_summary(regions: DataFrame, page: str) -> DataFrame:
    """(risk, pages): how many pages have each risk."""
    return regions.groupBy("risk").agg(F.count(page).alias("pages"))


def clean_corpus(lines: DataFrame, noise: DataFrame, on: Sequence[str], doc: str, pos: str, line: str, page_number: Column) -> DataFrame:
    """(doc, body): lines that are neither noise nor page numbers, in order."""
    kept = cp.filter_noise(lines, noise, on).filter(~flag(page_number))
    return kept.groupBy(doc).agg(joined_in_order(F.col(line), [F.col(pos)], "\n").alias("body"))


def assemble_markdown(chunks: DataFrame, doc: str, key: Sequence[str], pos: str, kind: str, text: str, drop: Sequence[str], glue: str = "\n\n---\n\n", rewrite: Callable[[Column], Column] = tx.fix_spacing, finish: Callable[[Column], Column] = tx.fix_ligatures) -> DataFrame:
    """(doc, body): the first chunk of each key, without the dropped kinds and blanks, its spacing mended, joined by rules; ligatures are mended in the whole."""
    wanted = chunks.filter(~F.coalesce(F.col(kind), F.lit("")).isin(*drop) & ~blank(F.col(text)))
    first = wanted.groupBy(doc, *key).agg(F.min_by(F.struct(F.col(pos).alias("p"), F.col(text).alias("t")), F.col(pos)).alias("x"))
    ready = first.select(doc, F.col("x.p").alias("p"), rewrite(F.trim("x.t")).alias("t"))
    return ready.groupBy(doc).agg(finish(joined_in_order(F.col("t"), [F.col("p")], glue)).alias("body"))


def pick_section(sections: DataFrame, doc: str, pos: str, keywords: Sequence[str], most: int = 8000) -> DataFrame:
    """(doc, picked): the body of the first section whose title has a keyword, else of the intro, cut to ``most``."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.col("title").contains(k)
    found = F.min_by("body", F.when(flag(hit), F.col(pos)))
    intro = F.min_by("body", F.when(F.col("title") == "_intro", F.col(pos)))
    return sections.groupBy(doc).agg(F.substring(F.coalesce(found, intro, F.lit("")), 1, most).alias("picked"))


def validate_entries(entries: DataFrame, totals: DataFrame, doc: str, entry: str, most: int = 400, plan: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """(doc, entry, error), one row an error: repeated id, bad range, end past the document, evidence missing or too long.

    ``plan`` (doc, line_start, line_end): the ranges that were to be read; a document
    whose plan leaves lines of its total out has one error of its own (entry null), and,
    with ``read`` (the same columns), every planned range that was not read has one.
    """
    counts = entries.groupBy(doc, entry).agg(F.count("*").alias("_n"))
    total = totals.groupBy(doc).agg(F.max("total").alias("_total"))
    e = entries.join(counts, [doc, entry], "left").join(total, doc, "left")
    start, end = F.col("line_start"), F.col("line_end")
    errors = F.array(
        F.when(F.col("_n") > 1, "duplicate id"), F.when(start.isNull() | end.isNull() | (start > end), "bad range"), F.when(end > F.col("_total"), "past the end"),
        F.when(blank(F.col("evidence")), "no evidence").when(F.length("evidence") > most, "long evidence"),
    )
    out = e.select(doc, entry, F.explode(F.array_compact(errors)).alias("error"))
    if plan is None:
        return out
    whole = lambda df, error: df.select(doc, F.lit(None).cast(entries.schema[entry].dataType).alias(entry), error.alias("error"))
    ranges = plan.select(doc, "line_start", "line_end").distinct()
    inside = ranges.join(total, doc).select(doc, F.greatest("line_start", F.lit(1)).alias("line_start"), F.least("line_end", "_total").alias("line_end")).filter("line_start <= line_end")
    covered = total.join(cp.coverage(inside, [doc], "line_start", "line_end"), doc, "left")
    out = out.unionByName(whole(covered.filter("coalesce(covered, 0) < _total"), F.lit("plan leaves lines out")))
    if read is None:
        return out
    missing = ranges.join(read.select(doc, "line_start", "line_end").distinct(), [doc, "line_start", "line_end"], "left_anti")
    return out.unionByName(whole(missing, F.concat_ws(" ", F.lit("not read:"), F.concat_ws("-", "line_start", "line_end"))))


def entry_report(entries: DataFrame, doc: str, phase: str, order: str, text: str) -> DataFrame:
    """(doc, report): entries under a heading for each phase, phases sorted, a missing phase as ``unclear``."""
    named = entries.withColumn("_phase", F.coalesce(F.nullif(F.trim(phase), F.lit("")), F.lit("unclear")))
    parts = named.groupBy(doc, "_phase").agg(joined_in_order(F.concat(F.lit("- "), F.coalesce(text, F.lit(""))), [F.col(order)], "\n").alias("_body"))
    return parts.groupBy(doc).agg(joined_in_order(F.concat(F.lit("## "), "_phase", F.lit("\n"), "_body"), [F.col("_phase")], "\n").alias("report"))


def entry_index(entries: DataFrame, doc: str, phase: str) -> DataFrame:
    """(doc, phase, entries): how many entries a document has in each phase, a missing phase as ``unclear``."""
    named = F.coalesce(F.nullif(F.trim(phase), F.lit("")), F.lit("unclear"))
    return entries.groupBy(doc, named.alias("phase")).agg(F.count("*").alias("entries"))


def apply_clarifications(lines: DataFrame, edits: DataFrame, doc: str, pos: str, line: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(doc, body) with the latest edit of each line applied, and the edits whose line does not exist.

    ``edits`` has action (modify, add, delete, none) and new_text; a changed
    line carries a mark of its version, an added one follows its line.
    """
    latest = edits.withColumn("_n", F.row_number().over(Window.partitionBy(doc, pos).orderBy(F.desc(version), F.desc_nulls_last("new_text")))).filter("_n = 1").drop("_n")
    j = lines.select(doc, pos, line).join(latest.select(doc, pos, "action", "new_text", F.col(version).alias("_v")), [doc, pos], "left")
    mark = F.concat(F.coalesce("new_text", F.lit("")), F.lit(" [v"), F.col("_v").cast("string"), F.lit("]"))
    out = F.when(F.col("action") == "modify", mark).when(F.col("action") == "add", F.concat_ws("\n", line, mark)).otherwise(F.col(line))
    kept = j.filter(~flag(F.col("action") == "delete")).withColumn("_out", out)
    return kept.groupBy(doc).agg(joined_in_order(F.col("_out"), [F.col(pos)], "\n").alias("body")), edits.join(lines.select(doc, pos), [doc, pos], "left_anti")


def staging_select(docs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Documents that the manifest includes, with the kind of clarification it states."""
    wanted = manifest.filter(flag("include")).groupBy(key).agg(F.min("clarification").alias("clarification"))
    return docs.join(wanted, key)


def bom_with_results(bom: DataFrame, specs: DataFrame, results: DataFrame, item: str) -> DataFrame:
    """Every item with its specification and one row a result (one row without if there is none)."""
    return bom.join(specs, item, "left").join(results, item, "left")


def missing_refs(rows: DataFrame, refs: DataFrame, ref: str) -> DataFrame:
    """Rows that name a matrix which does not exist; blank names are no reference."""
    return rows.filter(~blank(F.col(ref))).join(refs.select(ref), ref, "left_anti")


def group_totals(rows: DataFrame, item: str, group: str) -> DataFrame:
    """(group, rows, items, resolved, conditional, without): item flags first, then counts by group."""
    flags = rows.groupBy(group, item).agg(F.count("*").alias("_n"), F.bool_or(F.col("state") == "VALIDO").alias("_v"), F.bool_or(F.col("state") == "CONDICIONADO").alias("_c"))
    v, k = flag("_v"), flag("_c")
    return flags.groupBy(group).agg(F.sum("_n").alias("rows"), F.count("*").alias("items"), F.count_if(v).alias("resolved"), F.count_if(k & ~v).alias("conditional"), F.count_if(~v & ~k).alias("without"))


def classify_results(items: DataFrame, candidates: DataFrame, item: str, accepted: Sequence[str] = ("VALIDO", "CONDICIONADO")) -> DataFrame:
    """(item, accepted, state): how many candidates are accepted and CON_CANDIDATOS or SIN_CANDIDATOS."""
    counts = candidates.groupBy(item).agg(F.count_if(F.col("class").isin(*accepted)).alias("accepted"))
    out = items.select(item).distinct().join(counts, item, "left").na.fill(0, ["accepted"])
    return out.withColumn("state", F.when(F.col("accepted") > 0, "CON_CANDIDATOS").otherwise("SIN_CANDIDATOS"))


def first_texts(requirements: DataFrame, item: str, order: Sequence[Column], text: Column, k: int, alias: str, glue: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(item).orderBy(*order))
    top = requirements.withColumn("_n", place).filter(F.col("_n") <= k).withColumn("_t", text)
    return top.groupBy(item).agg(joined_in_order(F.col("_t"), [F.col("_n")], glue).alias(alias))


def search_bom(bom: DataFrame, requirements: DataFrame, item: str, score: Column, services: str, k: int = 10) -> DataFrame:
    """Goods with their ``k`` best scored hard requirements (first of equals) and the count of hard ones."""
    hard = requirements.filter("hard_soft = 'Hard'")
    best = first_texts(hard, item, [score.desc(), F.asc("pos")], F.col("text"), k, "params", "; ")
    counts = hard.groupBy(item).agg(F.count("*").alias("hard"))
    goods = bom.filter(~flag(F.col("group") == services))
    return goods.join(best, item, "left").join(counts, item, "left").na.fill(0, ["hard"]).na.fill("", ["params"])


def key_spec(requirements: DataFrame, item: str, pos: str) -> DataFrame:
    """(item, spec): "parameter: value" of up to three of the first five hard requirements, cut to 120."""
    hard = requirements.filter("hard_soft = 'Hard'").withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy(pos))).filter("_n <= 5")
    named = hard.filter(~blank(F.col("parameter")))
    text = F.when(blank(F.col("value")), F.col("parameter")).otherwise(F.concat_ws(": ", "parameter", "value"))
    return first_texts(named.drop("_n"), item, [F.asc(pos)], text, 3, "spec", "; ").withColumn("spec", F.substring("spec", 1, 120))


def audit_bom(bom: DataFrame, source: DataFrame, documents: DataFrame, item: str, kinds: Sequence[str]) -> DataFrame:
    """(item, finding): kind outside the list, not in the source list or missing from it, repeated, parent unknown, text not verbatim in its document."""
    row = lambda df, f: df.select(item, F.lit(f).alias("finding"))
    squeeze = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    out = row(bom.filter(~F.coalesce("kind", F.lit("")).isin(*kinds)), "kind")
    out = out.unionByName(row(source.select(item).distinct().join(bom, item, "left_anti"), "missing"))
    out = out.unionByName(row(bom.select(item).distinct().join(source, item, "left_anti"), "extra"))
    out = out.unionByName(row(bom.groupBy(item).agg(F.count("*").alias("_n")).filter("_n > 1"), "duplicate"))
    parents = bom.select(F.col(item).alias("parent"))
    out = out.unionByName(row(bom.filter("parent IS NOT NULL").join(parents, "parent", "left_anti"), "parent"))
    texts = bom.join(documents.select("doc", F.col("body").alias("_body")), "doc", "left")
    return out.unionByName(row(texts.filter(~flag(squeeze(F.col("_body")).contains(squeeze(F.col("text"))))), "not verbatim"))


def merge_cross_document(entries: DataFrame, key: Sequence[str], doc: str, entry: str, text: str) -> DataFrame:
    """One row a key: the first document's wording, all sources and ids, and how many documents have it."""
    gathered = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return entries.groupBy(*key).agg(F.min_by(text, F.struct(doc, entry)).alias("wording"), gathered(doc).alias("sources"), gathered(entry).alias("ids"), F.countDistinct(doc).alias("documents"))
