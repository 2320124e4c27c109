"""Sections of documents: what lies inside what, and packing into chunks of lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = "struct<line_start: bigint, line_end: bigint, split: boolean>"
STRIP = 4096


def least_inner_end(sections: DataFrame, doc: str, level: str = "level", start: str = "line_start", end: str = "line_end", strip: int = STRIP) -> DataFrame:
    """(doc, level, start, least_end): for the levels and starts that occur, the smallest end of a deeper section that begins at that start or after it.

    A section holds a deeper one if that end is not past its own.  Levels are looked up
    by their binary prefixes, as many as the levels have bits, and starts by strips of
    ``strip`` lines: a running minimum inside the strip, and that of the strips after
    it.  So a task holds a strip of a document, never the document, and no section
    meets another.  Sections with a null in any column take no part.
    """
    named = {level: "level", start: "start", end: "end"}
    slim = sections.select(F.col(doc).alias("doc"), *[F.col(c).cast("long").alias(n) for c, n in named.items()]).dropna()
    low, high = slim.agg(F.min("level"), F.max("level")).first()
    bits = range(max(1, ((high or 0) - (low or 0)).bit_length()))
    at = F.col("level") - F.lit(low or 0)
    above = F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.shiftright(at, k).alias("prefix")) for k in bits]))
    beyond = F.array_compact(F.array(*[F.when(F.shiftright(at, k) % 2 == 0, F.struct(F.lit(k).alias("bit"), (F.shiftright(at, k) + 1).alias("prefix"))) for k in bits]))
    points = slim.groupBy("doc", "level", "start").agg(F.min("end").alias("end")).select("doc", above.alias("node"), "start", "end")
    points = points.groupBy("doc", "node", "start").agg(F.min("end").alias("end")).withColumn("level", F.lit(None).cast("long"))
    asked = slim.select("doc", "level", "start").distinct().select("doc", F.explode(beyond).alias("node"), "start", F.lit(None).cast("long").alias("end"), "level")
    both = points.unionByName(asked).withColumn("strip", F.expr(f"start div {strip}"))
    strips = both.groupBy("doc", "node", "strip").agg(F.min("end").alias("_least"))
    after = Window.partitionBy("doc", "node").orderBy(F.desc("strip")).rowsBetween(Window.unboundedPreceding, -1)
    strips = strips.select("doc", "node", "strip", F.min("_least").over(after).alias("_after"))
    inside = Window.partitionBy("doc", "node", "strip").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_here", F.min("end").over(inside)).filter("level IS NOT NULL").join(strips, ["doc", "node", "strip"])
    found = met.groupBy("doc", "level", "start").agg(F.min(F.least("_here", "_after")).alias("least_end")).filter("least_end IS NOT NULL")
    return found.select(F.col("doc").alias(doc), F.col("level").alias(level), F.col("start").alias(start), "least_end")


def holding(sections: DataFrame, doc: str, holds: bool, among: Column | None = None) -> DataFrame:
    """Sections that hold a deeper section of their document, or the others; ``among``: only for these is it asked, the rest hold nothing."""
    inner = least_inner_end(sections, doc).toDF("_doc", "_level", "_start", "_least")
    whole = lambda c: F.col(c).cast("long")
    same = (F.col(doc) == F.col("_doc")) & (whole("level") == F.col("_level")) & (whole("line_start") == F.col("_start")) & (F.col("_least") <= whole("line_end"))
    return sections.join(inner, same if among is None else same & among, "left_semi" if holds else "left_anti")


def packed(sections: Column, target: int = 500, hard: int = 750, overlap: int = 50) -> Column:
    """Chunks (line_start, line_end, split) of a document's sorted sections (line_start, line_end), as one fold.

    The state is the open chunk: its first line, the end of its last section and its
    farthest end.  A section closes it if it would become longer than ``hard``, or than
    ``target`` while it is at three quarters of that.  A section longer than ``hard``
    becomes pieces of ``target`` lines that overlap by ``overlap``, marked ``split``.
    """
    step = max(target - overlap, 1)
    none = F.lit(None).cast("bigint")
    piece = lambda a, b, cut: F.struct(a.cast("bigint").alias("line_start"), b.cast("bigint").alias("line_end"), F.lit(cut).alias("split"))
    empty = F.array().cast(f"array<{PIECE}>")
    held = lambda s: F.when(s["first"].isNotNull(), F.array(piece(s["first"], s["most"], False)).cast(f"array<{PIECE}>")).otherwise(empty)

    def add(s: Column, x: Column) -> Column:
        a, b = x["line_start"].cast("bigint"), x["line_end"].cast("bigint")
        size = b - a + 1
        more = F.ceil(F.greatest(size - target, F.lit(0)) / step).cast("bigint")
        pieces = F.transform(F.sequence(F.lit(0).cast("bigint"), more), lambda k: piece(a + k * step, F.least(b, a + k * step + target - 1), True))
        proposed = F.greatest(s["last"], b) - s["first"] + 1
        full = (proposed > hard) | ((s["last"] - s["first"] + 1 >= int(0.75 * target)) & (proposed > target))
        fresh = s["first"].isNull() | full
        large = size > hard
        done = F.when(large, F.concat(s["done"], held(s), pieces)).when(full, F.concat(s["done"], held(s))).otherwise(s["done"])
        first = F.when(large, none).when(fresh, a).otherwise(s["first"])
        most = F.when(large, none).when(fresh, b).otherwise(F.greatest(s["most"], b))
        return F.struct(done.cast(f"array<{PIECE}>").alias("done"), first.alias("first"), F.when(large, none).otherwise(b).alias("last"), most.alias("most"))

    start = F.struct(empty.alias("done"), none.alias("first"), none.alias("last"), none.alias("most"))
    return F.aggregate(sections, start, add, lambda s: F.concat(s["done"], held(s)))


def pack_chunks(sections: DataFrame, doc: str, target: int = 500, hard: int = 750, overlap: int = 50, totals: DataFrame | None = None) -> DataFrame:
    """(doc, chunk, line_start, line_end, split): sections packed in line order, see ``packed``.

    ``totals`` (doc, total): a document without sections gets chunks of ``target``
    lines up to its total.  A document's line ranges are one row.
    """
    ranges = sections.select(doc, F.struct(F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end")).alias("_range"))
    own = ranges.groupBy(doc).agg(F.sort_array(F.collect_list("_range")).alias("_ranges")).select(doc, packed(F.col("_ranges"), target, hard, overlap).alias("_chunks"))
    if totals is not None:
        starts = F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"), F.lit(target).cast("long"))
        whole = F.transform(starts, lambda a: F.struct(a.alias("line_start"), F.least(a + (target - 1), F.col("total").cast("long")).alias("line_end"), F.lit(False).alias("split")))
        bare = totals.filter("total >= 1").join(own, doc, "left_anti").select(doc, whole.cast(f"array<{PIECE}>").alias("_chunks"))
        own = own.unionByName(bare)
    out = own.select(doc, F.posexplode("_chunks").alias("_k", "_chunk"))
    return out.select(doc, (F.col("_k") + 1).alias("chunk"), "_chunk.line_start", "_chunk.line_end", "_chunk.split")


def close_gaps(chunks: DataFrame, doc: str, total: str, split: str | None = None) -> DataFrame:
    """Chunks stretched over gaps from line 1 to ``total``; overlaps are trimmed unless ``split`` marks a forced cut.

    Ends depend only on the next start and starts only on the previous new end,
    so two windows give the sequential result.
    """
    w = Window.partitionBy(doc).orderBy("line_start", "line_end")
    out = chunks.withColumn("_next", F.lead("line_start").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = F.greatest("line_end", F.coalesce(F.col(total), F.lit(0)))
    out = out.withColumn("_end", F.when(F.col("_next").isNull(), last).otherwise(F.greatest("line_end", F.col("_next") - 1)))
    out = out.withColumn("_prev", F.lag("_end").over(w))
    keep = F.coalesce(F.col(split), F.lit(False)) if split else F.lit(False)
    start = F.when(F.col("_first"), F.least("line_start", F.lit(1))).when(keep & (F.col("line_start") <= F.col("_prev")), F.col("line_start")).otherwise(F.col("_prev") + 1)
    return out.withColumns({"line_start": start, "line_end": F.col("_end")}).drop("_next", "_first", "_end", "_prev")


def tied(sections: DataFrame, doc: str, tie: Sequence[Column]) -> DataFrame:
    """Of sections with equal ranges the deepest, the first of the tie's order."""
    place = F.row_number().over(Window.partitionBy(doc, "line_start", "line_end").orderBy(F.desc("level"), *tie))
    return sections.withColumn("_n", place).filter("_n = 1").drop("_n")
