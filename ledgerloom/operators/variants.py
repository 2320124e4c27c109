"""Items of several variants as one: equal ones by key, and similar ones by the edit distance of their texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold_text
from .assembly import components
from .ranking import assign_ids, materialise

GRAM = 3
BLOCK = 1_000  # texts of a block that one part of it holds


def grams(text: Column) -> Column:
    """The grams of a text between fillers, each with its occurrence, so that equal grams of a text differ."""
    padded = F.concat(F.lit("\x02" * (GRAM - 1)), text, F.lit("\x03" * (GRAM - 1)))
    own = F.transform(F.sequence(F.lit(1), F.length(padded) - (GRAM - 1)), lambda i: F.substring(padded, i, F.lit(GRAM)))
    # sorted, equal grams are neighbours: the place of a gram less that of the first of its kind
    ordered = F.array_sort(own)
    return F.transform(ordered, lambda g, i: F.concat(g, (i + 1 - F.array_position(ordered, g)).cast("string")))


def similar_texts(texts: DataFrame, keys: Sequence[str], text: str, least: float = 0.85, block: int = BLOCK) -> DataFrame:
    """(a, b): ids of texts with equal keys whose similarity, 1 - distance / length of the longer one, is ``least`` or more.

    ``texts`` has ``id``, which no other row has, the keys and the text.  A text of n
    characters has no partner beyond k = n (1 - least) / least edits, and an edit changes
    ``GRAM`` grams at most, so a pair has one of the k * GRAM + 1 rarest grams of either
    in common: only these are joined.  A gram of more than ``block`` texts is dealt
    into parts on one side, each of which meets the other side.  Texts of unlike
    lengths are not compared, and the distance is counted only as far as it may go.
    """
    if not 0.5 < least <= 1:
        raise ValueError("the least similarity must be over 0.5 and at most 1")
    slack = (1 - least) / least + 1e-9
    kept = texts.filter(F.col(text).isNotNull()).select("id", *keys, F.col(text).alias("_t"))
    rows = kept.select("id", *keys, F.explode(grams(F.col("_t"))).alias("_g"), (F.floor(F.length("_t") * slack) * GRAM + 1).alias("_most"))
    counts = rows.groupBy(*keys, "_g").agg(F.count("*").alias("_n"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    weighed = rows.alias("r").join(counts.alias("c"), [*same("r", "c"), F.col("r._g") == F.col("c._g")]).select("r.*", "c._n")
    rarest = Window.partitionBy("id").orderBy("_n", "_g")
    first = weighed.filter("_n > 1").withColumn("_k", F.row_number().over(rarest)).filter("_k <= _most").select("id", *keys, "_g", "_n")
    first = materialise(first.join(kept.select("id", "_t"), "id").withColumn("_parts", F.ceil(F.col("_n") / block).cast("int")), "grams")
    left = first.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    right = first.withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    long, short = F.greatest(F.length("l._t"), F.length("r._t")), F.least(F.length("l._t"), F.length("r._t"))
    shared = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("_g", "_part")]
    met = left.alias("l").join(right.alias("r"), [*same("l", "r"), *shared, F.col("l.id") < F.col("r.id"), short >= long * least])
    pairs = met.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.col("l._t").alias("_a"), F.col("r._t").alias("_b")).dropDuplicates(["a", "b"])
    longer = F.greatest(F.length("_a"), F.length("_b"))
    return pairs.filter(F.levenshtein("_a", "_b") <= (1 - least) * longer + 1e-9).select("a", "b")


def merge_variants(items: DataFrame, keys: Sequence[str], text: str, quantity: str, variant: str, notes: str, least: float | None = None, pattern: str = "EXP-%03d") -> DataFrame:
    """(new_id, keys, description, quantity, variants, notes, items): items with equal keys and folded text as one.

    With ``least`` those whose folded texts are so similar are one too, together with what is similar to these.
    The longest description stays, a numeric quantity before a text, variants and
    different notes are listed in order, ``items`` counts the rows.  Ids are new, in the
    order of keys and descriptions.  Items without a text are one per key.
    """
    folded = items.withColumn("_norm", F.coalesce(F.trim(F.regexp_replace(fold_text(F.col(text)), r"\s+", " ")), F.lit("")))
    numeric = F.when(F.col(quantity).try_cast("double").isNotNull(), F.col(quantity))
    written = F.nullif(F.trim(F.col(notes).cast("string")), F.lit(""))
    one = folded.groupBy(*keys, "_norm").agg(
        F.max_by(text, F.struct(F.length(text), F.col(text))).alias("description"), F.max(numeric).alias("_number"), F.max(quantity).alias("_text"),
        F.collect_set(F.col(variant).cast("string")).alias("_variants"), F.collect_set(written).alias("_notes"), F.count("*").alias("items"),
    )
    group = [*keys, "_norm"]
    if least is not None:
        one = materialise(one.withColumn("id", F.sha2(F.to_json(F.struct(*group)), 256)), "variants")
        found = components(similar_texts(one.filter("_norm <> ''"), keys, "_norm", least))
        one = one.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("_group", F.coalesce("component", "id"))
        group = [*keys, "_group"]
    listed = lambda c, glue: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), glue)
    merged = one.groupBy(*group).agg(
        F.max_by("description", F.struct(F.length("description"), "description")).alias("description"), F.coalesce(F.max("_number"), F.max("_text")).alias("quantity"),
        listed("_variants", ",").alias("variants"), listed("_notes", "; ").alias("notes"), F.sum("items").alias("items"),
    )
    merged = merged.withColumn("_order", F.struct(*keys, F.coalesce("description", F.lit("")), group[-1]))
    return assign_ids(merged, "_order", [], pattern).select("new_id", *keys, "description", "quantity", "variants", "notes", "items")
