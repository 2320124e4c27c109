"""Listings over a feed: joined entities and analyses, references, filters, badges, facets and preferences.

Null flags count as false, null texts as blank; an empty feed gives an empty
listing.  Column names are parameters with the feed's usual ones as defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .feed import by_status, preferred


def with_entity(feed: DataFrame, entities: DataFrame, key: str = "entity_id") -> DataFrame:
    """Every item with its entity's columns, nulls where it is unknown."""
    return feed.join(entities, key, "left")


def with_analysis(feed: DataFrame, analyses: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Every item with its first analysis in ``order`` and ``has_analysis``."""
    own = preferred(analyses, [key], order).withColumn("_has", F.lit(True))
    return feed.join(own, key, "left").withColumn("has_analysis", F.coalesce("_has", F.lit(False))).drop("_has")


def find_by_ref(snapshot: DataFrame, feed: DataFrame, keys: Sequence[str], found: str) -> DataFrame:
    """Every snapshot row with the stored item of the same source, entity and reference in ``found``, or null."""
    return snapshot.join(feed.select(*keys, found), list(keys), "left")


def match_business_key(snapshot: DataFrame, claimed: DataFrame, entity: str, name: str, key: str, order: Sequence[Column]) -> DataFrame:
    """(key, other): the preferred claimed item with a row's entity and normalised name, unless that is the row itself.

    One claimed item a business key is joined, so a key that many rows share makes no pairs.
    """
    keyed = lambda df: df.withColumn("_key", tx.normalize_key(F.col(name)))
    best = preferred(keyed(claimed), [entity, "_key"], order).select(entity, "_key", F.col(key).alias("other"))
    return keyed(snapshot).join(best, [entity, "_key"]).filter(F.col(key) != F.col("other")).select(key, "other")


def active_entities(feed: DataFrame, entities: DataFrame, key: str, statuses: Sequence[str]) -> DataFrame:
    """Entities with an item in one of the statuses."""
    return entities.join(feed.filter(F.col("status").isin(*statuses)).select(key), key, "left_semi")


def orphan_decisions(decisions: DataFrame, feed: DataFrame, item: str = "feed_item_id", key: str = "id") -> DataFrame:
    """Decisions on items that the feed does not hold."""
    return decisions.join(feed.select(F.col(key).alias(item)), item, "left_anti")


def listing_filter(feed: DataFrame, status: str | None = None, entities: DataFrame | None = None, subject: str | None = None, allowed: Sequence[str] = (), key: str = "entity_id", column: str = "subject") -> DataFrame:
    """Optional filters by status (of ``allowed``, where given), by entities of a natural key and by subject; blank ones do not filter."""
    out = feed
    if status and status.strip():
        if allowed and status not in allowed:
            raise ValueError(f"unknown status {status}; known: {', '.join(allowed)}")
        out = by_status(out, [status])
    if entities is not None:
        out = out.join(entities.select(key), key, "left_semi")
    return out.filter(F.col(column) == subject) if subject and subject.strip() else out


def badges(feed: DataFrame, groups: Sequence[str], unread: Column, ready: Column) -> DataFrame:
    """Counts of unread and of ready items a group, in one pass."""
    return feed.groupBy(*groups).agg(F.count_if(ready).alias("ready"), F.count_if(unread).alias("unread"))


def facets(feed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(facet, value): the different values of each column that are not blank; sorting is the reader's."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in columns])
    return feed.select(F.inline(pairs)).filter(F.trim(F.coalesce("value", F.lit(""))) != "").distinct()


def preferred_published(feed: DataFrame, keys: Sequence[str], published: str, key: str = "id") -> DataFrame:
    """(keys, key): the newest item of each business key among published, unpromoted ones that are not rejected; ``feed`` has ``rejected``."""
    free = feed.filter((F.col("status") == published) & F.col("promoted_at").isNull() & ~F.coalesce("rejected", F.lit(False)))
    return free.groupBy(*keys).agg(F.max(key).alias(key))


# Limits of one upload.
MOST_FILES, FILE_BYTES, BATCH_BYTES = 8, 50 << 20, 48 << 20


def batch_limits(files: DataFrame, key: str, size: str, most: int = MOST_FILES, each: int = FILE_BYTES, total: int = BATCH_BYTES) -> DataFrame:
    """(key, files, bytes, reason): why a batch cannot be sent, or ``ok``; a null size counts as empty."""
    bytes_ = F.coalesce(F.col(size), F.lit(0))
    g = files.groupBy(key).agg(F.count("*").alias("files"), F.sum(bytes_).alias("bytes"), F.min(bytes_).alias("_least"), F.max(bytes_).alias("_most"))
    reason = F.when(F.col("files") > most, "too many files").when(F.col("bytes") <= 0, "empty batch").when(F.col("_least") <= 0, "empty file").when(F.col("_most") > each, "file too large").when(F.col("bytes") > total, "batch too large").otherwise("ok")
    return g.select(key, "files", "bytes", reason.alias("reason"))


def median_ratio(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``df`` with the exact ``median`` of its group and ``ratio`` to it; 1 where the median is 0.

    Values are counted first, so a group of very many rows is as many rows as it
    has different values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    medians = counts.groupBy(*groups).agg(F.percentile(F.col(value).cast("double"), F.lit(0.5), F.col("_n")).alias("median"))
    out = df.join(medians, list(groups), "left")
    return out.withColumn("ratio", F.when(F.col("median") == 0, F.lit(1.0)).otherwise(F.col(value) / F.col("median")))
