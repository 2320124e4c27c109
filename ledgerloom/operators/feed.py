"""Operators on feeds of items: overlays, lists, identity, ranks, merges and changes.

Snapshots are immutable: a merge returns the next snapshot.  Column names are
parameters; where none are given the feed has id, entity_id, status,
first_seen and promoted_at, decisions tenant_id, feed_item_id and decision.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import global_position

REJECTED = "autorejected"


def with_overlay(feed: DataFrame, decisions: DataFrame, tenant: str) -> DataFrame:
    """``feed`` with ``rejected``: a tenant's decision counts, else the item's own status."""
    mine = decisions.filter(F.col("tenant_id") == tenant).select(F.col("feed_item_id").alias("id"), "decision")
    return feed.join(mine, "id", "left").withColumn("rejected", F.coalesce("decision", "status") == REJECTED).drop("decision")


def effective_rejected(feed: DataFrame, decisions: DataFrame, tenant: str) -> DataFrame:
    return with_overlay(feed, decisions, tenant).filter("rejected").select("id")


def not_rejected(feed: DataFrame, decisions: DataFrame, tenant: str) -> DataFrame:
    """Items that are not rejected for the tenant: one join."""
    return with_overlay(feed, decisions, tenant).filter(~F.coalesce("rejected", F.lit(False))).drop("rejected")


def exclude_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def status_counts(feed: DataFrame, decisions: DataFrame, tenant: str, statuses: Sequence[str]) -> DataFrame:
    """Count of each listed status, zeros kept; rejected items count as rejected only."""
    effective = F.when(F.col("rejected"), F.lit(REJECTED)).otherwise(F.col("status"))
    counts = with_overlay(feed, decisions, tenant).groupBy(effective.alias("status")).agg(F.count("*").alias("n"))
    listed = feed.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return listed.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def by_status(feed: DataFrame, statuses: Sequence[str], regime: str = "all") -> DataFrame:
    out = feed.filter(F.col("status").isin(*statuses))
    return out if regime == "all" else out.filter(F.col("promoted_at").isNull() if regime == "feed_pure" else F.col("promoted_at").isNotNull())


def due_for_refresh(df: DataFrame, now: Column, checked: str, deadline: str | Sequence[str], base_s: int = 10_800, urgent_s: int = 2_700, horizon_s: int = 172_800) -> DataFrame:
    """Never checked, or checked longer ago than the item's patience, which is short near any of its deadlines, before or after it."""
    seconds = lambda c: F.unix_timestamp(c)
    near = F.lit(False)
    for d in [deadline] if isinstance(deadline, str) else deadline:
        near = near | F.coalesce(F.abs(seconds(F.col(d)) - seconds(now)) <= horizon_s, F.lit(False))
    patience = F.when(near, urgent_s).otherwise(base_s)
    return df.filter(F.col(checked).isNull() | (seconds(F.col(checked)) < seconds(now) - patience))


def stale(df: DataFrame, ts: str, now: Column, seconds: int, null_is_stale: bool = False) -> DataFrame:
    if seconds <= 0:
        return df.limit(0)
    old = F.unix_timestamp(ts) < F.unix_timestamp(now) - seconds
    return df.filter(F.coalesce(old, F.lit(null_is_stale)))


def date_filter(df: DataFrame, presented: str, published: str, mode: str | None, now: Column, since: Column | None = None) -> DataFrame:
    first = F.coalesce(presented, published)
    if mode == "future":
        return df.filter(F.to_date(presented) > F.to_date(now))
    if mode == "year":
        return df.filter(F.year(first) == F.year(now))
    return df.filter(F.to_date(first) >= since) if mode == "since" else df


def preferred(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; blank keys go."""
    filled = df
    for k in keys:
        filled = filled.filter(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    w = Window.partitionBy(*keys).orderBy(*order)
    return filled.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def renumber(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "list_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def append_rank(listed: DataFrame, arrivals: DataFrame, groups: Sequence[str], rank: str, order: Sequence[Column]) -> DataFrame:
    """Arrivals ranked after the last of their list."""
    last = listed.groupBy(*groups).agg(F.max(rank).alias("_last"))
    placed = arrivals.join(last, list(groups), "left")
    return placed.withColumn(rank, F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).drop("_last")


def upsert_decisions(decisions: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Next decisions, one row a (tenant, item); an exemption is never overwritten by a rejection.

    New rows that repeat a key count in ``order``, each upon what those before it left:
    the last one, or, if that is a rejection, an exemption that only rejections follow.
    Without ``order``, and for ties, the greater decision counts as the later.
    """
    key = ["tenant_id", "feed_item_id"]
    place = F.struct(F.lit(0) if order is None else F.col(order), F.col("decision"))
    other = F.col("decision") != REJECTED
    last = new.groupBy(*key).agg(F.max_by("decision", place).alias("_last"), F.max_by("decision", F.when(other, place)).alias("_other"))
    joined = decisions.select(*key, "decision").join(last, key, "full_outer")
    kept = F.coalesce("_other", "decision") == "exempt"
    return joined.select(*key, F.when((F.col("_last") == REJECTED) & kept, "exempt").otherwise(F.coalesce("_last", "decision")).alias("decision"))


def promote(feed: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """One-way: an item promoted before keeps its time."""
    marked = ids.select("id").distinct().withColumn("_now", F.lit(True))
    return feed.join(marked, "id", "left").withColumn("promoted_at", F.coalesce("promoted_at", F.when(F.col("_now"), now))).drop("_now")


def diff_join(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Key, kind (added, removed, modified, same), old and new values."""
    a = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_old"))
    b = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_new"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "same").otherwise("modified")
    return a.join(b, list(keys), "full_outer").withColumn("kind", kind).drop("_old", "_new")


def last_of(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key that is not blank."""
    return preferred(df, keys, [F.desc(order)])


def date_changes(old: DataFrame, new: DataFrame, key: str, date: str) -> DataFrame:
    """(key, kind, field, old, new): items whose date is filled on both sides and differs."""
    filled = lambda df, name: df.select(key, F.nullif(F.trim(F.col(date).cast("string")), F.lit("")).alias(name))
    both = filled(old, "old").join(filled(new, "new"), key).filter("old <> new")
    return both.select(key, F.lit("modified").alias("kind"), F.lit(date).alias("field"), "old", "new")


def changelog(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], order: str | None = None) -> DataFrame:
    """One row a change: added and removed keys, and each modified field with its values ('—' for blank).

    Where ``order`` is given, the last row of a repeated key counts and blank keys go.
    """
    if order:
        old, new = last_of(old, keys, order), last_of(new, keys, order)
    diff = diff_join(old, new, keys, values).filter("kind <> 'same'")
    blank = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—"))
    fields = F.array(*[F.struct(F.lit(v).alias("field"), blank(f"old_{v}").alias("old"), blank(f"new_{v}").alias("new"), F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")).alias("same")) for v in values])
    modified = diff.filter("kind = 'modified'").select(*keys, "kind", F.explode(F.filter(fields, lambda f: ~f["same"])).alias("f")).select(*keys, "kind", "f.field", "f.old", "f.new")
    whole = diff.filter("kind <> 'modified'").select(*keys, "kind", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    return modified.unionByName(whole)


def upsert_feed(feed: DataFrame, snapshot: DataFrame, key: Sequence[str], digest: str, value_columns: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Next feed and the action for each key: insert, update (digest differs), touch; absent keys stay.

    A key that the snapshot repeats counts once, first in ``order``.
    """
    first = preferred(snapshot, key, order)
    old = feed.select(*key, *[F.col(c).alias(f"_o_{c}") for c in [digest, *value_columns]], F.lit(True).alias("_old"))
    new = first.select(*key, *[F.col(c).alias(f"_n_{c}") for c in [digest, *value_columns]], F.lit(True).alias("_new"))
    joined = old.join(new, list(key), "full_outer")
    action = F.when(F.col("_new").isNull(), "keep").when(F.col("_old").isNull(), "insert").when(~F.col(f"_o_{digest}").eqNullSafe(F.col(f"_n_{digest}")), "update").otherwise("touch")
    joined = joined.withColumn("action", action)
    fresh = F.col("action").isin("insert", "update")
    nxt = joined.select(*key, *[F.when(fresh, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}")).alias(c) for c in [digest, *value_columns]])
    return nxt, joined.select(*key, "action")


def sync_catalog(known: DataFrame, rows: DataFrame, key: str, values: Sequence[str], active: str, order: str | None = None) -> DataFrame:
    """Known keys take non-blank values; unknown active ones come in; nothing is deleted.

    Of rows that repeat a key the last in ``order`` counts; without it, and for ties, the greatest values.
    """
    place = F.struct(F.lit(0) if order is None else F.col(order), F.col(active), *values)
    rows = rows.groupBy(key).agg(F.max_by(F.struct(*values, active), place).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in [*values, active]])
    a = known.select(key, *[F.col(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_known"))
    b = rows.select(key, *[F.col(v).alias(f"_n_{v}") for v in values], F.col(active).alias("_active"), F.lit(True).alias("_seen"))
    joined = a.join(b, key, "full_outer").filter(F.col("_known").isNotNull() | F.col("_active"))
    action = F.when(F.col("_known").isNull(), "added").when(F.col("_seen").isNull(), "kept").otherwise("updated")
    return joined.select(key, *[F.coalesce(F.nullif(F.col(f"_n_{v}"), F.lit("")), F.col(f"_o_{v}")).alias(v) for v in values], action.alias("action"))


def backfill_defaults(df: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(v)) for c, v in defaults.items()})


def backfill_link(child: DataFrame, parent: DataFrame, on: str, fk: str, pk: str) -> DataFrame:
    """A missing link is filled from the parent with the same key."""
    links = parent.groupBy(on).agg(F.min(pk).alias("_pk"))
    return child.join(links, on, "left").withColumn(fk, F.coalesce(fk, "_pk")).drop("_pk")


def selection_diff(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys with ``kind`` added or removed."""
    added = new.select(key).distinct().join(current.select(key), key, "left_anti").withColumn("kind", F.lit("added"))
    return added.unionByName(current.select(key).distinct().join(new.select(key), key, "left_anti").withColumn("kind", F.lit("removed")))


def sort_listing(df: DataFrame, invalid: Column, value: Column, text: Column, tie: Column, name: str = "position") -> DataFrame:
    """Position with invalid values last whichever way ``value`` runs."""
    return global_position(df, [invalid.cast("int").asc(), value, text, tie], name)


def recent(feed: DataFrame, n: int = 10) -> DataFrame:
    """The newest items of a feed, without those that the caller has taken out."""
    return feed.orderBy(F.desc("first_seen"), F.desc("id")).limit(n)


def recover_transitions(df: DataFrame, status: str, evidence: str, since: str, now: Column, seconds: int, moves: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Items stuck in a state for too long finish if the evidence is there and roll back if not."""
    stuck = F.unix_timestamp(since) < F.unix_timestamp(now) - seconds
    out = F.col(status)
    for state, (done, back) in moves.items():
        out = F.when((F.col(status) == state) & stuck, F.when(F.col(evidence), done).otherwise(back)).otherwise(out)
    return df.withColumn("next_status", out)
