"""Upkeep of a feed: guards, comparisons of two sights of an item, repairs and retention.

Every function is a plan over DataFrames.  A null flag counts as false, a null
text as blank; rows are never dropped unless the name says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .feed import REJECTED, diff_join, last_of, preferred


def flag(name: str | Column) -> Column:
    return F.coalesce(F.col(name) if isinstance(name, str) else name, F.lit(False))


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def removable_duplicate(published: str) -> Column:
    """Published, never promoted, without data, analysis or rejection."""
    return (F.coalesce(F.col("status"), F.lit("")) == published) & F.col("promoted_at").isNull() & ~flag("has_data") & ~flag("has_analysis") & ~flag("rejected")


def should_be_promoted(statuses: Sequence[str]) -> Column:
    """Worked on already: by status, marked interest, stored data or an analysis."""
    interest = ~F.coalesce("interest", F.lit("none")).isin("none", "")
    return flag(F.col("status").isin(*statuses)) | interest | flag("has_data") | flag("has_analysis")


def empty_snapshot_guard(old: DataFrame, new: DataFrame, key: str, contents: Sequence[str], known: bool = False) -> DataFrame:
    """``new`` with ``quarantined``: every content list is empty although the old row had something; with ``known`` only rows that have an old one."""
    some = lambda d: F.greatest(*[F.coalesce(F.size(F.col(c)), F.lit(0)) for c in contents], F.lit(0)) > 0
    had = old.groupBy(key).agg(F.bool_or(some(old)).alias("_had"))
    return new.join(had, key, "inner" if known else "left").withColumn("quarantined", flag("_had") & ~some(new)).drop("_had")


def merge_stored(new: DataFrame, stored: DataFrame, key: str, file: str = "file", title: str = "title") -> DataFrame:
    """``new`` with the stored file name, and the stored title unless it is a size label; blanks do not win."""
    kept = stored.select(key, F.col(file).alias("_file"), F.col(title).alias("_title"))
    good_title = ~blank(F.col("_title")) & ~flag(tx.looks_like_size_label(F.col("_title")))
    joined = new.join(kept, key, "left")
    return joined.withColumns({file: F.when(~blank(F.col("_file")), F.trim("_file")).otherwise(F.col(file)), title: F.when(good_title, F.trim("_title")).otherwise(F.col(title))}).drop("_file", "_title")


def profile_for_source(items: DataFrame, profiles: Sequence[tuple[str, Sequence[str]]], source: str, default: str) -> DataFrame:
    """``profile``: the first of the configured profiles that lists the source (any case), else the default."""
    mine = F.lower(F.trim(F.coalesce(F.col(source), F.lit(""))))
    found = [F.when(mine.isin(*[s.lower() for s in sources]), F.lit(name)) for name, sources in profiles if sources]
    return items.withColumn("profile", F.coalesce(*found, F.lit(default)))


def bucket_counts(feed: DataFrame, ids: DataFrame, buckets: Mapping[str, Sequence[str]]) -> DataFrame:
    """(entity_id, a count a bucket of statuses) over the given entities; those without items get zeros."""
    counts = feed.groupBy("entity_id").agg(*[F.count_if(F.col("status").isin(*s)).alias(n) for n, s in buckets.items()])
    return ids.select("entity_id").distinct().join(counts, "entity_id", "left").na.fill(0, list(buckets))


def action_counts(actions: DataFrame, action: str = "action") -> DataFrame:
    return actions.groupBy(action).agg(F.count("*").alias("n"))


def max_rank(df: DataFrame, groups: Sequence[str], rank: str) -> DataFrame:
    """Highest rank of each list, 0 where no row has one."""
    return df.groupBy(*groups).agg(F.coalesce(F.max(rank), F.lit(0)).alias("max_rank"))


def first_in_listing(rows: DataFrame, keys: Sequence[str], page: str, row: str, page_cap: int = 200) -> DataFrame:
    """First sight of each key, pages and rows from the top; the portal's page cap is the feature."""
    return preferred(rows.filter(F.col(page) < page_cap), keys, [F.asc(page), F.asc(row)])


def backfill_rank(df: DataFrame, groups: Sequence[str], rank: str, order: Sequence[Column]) -> DataFrame:
    """``new_rank`` 1..n in lists where a rank is missing (present ranks first), elsewhere the old rank; ``changed`` says where it differs."""
    missing = F.max(F.col(rank).isNull()).over(Window.partitionBy(*groups))
    number = F.row_number().over(Window.partitionBy(*groups).orderBy(F.asc_nulls_last(rank), *order))
    out = df.withColumn("new_rank", F.when(missing, number).otherwise(F.col(rank)))
    return out.withColumn("changed", ~F.col("new_rank").eqNullSafe(F.col(rank)))


def cap_history(changes: DataFrame, item: str, order: Sequence[Column], n: int = 100) -> DataFrame:
    """The newest ``n`` changes of each item."""
    return changes.withColumn("_n", F.row_number().over(Window.partitionBy(item).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def version_history(versions: DataFrame, item: str, started: str, tie: str) -> DataFrame:
    """``valid_to``: the start of the item's next version, null for the current one, and ``is_current``."""
    following = F.lead(started).over(Window.partitionBy(item).orderBy(started, tie))
    return versions.withColumn("valid_to", following).withColumn("is_current", F.lead(F.lit(1)).over(Window.partitionBy(item).orderBy(started, tie)).isNull())


def default_choice(files: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``chosen``: true for exactly one row of each group, the first in order."""
    return files.withColumn("chosen", F.row_number().over(Window.partitionBy(group).orderBy(*order)) == 1)


def sort_rank(c: Column, ranks: Mapping[str, int], unknown: int = 99) -> Column:
    """Place of a value in a custom order."""
    out = F.lit(unknown)
    for value, rank in ranks.items():
        out = F.when(c == value, rank).otherwise(out)
    return out


def best_candidate(files: DataFrame, group: str, score: str, name: str) -> DataFrame:
    """(group, best, n): the highest non-negative score, then the first name in lower case; null if there is none."""
    good = F.col(score) >= 0
    best = F.min_by(F.when(good, F.col(name)), F.when(good, F.struct(-F.col(score), F.lower(name), F.col(name))))
    return files.groupBy(group).agg(best.alias("best"), F.count_if(good).alias("n"))


def discarded_listing(feed: DataFrame, rejected: DataFrame, discarded: str) -> DataFrame:
    """Items discarded by hand or rejected for the tenant, with ``branch``."""
    marked = rejected.select("id").distinct().withColumn("_r", F.lit(True))
    branch = F.when(F.col("status") == discarded, discarded).when(F.col("_r"), REJECTED)
    return feed.join(marked, "id", "left").withColumn("branch", branch).filter("branch IS NOT NULL").drop("_r")


def unknown_members(selected: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Selected keys that are not known; a null key is unknown."""
    return selected.select(key).distinct().join(known.select(key), key, "left_anti")


def completeness(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(kind, severity, key) of keys missing (critical) or extra (minor), null keys left out."""
    a = expected.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_e", F.lit(True))
    b = actual.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(True))
    both = a.join(b, key, "full_outer").filter("_e IS NULL OR _a IS NULL")
    return both.select(F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("kind"), F.when(F.col("_a").isNull(), "critical").otherwise("minor").alias("severity"), key)


def added_ids(old: str, new: str) -> Column:
    """Sorted ids of array ``new`` that array ``old`` lacks; null arrays are empty."""
    none = F.array().cast("array<bigint>")
    return F.array_sort(F.array_except(F.coalesce(new, none), F.coalesce(old, none)))


def union_sources(feeds: Mapping[str, DataFrame], key: str) -> DataFrame:
    """All feeds as one with ``source`` and ``feed_key``, which keeps the key spaces apart; absent columns are null."""
    out = None
    for name, df in feeds.items():
        own = df.withColumns({"source": F.lit(name), "feed_key": F.concat(F.lit(f"{name}:"), F.col(key).cast("string"))})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def ranges_covered(plan: DataFrame, read: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned ranges that nobody reported as read."""
    return plan.join(read.select(*keys).distinct(), list(keys), "left_anti")


def keys_agree(a: DataFrame, b: DataFrame, group: str, key: str) -> DataFrame:
    """(group, same): whether both sides hold the same set of keys in each group."""
    left = a.select(group, key).distinct().withColumn("_a", F.lit(1))
    right = b.select(group, key).distinct().withColumn("_b", F.lit(1))
    return left.join(right, [group, key], "full_outer").groupBy(group).agg(F.bool_and(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("same"))


def documents_equal(old: DataFrame, new: DataFrame, item: str, uuid: str, fields: Sequence[str], date: str, order: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """(item, docs_equal): same ids with the same fields; dates count only if both are filled.  Rows without an id do not count.

    Of rows that repeat an id the last in ``order`` counts.  With ``items`` every
    one of them has a row: an item without documents on both sides is equal.
    """
    known = lambda df: last_of(df, [item, uuid], order) if order else df.filter(~blank(F.col(uuid)))
    d = diff_join(known(old), known(new), [item, uuid], [*fields, date])
    same = F.col("kind").isin("same", "modified")
    for f in fields:
        same = same & (F.trim(F.coalesce(f"old_{f}", F.lit(""))) == F.trim(F.coalesce(f"new_{f}", F.lit(""))))
    a, b = F.col(f"old_{date}"), F.col(f"new_{date}")
    same = same & (blank(a) | blank(b) | (F.trim(a.cast("string")) == F.trim(b.cast("string"))))
    out = d.groupBy(item).agg(F.bool_and(flag(same)).alias("docs_equal"))
    return out if items is None else items.select(item).distinct().join(out, item, "left").withColumn("docs_equal", F.coalesce("docs_equal", F.lit(True)))


def schedule_equal(old: DataFrame, new: DataFrame, item: str, pos: str, fields: Sequence[str], stage: str | None = None, noise: Sequence[str] = ()) -> DataFrame:
    """(item, schedule_equal): both ordered lists have the same rows after folding blanks and, in ``stage``, without the noise phrases."""
    folded = lambda f: F.trim(F.regexp_replace(F.coalesce(F.col(f).cast("string"), F.lit("")), r"\s+", " "))
    text = lambda f: tx.remove_phrases(folded(f), noise) if f == stage else folded(f)
    clean = lambda df: df.select(item, pos, *[text(f).alias(f) for f in fields])
    return diff_join(clean(old), clean(new), [item, pos], fields).groupBy(item).agg(F.bool_and(F.col("kind") == "same").alias("schedule_equal"))


def schedule_view(current: DataFrame, previous: DataFrame, item: str, stage: str, fields: Sequence[str]) -> DataFrame:
    """Current and vanished stages with ``is_new``, ``is_removed``, ``changed`` and the previous value of changed fields.

    An item without previous stages is not marked at all.  A stage repeated in
    ``previous`` must have been reduced to one row (the last wins).
    """
    d = diff_join(previous, current, [item, stage], fields)
    tracked = previous.select(item).distinct().withColumn("_tracked", F.lit(True))
    d = d.join(tracked, item, "left")
    new, gone = flag("_tracked") & (F.col("kind") == "added"), F.col("kind") == "removed"
    out = d.withColumns({"is_new": new, "is_removed": gone, "changed": new | gone | (F.col("kind") == "modified")})
    prev = [F.when(gone | (F.col("kind") == "modified") & ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.col(f"old_{f}")).alias(f"{f}_prev") for f in fields]
    return out.select(item, stage, *[F.col(f"new_{f}").alias(f) for f in fields], *prev, "is_new", "is_removed", "changed")


def change_label(changes: DataFrame, block: str) -> DataFrame:
    """(block, label): the latest document date if all changes are new documents and one is dated, else the scan time."""
    only = F.bool_and(flag((F.col("area") == "documento") & (F.col("kind") == "added")))
    return changes.groupBy(block).agg(F.when(only & F.max("doc_date").isNotNull(), F.max("doc_date")).otherwise(F.max("at")).alias("label"))


def adopt_republication(claimed: DataFrame, sights: DataFrame, feed: DataFrame, decisions: DataFrame, published: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claimed items with their reference, next feed, next decisions) after new sights of claimed items.

    ``sights`` is (id, new_ref).  A removable published twin that holds the new
    reference goes with all its decisions; the reference is adopted if it is then
    free and advances.  Of several sights of an item the highest counts.
    """
    best = sights.groupBy("id").agg(F.max_by("new_ref", tx.nid_int(F.col("new_ref"))).alias("new_ref"))
    twin = feed.select(F.col("source_ref").alias("new_ref"), F.col("id").alias("twin"), removable_duplicate(published).alias("_free"))
    held = best.join(twin, "new_ref", "left").filter("twin IS NULL OR twin <> id")
    per = held.groupBy("id", "new_ref").agg(F.bool_and(F.coalesce("_free", F.lit(True))).alias("_open"))
    gone = held.filter(flag("_free")).select(F.col("twin").alias("id")).distinct()
    out = claimed.join(per, "id", "left")
    moved = flag("_open") & flag(tx.nid_advances(F.col("source_ref"), F.col("new_ref")))
    adopted = out.withColumn("adopted", moved).withColumn("source_ref", F.when(moved, F.col("new_ref")).otherwise(F.col("source_ref"))).drop("_open", "new_ref")
    return adopted, feed.join(gone, "id", "left_anti"), decisions.join(gone.withColumnRenamed("id", "feed_item_id"), "feed_item_id", "left_anti")


def snapshot_pipeline(feed: DataFrame, pipeline: DataFrame, values: Sequence[str], refresh: bool) -> DataFrame:
    """Next pipeline keyed by origin id: promoted items are copied once, and refreshed only if asked."""
    new = feed.filter("promoted_at IS NOT NULL").select(F.col("id").alias("origin_feed_id"), *[F.col(v).alias(f"_n_{v}") for v in values], F.lit(True).alias("_new"))
    old = pipeline.select("origin_feed_id", *[F.col(v).alias(f"_o_{v}") for v in values], F.lit(True).alias("_old"))
    joined = old.join(new, "origin_feed_id", "full_outer")
    take = F.col("_old").isNull() | (F.col("_new").isNotNull() if refresh else F.lit(False))
    return joined.select("origin_feed_id", *[F.when(take, F.col(f"_n_{v}")).otherwise(F.col(f"_o_{v}")).alias(v) for v in values], F.when(F.col("_old").isNull(), "insert").when(take, "refresh").otherwise("keep").alias("action"))


def table_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, digest) of a table whatever its row order: partial aggregates, one row out."""
    h = F.xxhash64(*[F.col(c) for c in columns])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("s")).select("rows", F.concat_ws(":", F.hex("x"), F.col("s").cast("string")).alias("digest"))


def hash_gate(new: DataFrame, columns: Sequence[str], known_digest: str | None, forced: bool = False) -> DataFrame:
    """``new``, or no rows if its digest (one row, read here) is the known one and the load is not forced."""
    same = not forced and known_digest is not None and table_digest(new, columns).first()["digest"] == known_digest
    return new.filter(F.lit(not same))


def removal_policy(feed: DataFrame, ids: DataFrame, policy: str, *, busy: Column, analyzed: Sequence[str], downloaded: Sequence[str], published: str, discarded: str, archived: str) -> DataFrame:
    """``next_status`` and ``outcome`` (kept, deferred, affected) of items whose entity was taken out; other rows are kept."""
    if policy not in ("keep_all", "keep_analyzed", "discard_all"):
        raise ValueError(f"unknown policy {policy}")
    mine = feed.join(ids.select("entity_id").distinct().withColumn("_out", F.lit(True)), "entity_id", "left")
    status = F.col("status")
    target = F.when(status.isin(*downloaded, published), discarded)
    if policy == "discard_all":
        target = F.when(status.isin(*analyzed), archived).otherwise(target)
    acts = flag("_out") if policy != "keep_all" else F.lit(False)
    outcome = F.when(~acts, "kept").when(flag(busy), "deferred").when(target.isNotNull(), "affected").otherwise("kept")
    return mine.withColumn("outcome", outcome).withColumn("next_status", F.when(F.col("outcome") == "affected", target).otherwise(status)).drop("_out")


def backfill_overlay(feed: DataFrame, decisions: DataFrame, tenant: str) -> DataFrame:
    """Decisions that the feed's own marks imply and the tenant lacks: exempt first, else rejected with its rule."""
    mine = decisions.filter(F.col("tenant_id") == tenant).select(F.col("feed_item_id").alias("id"))
    exempt, rejected = flag("exempt"), flag(F.col("status") == REJECTED)
    reason = F.when(~exempt, F.col("reason"))
    todo = feed.filter(exempt | rejected).join(mine, "id", "left_anti")
    return todo.select(F.lit(tenant).alias("tenant_id"), F.col("id").alias("feed_item_id"), F.when(exempt, "exempt").otherwise(REJECTED).alias("decision"), F.trim(F.substring_index(reason, ":", 1)).alias("rule_id"), reason.alias("reason"))


def repair_missing(feed: DataFrame, manifest: DataFrame, *, needs_data: Sequence[str], archived: str, analyzed: str, published: str, discarded: str) -> DataFrame:
    """``next_status`` and ``cleared`` from what is really stored (``manifest`` lists ids that have data)."""
    stored = manifest.select("id").distinct().withColumn("_stored", F.lit(True))
    out = feed.join(stored, "id", "left")
    lost = ~flag("_stored")
    status, done = F.col("status"), flag("analysis_done")
    nxt = F.when(lost & status.isin(*needs_data), published).when(lost & (status == archived), F.when(done, analyzed).otherwise(published)).otherwise(status)
    cleared = lost & flag(status.isin(*needs_data, archived)) | flag(status == discarded) & (~lost | flag("has_analysis"))
    return out.withColumn("next_status", nxt).withColumn("cleared", cleared).drop("_stored")


def preserve_removed(old: DataFrame, new: DataFrame, item: str, uuid: str, now: Column, items: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """(item, uuid, removed, removed_at, compared): current documents and vanished ones worth keeping.

    ``old`` has removed, removed_at and has_file.  Vanished documents stay,
    flagged, if a file is stored; flagged ones stay until they come back.
    ``compared`` is false for rows that were flagged before.  With ``items``
    (one row each) their documents are compared alone: old ones of others stay as
    they are, new ones are left out.  Both sides are dealt into ``parts``, if given.
    """
    was = old.select(item, uuid, flag("removed").alias("_was"), F.col("removed_at").alias("_at"), flag("has_file").alias("_file"))
    seen = new.select(item, uuid)
    if parts:
        was, seen = was.repartition(parts, item, uuid), seen.repartition(parts, item, uuid)
    joined = was.join(seen.distinct().withColumn("_new", F.lit(True)), [item, uuid], "full_outer")
    mine, here = F.lit(True), flag("_new")
    if items is not None:
        own = items.select(item, F.lit(True).alias("_mine"))
        joined, mine = joined.join(own.hint("shuffle_hash") if parts else own, item, "left"), flag("_mine")
    kept = joined.filter(F.when(mine, here | flag("_was") | flag("_file")).otherwise(F.col("_was").isNotNull()))
    removed, since = F.when(mine, ~here).otherwise(flag("_was")), F.when(~mine | flag("_was"), F.col("_at")).otherwise(now)
    return kept.select(item, uuid, removed.alias("removed"), F.when(~mine | ~here, since).alias("removed_at"), (mine & ~flag("_was")).alias("compared"))


def retention_split(feed: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """``purge``: never promoted and not seen for so many days; a null last sight is kept."""
    old = F.unix_timestamp("last_seen") < F.unix_timestamp(now) - 86_400 * days
    return feed.withColumn("purge", F.col("promoted_at").isNull() & flag(old))


def mark_unread(df: DataFrame, changed: Column, current: str, previous: str, unread: str = "unread") -> DataFrame:
    """The first previous value not read yet stays until it is read."""
    latch = F.when(flag(changed) & F.col(current).isNotNull() & (~flag(unread) | F.col(previous).isNull()), F.col(current)).otherwise(F.col(previous))
    return df.withColumns({previous: latch, unread: flag(unread) | flag(changed)})


def mark_read(df: DataFrame, previous: Sequence[str], unread: str = "unread") -> DataFrame:
    return df.withColumns({p: F.lit(None).cast(df.schema[p].dataType) for p in previous} | {unread: F.lit(False)})


def orphan_paths(files: DataFrame, feed: DataFrame, path: str, statuses: Sequence[str]) -> DataFrame:
    """Stored paths that no row in a status with data refers to: a report, nothing is deleted."""
    held = feed.filter(F.col("status").isin(*statuses)).select(path)
    return files.select(path).distinct().join(held, path, "left_anti")


def apply_rules(feed: DataFrame, rule: Column, sources: Sequence[str]) -> DataFrame:
    """New decisions of the rules on existing rows of the sources: (feed_item_id, rule_id)."""
    return feed.filter(F.col("source").isin(*sources)).select(F.col("id").alias("feed_item_id"), rule.alias("rule_id")).filter("rule_id IS NOT NULL")
