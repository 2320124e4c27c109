"""One scan cycle of a source: what each listed row does to the feed, and the next feed.

Blank references take no part and a repeated one counts once, first in order;
blank keys never match.  An empty snapshot leaves the feed as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .feed import preferred
from .upkeep import adopt_republication, blank, flag


def scan_actions(feed: DataFrame, snapshot: DataFrame, order: Sequence[Column], published: str, terminal: Sequence[str], stale: Column) -> DataFrame:
    """``snapshot`` (source_ref, key, digest, values) with ``action`` and the ``target`` item of each row.

    In this order: ``adopt`` by the claimed item of the key, ``touch`` of a
    terminal item, ``adopt`` by the published item of the key, ``insert`` (the
    first new row of a key; its others are ``join`` to that one), ``update`` where the
    digest differs, ``refresh`` where ``stale`` holds, else ``touch``.
    """
    rows = preferred(snapshot, ["source_ref"], order).withColumn("_key", F.when(~blank(F.col("key")), tx.normalize_key(F.col("key"))))
    own = feed.select("source_ref", F.col("id").alias("_id"), F.col("status").alias("_status"), F.col("digest").alias("_digest"), flag(stale).alias("_stale"))
    keyed = feed.withColumn("_key", F.when(~blank(F.col("key")), tx.normalize_key(F.col("key")))).filter("_key IS NOT NULL")
    newest = lambda df, name: df.groupBy("_key").agg(F.max_by("id", F.struct(tx.nid_int(F.col("source_ref")), F.col("id"))).alias(name))
    claimed = newest(keyed.filter(flag("claimed")), "_claimed")
    twin = newest(keyed.filter((F.col("status") == published) & ~flag("claimed")), "_twin")
    got = rows.join(own, "source_ref", "left").join(claimed, "_key", "left").join(twin, "_key", "left")
    other = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col("_id"))
    dead = flag(F.col("_status").isin(*terminal))
    new = F.col("_id").isNull()
    action = (
        F.when(other("_claimed"), "adopt").when(dead, "touch").when(other("_twin"), "adopt").when(new, "insert")
        .when(~F.col("digest").eqNullSafe(F.col("_digest")), "update").when(F.col("_stale"), "refresh").otherwise("touch")
    )
    target = F.when(other("_claimed"), F.col("_claimed")).when(dead, F.col("_id")).when(other("_twin"), F.col("_twin")).otherwise(F.col("_id"))
    got = got.withColumns({"action": action, "target": target})
    nth = F.row_number().over(Window.partitionBy("action", F.coalesce("_key", F.concat(F.lit("\u0000"), "source_ref"))).orderBy(*order))
    return got.withColumn("action", F.when((F.col("action") == "insert") & (nth > 1), "join").otherwise(F.col("action"))).select(*snapshot.columns, "action", "target")


def scan_cycle(feed: DataFrame, decisions: DataFrame, actions: DataFrame, values: Sequence[str], published: str, now: Column, next_id: Column) -> tuple[DataFrame, DataFrame]:
    """(next feed, next decisions) after ``scan_actions``.

    An inserted row takes the highest reference of its key's new rows and the id
    that ``next_id`` gives it; adopted, updated, refreshed and touched items were
    last seen now.
    """
    sights = actions.filter("action = 'adopt'").select(F.col("target").alias("id"), F.col("source_ref").alias("new_ref"))
    items, left, kept = adopt_republication(feed, sights, feed, decisions, published)
    alive = items.join(left.select("id"), "id", "left_semi").drop("adopted")
    fresh = F.col("action").isin("update", "refresh")
    taken = actions.filter(fresh).select(F.col("target").alias("id"), *[F.col(v).alias(f"_n_{v}") for v in ["digest", *values]], F.lit(True).alias("_fresh"))
    seen = actions.filter("target IS NOT NULL").select(F.col("target").alias("id")).distinct().withColumn("_seen", F.lit(True))
    nxt = alive.join(taken, "id", "left").join(seen, "id", "left")
    nxt = nxt.withColumns({v: F.when(flag("_fresh"), F.col(f"_n_{v}")).otherwise(F.col(v)) for v in ["digest", *values]} | {"last_seen": F.when(flag("_seen"), now).otherwise(F.col("last_seen"))}).select(*feed.columns)

    group = F.coalesce(F.when(~blank(F.col("key")), tx.normalize_key(F.col("key"))), F.concat(F.lit("\u0000"), "source_ref"))
    new = actions.filter(F.col("action").isin("insert", "join")).withColumn("_group", group)
    highest = new.groupBy("_group").agg(F.max_by("source_ref", tx.nid_int(F.col("source_ref"))).alias("_ref"))
    new = new.filter("action = 'insert'").join(highest, "_group").withColumns({"id": next_id, "source_ref": F.col("_ref"), "status": F.lit(published), "last_seen": now})
    columns = [F.col(c) if c in new.columns else F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in feed.columns]
    return nxt.unionByName(new.select(*columns)), kept
