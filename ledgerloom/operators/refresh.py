"""One refresh cycle over watched items: what is due, what changed, what is kept.

Null flags count as false.  A key that the fresh rows repeat counts once, first
in the order of its values; blank keys of fresh rows take no part; an empty
table on either side leaves the items as they are, but for the time of the check.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feed import changelog, due_for_refresh, preferred
from .ranking import parts_for
from .upkeep import empty_snapshot_guard, flag, mark_unread, preserve_removed

#: Rows of all tables together that a partition gets.  With over 200 partitions Spark sorts a shuffle's rows where they
#: are written as well, in tasks as large as the files' splits, so this is not smaller than what a task sorts with ease.
ROWS = 2_500_000


@dataclass(frozen=True)
class Refreshed:
    """Next items, the log of changes, and the next documents of all items."""

    items: DataFrame
    changes: DataFrame
    documents: DataFrame


def refresh_changes(items: DataFrame, fresh: DataFrame, documents: DataFrame, fresh_documents: DataFrame, key: str, values: Sequence[str], contents: Sequence[str], uuid: str, checked: str, deadline: str, now: Column) -> Refreshed:
    """Due items take their fresh rows; an item without one, or with an emptied one, stays but was checked.

    ``items`` has the values, the lists of ``contents``, previous_{value},
    unread, and the times; ``documents`` has removed, removed_at and has_file.
    The tables are counted, and dealt over so many partitions that a task's share does not grow with them.
    """
    parts = parts_for([items, fresh, documents, fresh_documents], ROWS)
    items, fresh = items.repartition(parts, key), fresh.repartition(parts, key)  # joins and windows by key follow
    due = due_for_refresh(items, now, checked, deadline)
    rows = preferred(fresh, [key], [F.asc_nulls_last(v) for v in values])
    taken = empty_snapshot_guard(due, rows, key, contents, known=True).filter(~F.col("quarantined")).select(key, *values, *contents)
    ids = taken.select(key)
    changes = changelog(due.join(ids, key, "left_semi"), taken, [key], values)

    new = taken.select(key, *[F.col(c).alias(f"_n_{c}") for c in [*values, *contents]], F.lit(True).alias("_taken"))
    nxt = items.join(due.select(key).distinct().withColumn("_due", F.lit(True)), key, "left").join(new, key, "left")
    differs = {v: flag("_taken") & ~F.col(f"_n_{v}").eqNullSafe(F.col(v)) for v in values}
    was = flag("unread")
    for v in values:  # each value has a latch of its own, all share what was unread before
        nxt = mark_unread(nxt.withColumn("_was", was), differs[v], v, f"previous_{v}", "_was").drop("_was")
    some = F.lit(False)
    for d in differs.values():
        some = some | d
    nxt = nxt.withColumn("unread", was | some)
    nxt = nxt.withColumns({c: F.when(flag("_taken"), F.col(f"_n_{c}")).otherwise(F.col(c)) for c in [*values, *contents]} | {checked: F.when(flag("_due"), now).otherwise(F.col(checked))})

    docs = preserve_removed(documents, fresh_documents, key, uuid, now, ids, parts).select(key, uuid, "removed", "removed_at")
    return Refreshed(nxt.select(*items.columns), changes, docs)
