"""Ranks of a linked list that is spread over a cluster.

The list is (arc, next), ``next`` null at its end.  A round sorts what is left of it
by range and contracts blocks of ``BLOCK`` consecutive rows: arcs whose successor is
in the same block form chains, of which only the first arc stays, with the chain's
length and successor; the others note their first arc and their distance to it.
Rounds in the order of the arcs use that neighbours in the list tend to have
neighbouring numbers.  Where they do not, and a round leaves over half of its arcs,
the next one sorts by random mates: half of the arcs (by a hash) stand next to their
successor if it is of the other half, so that a quarter of all links is contracted
whatever the numbers are.  When one block holds all that is left, its ranks are known,
and the rounds are undone in reverse, each by one join with the chains' first arcs.

Rounds are about log(n / BLOCK) with neighbourly numbers.  A round's rows are written, so
that a lost executor costs no round again.  No task holds more than a block.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

BLOCK = 1 << 15
SCHEMA = "arc long, head long, off long, next long, weight long"


def chains(arc: np.ndarray, after: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first arc, distance to it, its successor, its weight) of the chains of a block, for each arc; ``after`` is -1 at the end.

    The last two hold for first arcs.
    """
    order = np.argsort(arc, kind="stable")
    at = np.searchsorted(arc[order], after)
    here = np.minimum(at, len(arc) - 1)
    inside = arc[order][here] == after
    before = np.full(len(arc), -1)
    before[order[here[inside]]] = np.flatnonzero(inside)
    first = np.where(before < 0, np.arange(len(arc)), before)
    off = np.where(before < 0, 0, weight[before])
    while True:  # pointer jumping inside the block
        further = first[first]
        if (further == first).all():
            break
        off = off + off[first]
        first = further
    successor, total = np.full(len(arc), -1), np.zeros(len(arc), "int64")
    last = np.flatnonzero(~inside)
    successor[first[last]] = after[last]
    total[first[last]] = off[last] + weight[last]
    return arc[first], off, successor, total


def contract(left: DataFrame, name: str, whole: bool = False) -> DataFrame:
    """One round over rows (arc, next, weight, by), in the order of ``by``; ``whole``: as one block, for what fits one."""

    def run(it):
        import pyarrow as pa

        held, n = [], 0

        def block():
            table = pa.Table.from_batches(held)
            arc = table.column("arc").to_numpy()
            first, off, successor, total = chains(arc, table.column("next").fill_null(-1).to_numpy(), table.column("weight").to_numpy())
            stays = first == arc
            return pa.RecordBatch.from_arrays(
                [pa.array(arc), pa.array(first), pa.array(off), pa.array(successor, mask=~stays | (successor < 0)), pa.array(total, mask=~stays)],
                names=["arc", "head", "off", "next", "weight"],
            )

        for batch in it:
            while batch.num_rows:
                part = batch if whole else batch.slice(0, BLOCK - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n >= BLOCK and not whole:
                    yield block()
                    held, n = [], 0
        if held:
            yield block()

    dealt = left.coalesce(1) if whole else left.repartitionByRange("by", "arc").sortWithinPartitions("by", "arc")
    return materialise(dealt.mapInArrow(tidy(run), SCHEMA), name)


def mates(round_: int):
    """Order in which arcs of one half stand next to their successor of the other."""
    half = lambda c: F.xxhash64(c, F.lit(round_)).bitwiseAND(F.lit(1))
    return F.xxhash64(F.when((half("arc") == 1) & (half("next") == 0), F.col("next")).otherwise(F.col("arc")), F.lit(round_))


def ranks(links: DataFrame, block: int | None = None) -> DataFrame:
    """(arc, position): how many arcs come before each; ``links`` (arc, next) is one list.  The successor of an arc is unique, and so is its predecessor."""
    block = block or BLOCK
    left, n, rounds, spread = links.select("arc", "next", F.lit(1).cast("long").alias("weight")), links.count(), [], False
    while n > block:
        by = mates(len(rounds)) if spread else F.col("arc")
        done = contract(left.withColumn("by", by), "contracted")
        rounds.append(done)
        left = done.filter("arc = head").select("arc", "next", "weight")
        before, n = n, left.count()
        spread = 2 * n > before
    last = contract(left.withColumn("by", F.col("arc")), "contracted", whole=True)
    placed = last.select("arc", F.col("off").alias("position"))
    for done in reversed(rounds):
        heads = placed.select(F.col("arc").alias("head"), F.col("position").alias("_from"))
        placed = done.select("arc", "head", "off").join(heads, "head").select("arc", (F.col("_from") + F.col("off")).alias("position"))
    return placed
