"""Exact top-k by integer inner product over a pivot-distance index.

Components become integers floor(256 x).  With M the largest squared length, an
extra component sqrt(M - |x|^2) puts all rows on one sphere, so that the largest
inner product with q is the smallest distance to (q, 0).  Each row is filed under
its nearest pivot and its distance to it; rows of a pivot at like distance form
an annulus.  At most ``PIVOTS * RINGS`` annuli exist whatever the input, so their
table (pivot, range of distances, rows) is small enough to send everywhere.  By
the triangle inequality a query's distances to the pivots bound the best score in
each annulus.

A first pass searches the group of annuli that holds each query's best bound and
leaves its k-th score as a threshold; the second visits every other group with an
annulus that can still reach it, expands the annuli from the best bound down and
stops where the bound falls below the k-th score.  Large annuli are dealt into
several groups.  A group of annuli is copied only to the blocks of queries that
the bounds route to it.  Each vector length is an index of its own.

Sums run in doubles where they are exact and in 64-bit integers elsewhere, where no
partial sum can overflow: it is at most the product of two lengths.  Rows whose squared
length could reach 2^63 raise an error before the search.  Scores and thresholds are
integers; bounds are doubles, with a slack in proportion to the squares that they are
made of.  See ``vectors`` for nulls, ties and repeated rows; further columns,
whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .vectors import CANDIDATE_BLOCK, CANDIDATE_BYTES, EVERY, QUERY_BLOCK, QUERY_BYTES, K, block_count, block_rows, query_rows, ranked, usable

PIVOTS = 48
RINGS = 256
UNITS = 256
NONE = -(2**63)  # threshold of a query without one


def integers(v: np.ndarray) -> np.ndarray:
    return np.floor(v * UNITS)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows."""
    if len(q) and len(x) and np.abs(q).max() * np.abs(x).max() * q.shape[1] >= 2**53:
        return q.astype("int64") @ x.astype("int64").T
    return q @ x.T


def pivot_distances(v: np.ndarray, squares: np.ndarray, lift: np.ndarray, pivots: np.ndarray, pivot_squares: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    """Distances of lifted rows to lifted pivots."""
    return np.sqrt(np.maximum(squares[:, None] + pivot_squares - 2 * (v @ pivots.T) + (lift[:, None] - pivot_lift) ** 2, 0))


class Bounds:
    """Pivots and annuli, from which the best possible score of a query in each annulus follows."""

    def __init__(self, largest: float, pivots: np.ndarray, annuli: pd.DataFrame):
        self.largest, self.pivots = largest, pivots
        self.squares = (pivots * pivots).sum(axis=1)
        self.lift = np.sqrt(np.maximum(largest - self.squares, 0))
        self.annuli = annuli

    def file(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance of each row."""
        squares = (v * v).sum(axis=1)
        d = pivot_distances(v, squares, np.sqrt(np.maximum(self.largest - squares, 0)), self.pivots, self.squares, self.lift)
        nearest = d.argmin(axis=1)
        return nearest, d[np.arange(len(v)), nearest]

    def best_scores(self, q: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Queries x annuli: no row of the annulus scores higher."""
        squares = (q * q).sum(axis=1)
        d = pivot_distances(q, squares, np.zeros(len(q)), self.pivots, self.squares, self.lift)[:, pivot]
        gap = np.maximum(np.maximum(low - d, d - high) * (1 - 1e-9) - 1e-6 * (1 + np.sqrt(self.largest)) * max(1, np.sqrt(q.shape[1] / 256)), 0)
        both = squares[:, None] + self.largest
        return (both - gap * gap) / 2 + 1e-11 * both + 1


def expand(rows: pd.DataFrame, queries: pd.DataFrame, bounds: Bounds, k: int) -> pd.DataFrame:
    """The k best rows of one group for each query, with scores at or over the query's threshold."""
    empty = pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0, "int64")})
    if not len(rows) or not len(queries):
        return empty
    rows = rows.sort_values(["pivot", "ring", "distance"])
    x, ids = np.stack(rows["v"].to_numpy()), rows["vec_id"].to_numpy()
    key = rows["pivot"].to_numpy() * np.int64(RINGS + 2) + rows["ring"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.concatenate([starts[1:], [len(key)]])
    distance = rows["distance"].to_numpy()
    q, q_id = np.stack(queries["v"].to_numpy()), queries["vec_id"].to_numpy()
    low, high = np.minimum.reduceat(distance, starts), np.maximum.reduceat(distance, starts)
    best = bounds.best_scores(q, rows["pivot"].to_numpy()[starts], low, high)
    kth = queries["threshold"].to_numpy().copy()
    held: list[list[tuple]] = [[] for _ in q_id]
    for ring in np.argsort(-best.max(axis=0)):
        asks = np.flatnonzero(best[:, ring] >= kth)
        if not len(asks):
            continue
        part = slice(starts[ring], ends[ring])
        score = products(q[asks], x[part])
        wanted = (score >= kth[asks, None]) & (q_id[asks, None] != ids[part])
        for row in np.flatnonzero(wanted.any(axis=1)):
            at = np.flatnonzero(wanted[row])
            own = held[asks[row]]
            own += [(-int(s), int(i)) for s, i in zip(score[row, at], ids[part][at], strict=True)]
            own.sort()
            del own[k:]
            if len(own) == k:
                kth[asks[row]] = max(kth[asks[row]], -own[-1][0])
    found = [(i, v, -s) for i, own in zip(q_id, held, strict=True) for s, v in own]
    return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64") if found else empty


def _search_dim(rows: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    spark = rows.sparkSession
    far = F.aggregate("v", F.lit(0.0), lambda a, x: a + (F.abs(x * UNITS) + 1) * (F.abs(x * UNITS) + 1))
    if (farthest := rows.filter(F.col("dim") == dim).agg(F.max(far)).first()[0]) >= 2.0**63:
        raise ValueError(f"inner products of vectors with {dim} components may exceed 64 bits: the largest squared length is {farthest:.3g}")
    whole = rows.filter(F.col("dim") == dim).select("vec_id", F.transform("v", lambda x: F.floor(x * UNITS).cast("double")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, largest = whole.agg(F.count("*"), F.max(square)).first()
    sample = whole.select("v").orderBy(F.xxhash64("v")).limit(PIVOTS).toPandas()["v"]  # a fixed number of rows
    pivots = np.unique(np.stack(sample.to_numpy()), axis=0)
    plain = Bounds(float(largest), pivots, pd.DataFrame())
    width = max(2 * np.sqrt(plain.largest), 1e-9) / RINGS

    def filed(it):
        for part in it:
            if len(part):
                part["pivot"], part["distance"] = plain.file(np.stack(part["v"].to_numpy()))
                part["ring"] = (part["distance"] / width).astype("int64")
                yield part[["vec_id", "v", "pivot", "ring", "distance"]]

    index = materialise(whole.mapInPandas(filed, "vec_id long, v array<double>, pivot long, ring long, distance double"), "pivots")
    annuli = index.groupBy("pivot", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
    table = annuli.toPandas().sort_values(["pivot", "ring"])  # at most PIVOTS * (RINGS + 1) rows
    most = block_rows(dim, CANDIDATE_BLOCK, CANDIDATE_BYTES)
    groups = block_count(total, most, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table["parts"] = -(-table["n"] // max(1, min(most, -(-total // groups))))
    table["first"] = (table["parts"].cumsum() - table["parts"]) % groups
    bounds = spark.sparkContext.broadcast(Bounds(plain.largest, pivots, table))
    places = F.broadcast(spark.createDataFrame(table[["pivot", "ring", "parts", "first"]]))
    dealt = index.join(places, ["pivot", "ring"]).withColumn("group", F.pmod(F.col("first") + F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(groups)))

    queries = query_rows(rows.filter(F.col("dim") == dim), every).select("vec_id", F.transform("v", lambda x: F.floor(x * UNITS).cast("double")).alias("v"))
    blocks = block_count(queries.count(), block_rows(dim, QUERY_BLOCK, QUERY_BYTES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))

    def routed(first: bool):
        def run(it):
            t = bounds.value.annuli
            pivot, low, high = (t[c].to_numpy() for c in ("pivot", "low", "high"))
            begin, parts = t["first"].to_numpy(), np.minimum(t["parts"].to_numpy(), groups)
            for part in it:
                if not len(part):
                    continue
                best = bounds.value.best_scores(np.stack(part["v"].to_numpy()), pivot, low, high)
                if first:
                    part["group"] = begin[best.argmax(axis=1)]
                    part["threshold"] = NONE
                    yield part[["vec_id", "v", "block", "group", "threshold"]]
                    continue
                hit = best >= part["threshold"].to_numpy().astype("float64")[:, None]
                reach = np.zeros((len(part), groups), bool)
                for ring in range(len(begin)):
                    for p in range(parts[ring]):
                        reach[:, (begin[ring] + p) % groups] |= hit[:, ring]
                who, where = np.nonzero(reach)
                out = part.iloc[who].copy()
                out["group"] = where
                yield out[["vec_id", "v", "block", "group", "threshold"]]

        return run

    schema = "vec_id long, v array<double>, block long, group long, threshold long"

    def visit(asked: DataFrame) -> DataFrame:
        """The best rows of each group for the queries that are routed to it; a group is copied only to blocks with such queries."""
        asked = materialise(asked, "asked")
        pairs = asked.select("group", "block").distinct().select(F.col("group").alias("_group"), F.col("block").alias("_block"))
        left = dealt.join(pairs, F.col("group") == F.col("_group")).select("vec_id", "v", "pivot", "ring", "distance", "group", F.col("_block").alias("block"))
        key = ["group", "block"]
        return left.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(lambda a, b: expand(a, b, bounds.value, k), "query_id long, vec_id long, score long")

    near = visit(queries.mapInPandas(routed(True), schema))
    reached = ranked(near, k).groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias("_least"))
    thresholds = materialise(reached.filter(F.col("_n") >= k).select(F.col("query_id").alias("vec_id"), F.col("_least").alias("threshold")), "thresholds")
    known = queries.join(thresholds, "vec_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(NONE).cast("long")))
    return ranked(visit(known.mapInPandas(routed(False), schema)), k)


def search(df: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest inner products."""
    rows = usable(df, vec_id, embedding)
    dims = [r[0] for r in rows.select("dim").distinct().orderBy("dim").collect()]
    out = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for dim in dims:
        out = out.unionByName(_search_dim(rows, dim, k, every))
    return out
