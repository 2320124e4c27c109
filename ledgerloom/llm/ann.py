"""Nearest neighbours by cosine as a blocked matrix join.

Candidates and queries are dealt into blocks of bounded size; one task takes one
tile (query block x candidate block).  Unit vectors are quantised to int8, a tile
of integer products gives every cosine up to an error that the quantisation
residuals bound, and only pairs whose upper bound reaches the k-th best lower
bound are computed again in double precision from the original vectors.  The k
best of each tile meet in a heap of k a query, so the result is exact.

The zero vector takes no part; components of any finite size are scaled by powers
of two first; see ``vectors`` for nulls, ties and repeated rows.  Further columns,
whatever their names, are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .vectors import CANDIDATE_BLOCK, CANDIDATE_BYTES, EVERY, QUERY_BLOCK, QUERY_BYTES, K, block_count, block_rows, query_rows, usable

STEP = 128  # queries whose products are held at once


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: exact, and no square overflows."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and residual length of the unit vector of each row."""
    v = scaled(v)
    unit = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype("int8")
    residual = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1))
    return codes, scale, residual


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each row pair: every sum runs over the components in order, so equal pairs give equal bits wherever they are computed."""
    q, x = scaled(q), scaled(x)
    dot, qq, xx = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for d in range(q.shape[1]):
        dot += q[:, d] * x[:, d]
        qq += q[:, d] * q[:, d]
        xx += x[:, d] * x[:, d]
    return dot / (np.sqrt(qq) * np.sqrt(xx))


def tile(candidates: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of this tile for each of its queries."""
    empty = pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0)})
    if not len(candidates) or not len(queries):
        return empty
    x, q = np.stack(candidates["v"].to_numpy()), np.stack(queries["v"].to_numpy())
    x_id, q_id = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
    x_code, x_scale, x_rest = quantise(x)
    q_code, q_scale, q_rest = quantise(q)
    x_code = x_code.astype("float32").T  # products of int8 codes are exact in float32 up to 1,000 components
    if x.shape[1] > 1000:
        x_code = x_code.astype("float64")
    out = []
    for at in range(0, len(q), STEP):
        part = slice(at, at + STEP)
        near = (q_code[part].astype(x_code.dtype) @ x_code).astype("float64") * (q_scale[part, None] * x_scale)
        error = x_rest + q_rest[part, None] * (1 + x_rest) + 1e-9
        own = q_id[part, None] == x_id
        low = np.where(own, -np.inf, near - error)
        kth = np.partition(low, -k, axis=1)[:, -k] if len(x) > k else np.full(len(low), -np.inf)
        qi, xi = np.nonzero((near + error >= kth[:, None]) & ~own)
        score = cosines(q[at + qi], x[xi])
        order = np.lexsort((x_id[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = place < k
        out.append(pd.DataFrame({"query_id": q_id[at + qi[keep]], "vec_id": x_id[xi[keep]], "score": score[keep]}))
    return pd.concat(out) if out else empty


def merged_by_heaps(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query's rows, of which each tile has sent k at most; a task holds one heap of k."""

    def run(it):
        import pyarrow as pa

        now, heap, out = None, [], []

        def close():
            for place, (score, neg_id) in enumerate(sorted(heap, reverse=True), 1):
                out.append((now, place, -neg_id, score))
            heap.clear()

        def batch_of(rows):
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "rank", "vec_id", "score"])

        for batch in it:
            for query, vec, score in zip(*[batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")], strict=True):
                if query != now:
                    if now is not None:
                        close()
                    now = query
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
            yield batch_of(out)
            out.clear()
        if now is not None:
            close()
            yield batch_of(out)

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(tidy(run), "query_id long, rank int, vec_id long, score double")


def nearest(df: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest."""
    rows = usable(df, vec_id, embedding).filter(F.exists("v", lambda x: x != 0))
    queries = query_rows(rows, every)
    total, widest = rows.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    asked = queries.count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across, down = block_count(total, block_rows(widest, CANDIDATE_BLOCK, CANDIDATE_BYTES), parts), block_count(asked, block_rows(widest, QUERY_BLOCK, QUERY_BYTES))
    spread = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.withColumn("across", spread(across)).withColumn("down", each(down))
    # a query's block follows from its id: rows of an aggregate come in any order when they are computed again
    right = queries.withColumn("down", F.pmod(F.xxhash64("vec_id"), F.lit(down))).withColumn("across", each(across))
    key = ["dim", "across", "down"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(lambda a, b: tile(a, b, k), "query_id long, vec_id long, score double")
    return merged_by_heaps(found, k)
