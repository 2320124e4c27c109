"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts 2- and 3-grams of the characters of lower-cased whole texts in
every task and adds them up by (language, bucket).  The log-probability matrix
reaches the driver and is broadcast in blocks of ``LANGUAGES`` languages, each
``LANGUAGES`` x ``2 * BUCKETS`` floats at most whatever the input.  Scoring makes
the n-grams of a batch of documents one sparse matrix in numpy and multiplies it with the log
probabilities; one pass over the batch a block, each carrying the
best language so far and the sum of likelihoods, so any number of languages works.

Learning uses text and non-null lang of documents whose crc32(doc_id) mod 4 is
not 2; a prediction depends on the text alone.  Languages have equal priors.

Defined results: null text, or text without a letter, is ``und`` with score 0,
as is everything if there is nothing to learn from; a null doc_id is neither
learned from nor held out; ties go to the language that sorts first; repeated
rows get equal results wherever they are; very long texts are counted in
stretches, whole; an empty table gives an empty result; further columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, tidy

BUCKETS = 1 << 15
SMOOTH = 0.5
LANGUAGES = 32  # of a block
UNKNOWN = "und"
BATCH_GRAMS = 1 << 16  # entries of the sparse matrix at once
STRETCH = 500_000  # characters that are hashed at once
LETTER = re.compile(r"[^\W\d_]")

Block = tuple[list[str], np.ndarray]


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the character 2- and 3-grams of a lower-cased text between blanks, stretch by stretch."""
    body = f" {text.lower()} "
    for at in range(0, max(len(body) - 2, 1), STRETCH):
        c = np.frombuffer(body[at : at + STRETCH + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        pair = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        two = (pair * np.uint32(2654435761)) >> np.uint32(17)
        three = ((pair[:-1] * np.uint32(0x85EBCA77) + c[2:]) * np.uint32(2246822519)) >> np.uint32(17)
        last = at + STRETCH + 2 >= len(body)
        yield np.concatenate([two if last else two[:-1], three + np.uint32(BUCKETS)])


def sparse_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different buckets of a text, sorted, and how often each occurs."""
    parts = list(gram_buckets(text))
    if len(parts) == 1 and len(parts[0]) < BUCKETS // 4:
        return np.unique(parts[0], return_counts=True)
    dense = np.zeros(2 * BUCKETS, "int64")
    for part in parts:
        dense += np.bincount(part, minlength=2 * BUCKETS)
    at = np.flatnonzero(dense)
    return at, dense[at]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all of ``docs`` (lang, text); a task holds the counts of at most ``LANGUAGES`` languages at once."""

    def run(it):
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}

        def rows():
            for name, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])
            totals.clear()

        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang not in totals and len(totals) >= LANGUAGES:
                    yield from rows()
                total = totals.setdefault(lang, np.zeros(2 * BUCKETS, "int64"))
                for part in gram_buckets(text.as_py()):
                    np.add.at(total, part, 1)
        yield from rows()

    partial = docs.mapInArrow(tidy(run), "lang string, bucket int, n long")
    return partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[Block]:
    """Blocks of languages, in order, and their log probabilities, buckets x languages."""
    bounded_batches(docs.sparkSession)
    learned = docs.filter((fold(docs[doc_id]) != 2) & docs[lang].isNotNull() & docs[text].isNotNull())
    counts = count_grams(learned.select(docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"))).persist()
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())
    blocks = []
    for at in range(0, len(names), LANGUAGES):
        own = names[at : at + LANGUAGES]
        found = (counts if len(own) == len(names) else counts.filter(F.col("lang").isin(own))).toPandas()
        table = np.full((2 * BUCKETS, len(own)), SMOOTH)
        for k, name in enumerate(own):
            mine = found[found["lang"] == name]
            table[mine["bucket"].to_numpy(), k] += mine["n"].to_numpy()
        for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
            table[part] /= table[part].sum(axis=0)
        blocks.append((own, np.log(table).astype("float32")))
    counts.unpersist()
    return blocks


def batch_likelihoods(texts: list[str], table: np.ndarray, most: int = BATCH_GRAMS) -> np.ndarray:
    """Log likelihoods, texts x languages: a sparse matrix of counts, a row a text, times the table.

    The matrix is held as the buckets and counts of its entries and where each row
    begins, about ``most`` entries at a time.  A short text's grams are entries as they
    come, of a longer one equal grams are one entry; either follows from the text alone.
    """
    out = np.zeros((len(texts), table.shape[1]))
    held, counts, rows, n = [], [], [], 0

    def multiply():
        starts = np.concatenate([[0], np.cumsum([len(x) for x in held[:-1]])]).astype("int64")
        entries = table[np.concatenate(held)].astype("float64")
        entries *= np.concatenate(counts)[:, None]
        out[rows] = np.add.reduceat(entries, starts, axis=0)
        for x in (held, counts, rows):
            x.clear()

    for row, text in enumerate(texts):
        at, count = (next(gram_buckets(text)), None) if len(text) < BUCKETS // 4 else sparse_counts(text)
        if len(at):
            held.append(at)
            counts.append(np.ones(len(at)) if count is None else count.astype("float64"))
            rows.append(row)
            n += len(at)
        if n >= most:
            multiply()
            n = 0
    if held:
        multiply()
    return out


def text_likelihoods(text: str, table: np.ndarray) -> np.ndarray:
    """Log likelihood of a text in each language."""
    return batch_likelihoods([text], table)[0]


def _scored(df: DataFrame, blocks: list[Block], text: str) -> DataFrame:
    """``df`` with ``_best`` (language or null), ``_log`` and ``_rest``: its log likelihood and the sum of all likelihoods over its own."""
    df = df.select("*", F.lit(None).cast("string").alias("_best"), F.lit(float("-inf")).alias("_log"), F.lit(0.0).alias("_rest"))
    schema = T.StructType([*df.schema.fields[:-3], *[T.StructField(n, t) for n, t in (("_best", T.StringType()), ("_log", T.DoubleType()), ("_rest", T.DoubleType()))]])
    column, kept = df.columns.index(text), len(df.columns) - 3
    for block in blocks:
        shared = df.sparkSession.sparkContext.broadcast(block)

        def run(it, shared=shared):
            import pyarrow as pa

            names, table = shared.value
            for batch in it:
                best, log, rest = (batch.column(kept + k).to_pylist() for k in range(3))
                texts = batch.column(column).to_pylist()
                lettered = [row for row, own in enumerate(texts) if own is not None and LETTER.search(own)]
                for row, found in zip(lettered, batch_likelihoods([texts[row] for row in lettered], table), strict=True):
                    k = int(found.argmax())
                    top = max(found[k], log[row])
                    rest[row] = float(rest[row] * np.exp(log[row] - top) + np.exp(found - top).sum())
                    if found[k] > log[row]:
                        best[row] = names[k]
                    log[row] = float(top)
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(best, pa.string()), pa.array(log, pa.float64()), pa.array(rest, pa.float64())], names=schema.names)

        df = df.mapInArrow(tidy(run), schema)
    return df


POSTERIOR = "IF(_rest > 0, 1 / _rest, 0D)"


def predict(docs: DataFrame, blocks: list[Block], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    slim = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(fold(docs[doc_id]) == 2, F.lit(False)).alias("held_out"), docs[text].cast("string").alias("text"))
    return _scored(slim, blocks, "text").select("doc_id", "held_out", F.coalesce("_best", F.lit(UNKNOWN)).alias("lang_pred"), F.expr(POSTERIOR).alias("score"))


def identify(docs: DataFrame, **names: str) -> DataFrame:
    """Learn from ``docs`` and predict every row of it."""
    model = train(docs, **names)
    names.pop("lang", None)
    return predict(docs, model, **names)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose language is found; rows without letters, or that no language explains better than the rest together, go.

    All columns stay as they are, whatever their names.  The decision is computed
    in the scan of the whole rows, so nothing is joined.
    """
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"
    return _scored(plain, train(docs), text).filter(F.expr(f"{POSTERIOR} >= {least}D")).select(*plain.columns).toDF(*docs.columns)
