"""Weak-label quality classifier.

Overlapping heuristic labellers vote good, bad or nothing on each document.
Expectation-maximisation over the counts of vote patterns (at most
3^labellers rows, whatever the input) estimates each labeller's accuracy and the
share of good documents.  The posteriors label a bounded sample of different texts
(``TRAIN_ROWS``), each weighted by the rows it stands for, on which a linear scorer over hashed character-class trigrams
is fitted, with the share of repeated words; the scorer, ``FEATURES`` weights, is broadcast and judges every whole text.

Defined results: null, empty or blank text gets no vote, score 0 and is
rejected; repeated rows get equal scores, wherever they are in a batch; a null doc_id stays null; very
long texts are counted in stretches, whole; other columns, whatever their names, are kept by ``keep_good``; an empty table gives an empty result;
if all documents agree in their votes the scorer is constant and they are kept
unless their votes say bad.
"""

from __future__ import annotations

import operator
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, tidy
from .textbytes import slices

TRAIN_ROWS = 4000
EM_STEPS = 60
FIT_STEPS = 200
LEAST_LIFT = 50
RATE = 4.0
DECAY = 1e-4
CLASSES = 32
TRIGRAMS = CLASSES**3
HASHED = 1024
REPEATS = 8  # steps of the share of words that repeat the word before
FEATURES = HASHED + REPEATS
PRIOR_GRAMS = 20  # a text of so few trigrams is judged half by the intercept
REJECT_BELOW = 0.35
PAD = b"\n\n"
PART_ROWS = 500
STRETCH = 1 << 20  # characters of a text whose words or lines are objects at once
_BLANK, _LINE_END = re.compile(r"\s"), re.compile("\n")
LABELLERS = ("symbols", "upper", "bars", "letters", "lines", "word_length", "stops", "repeats")


def _class_table() -> np.ndarray:
    """Character class of each byte: letters by case, digits, space, line end, high bytes, then single marks."""
    table = np.zeros(256, "uint32")
    table[ord("a") : ord("z") + 1] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[[9, 32]] = 4
    table[[10, 13]] = 5
    table[128:] = 6
    for k, mark in enumerate(".,;:!?'\"()-/|$%&*#@_=+<>"):
        table[ord(mark)] = 7 + k
    return table


CLASS_OF = _class_table()
SYMBOL_CLASSES = [int(CLASS_OF[ord(m)]) for m in "|$%&*#@_=+<>"]


def hashed(trigram: np.ndarray) -> np.ndarray:
    return (trigram.astype("uint32") * np.uint32(2654435761)) >> np.uint32(22)


def text_counts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Class counts (rows x CLASSES) and hashed trigram counts (rows x HASHED) of an Arrow array of texts.

    Every text stands between line ends, two before and two after, wherever it is
    in its batch; they are not counted as classes.
    """
    counts, grams = np.zeros((len(texts), CLASSES), "int64"), np.zeros((len(texts), HASHED), "float32")
    for part in slices(texts, before=PAD, after=PAD, overlap=2):
        if len(part.data) < 3:
            continue
        classes = CLASS_OF[part.data]
        hashes = hashed(trigrams(classes)).astype("int64")
        for row, at, to, own in zip(part.rows.tolist(), part.starts[:-1].tolist(), part.starts[1:].tolist(), part.own.tolist(), strict=True):
            grams[row] += np.bincount(hashes[at : max(to - 2, at)], minlength=HASHED)
            counts[row] += np.bincount(classes[at : at + own], minlength=CLASSES)
    counts[:, CLASS_OF[ord("\n")]] -= 2 * len(PAD)
    return counts, grams


def repeat_share(texts: list[str]) -> np.ndarray:
    """Share of a text's words that equal the word before."""
    out = np.zeros(len(texts))
    for k, text in enumerate(texts):
        n, same, last = 0, 0, []
        for part in _stretches(text, _BLANK):
            words = last + part.split()
            n += len(words) - len(last)
            same += sum(map(operator.eq, words, words[1:]))
            last = words[-1:]
        if n > 3:
            out[k] = same / n
    return out


def _stretches(text: str, edge: re.Pattern):
    """A text in parts of about ``STRETCH`` characters that end before a match of ``edge``, so that few words or lines are objects at once."""
    at = 0
    while at < len(text):
        cut = edge.search(text, at + STRETCH)
        to = cut.start() if cut else len(text)
        yield text[at:to]
        at = to


def features(grams: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Rows x FEATURES: square roots of trigram shares, shrunk for short texts, and a step of the repeats."""
    n = len(grams)
    x = np.zeros((n, FEATURES), "float32")
    total = grams.sum(axis=1, keepdims=True)
    x[:, :HASHED] = np.sqrt(grams / np.maximum(total, 1)) * (total / (total + PRIOR_GRAMS))
    step = np.minimum((repeats * 2 * REPEATS).astype(int), REPEATS - 1)
    x[np.arange(n), HASHED + step] = 0.5
    return x


def votes(counts: np.ndarray, texts: list[str], repeats: np.ndarray) -> np.ndarray:
    """Documents x labellers: 1 good, 0 bad, 2 no vote."""
    total = counts.sum(axis=1)
    spaces = counts[:, 4] + counts[:, 5]
    ink = np.maximum(total - spaces, 1)
    words = np.maximum(spaces + 1, 1)
    short = words < 8  # too few words for shares of words to say anything
    ascii_letters = np.maximum(counts[:, 1] + counts[:, 2], 1)

    def band(value, bad, good):
        return np.where(bad(value), 0, np.where(good(value), 1, 2))

    out = np.stack(
        [
            band(counts[:, SYMBOL_CLASSES].sum(axis=1) / ink, lambda x: x > 0.06, lambda x: x < 0.02),
            band(counts[:, 2] / ascii_letters, lambda x: (x > 0.35) & ~short, lambda x: x < 0.12),
            band((counts[:, CLASS_OF[ord("|")]] + counts[:, CLASS_OF[ord("!")]]) / words, lambda x: (x > 0.25) & ~short, lambda x: x < 0.05),
            band((counts[:, 1] + counts[:, 2] + counts[:, 6]) / ink, lambda x: (x < 0.78) & ~short, lambda x: x > 0.9),
            np.array([_line_vote(t) for t in texts]),
            band(ink / words, lambda x: ((x > 14) | (x < 1.5)) & ~short, lambda x: (x > 3) & (x < 9)),
            band(counts[:, CLASS_OF[ord(".")]] / words, lambda x: (x > 0.6) & ~short, lambda x: (x > 0.01) & (x < 0.3)),
            band(repeats, lambda x: x > 0.3, lambda x: (x < 0.1) & (words >= 8)),
        ],
        axis=1,
    )
    out[total <= spaces] = 2
    return out


def _line_vote(text: str) -> int:
    found = [np.zeros(0, "int64")]
    for part in _stretches(text, _LINE_END):
        lines = [x for x in part.split("\n") if x.strip()]
        found.append(np.fromiter(map(hash, lines), "int64", len(lines)))
    n = sum(map(len, found))
    if n < 4:
        return 2
    return 0 if len(np.unique(np.concatenate(found))) < 0.4 * n else 1


def vote_patterns(docs: DataFrame) -> DataFrame:
    """(pattern, n): each document's votes in base 3, counted; ``docs`` has one column, text."""

    def run(it):
        import pyarrow as pa

        powers = 3 ** np.arange(len(LABELLERS))
        counted = np.zeros(3 ** len(LABELLERS), "int64")
        for batch in it:
            for part in bounded(batch):
                texts = [t or "" for t in part.column(0).to_pylist()]
                v = votes(text_counts(part.column(0))[0], texts, repeat_share(texts))
                counted += np.bincount(v @ powers, minlength=len(counted))
        at = np.flatnonzero(counted)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counted[at], pa.int64())], names=["pattern", "n"])

    return docs.mapInArrow(tidy(run), "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, accuracies (labellers x {bad, good}), share of good.

    Each labeller has a probability of each of its three votes for either class.
    A labeller knows one defect, so the start takes any bad vote as bad, and
    every step holds its bad votes to be ``LEAST_LIFT`` times rarer among good
    documents than among all (else a defect that no other labeller sees would
    be learned as a mark of good documents).
    """
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good = np.where((v == 0).any(axis=1), 0.05, np.where((v == 1).any(axis=1), 0.95, 0.5))
    share, chance = 0.5, np.zeros((2, len(LABELLERS), 3))
    fired = (n @ (v == 0) + 0.5) / (n.sum() + 1.5)
    for _ in range(steps):
        w = np.stack([n * (1 - good), n * good])
        share = float((w[1].sum() + 1) / (w.sum() + 2))
        for vote in range(3):
            chance[:, :, vote] = w @ (v == vote)
        chance = (chance + 0.5) / (chance.sum(axis=2, keepdims=True) + 1.5)
        bound = np.stack([np.maximum(chance[0, :, 0], np.minimum(2 * fired, 0.9)), np.minimum(chance[1, :, 0], fired / LEAST_LIFT)])
        chance[:, :, 1:] *= ((1 - bound) / np.maximum(1 - chance[:, :, 0], 1e-9))[:, :, None]
        chance[:, :, 0] = bound
        log = [np.log(chance[c][np.arange(len(LABELLERS)), v]).sum(axis=1) + np.log(share if c else 1 - share) for c in (0, 1)]
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    accuracy = np.stack([chance[c, :, c] / chance[c, :, :2].sum(axis=1) for c in (0, 1)], axis=1)
    return good, accuracy, share


def trigrams(c: np.ndarray) -> np.ndarray:
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def sampled_texts(docs: DataFrame, rows: int) -> DataFrame:
    """(digest, weight) of at most ``rows`` different texts with ink; ``docs`` has one column, text.

    Priority sampling: a text with n copies has the priority n / u, u drawn by its
    digest; the ``rows`` highest are taken, with the weight n or the highest priority
    left out, whichever is more.  So a text weighs as much as its copies do among all
    rows, whether it is taken or others stand for it.
    """
    inked = docs.filter(F.col("text").rlike("[^\\t\\n\\r ]"))
    counts = inked.groupBy(F.xxhash64("text").alias("digest")).agg(F.count("*").alias("n"))
    u = (F.shiftrightunsigned(F.xxhash64("digest"), 11).cast("double") + 0.5) / float(1 << 53)
    top = counts.withColumn("priority", F.col("n") / u).orderBy(F.desc("priority"), "digest").limit(rows + 1).toPandas()
    left_out = float(top["priority"].iloc[rows]) if len(top) > rows else 0.0
    taken = top.iloc[:rows]
    weights = np.maximum(taken["n"].to_numpy("float64"), left_out)
    return docs.sparkSession.createDataFrame(list(zip(taken["digest"].tolist(), weights.tolist(), strict=True)), "digest long, weight double")


def _training_rows(docs: DataFrame, posterior: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features, posterior labels and weights of the ``sampled_texts``; ``docs`` has one column, text."""
    sample = sampled_texts(docs, rows)
    chosen = docs.withColumn("digest", F.xxhash64("text")).join(F.broadcast(sample.select("digest")), "digest", "left_semi").select("text", "digest")

    def run(it):
        import pyarrow as pa

        powers = 3 ** np.arange(len(LABELLERS))
        seen: set[int] = set()  # copies are one row a task, and one row after all
        for batch in it:
            fresh = [k for k, d in enumerate(batch.column(1).to_pylist()) if not (d in seen or seen.add(d))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for part in bounded(batch):
                texts = [t or "" for t in part.column(0).to_pylist()]
                repeats = repeat_share(texts)
                counts, grams = text_counts(part.column(0))
                v, x = votes(counts, texts, repeats), features(grams, repeats)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(posterior[v @ powers], pa.float64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["digest", "y", "x"])

    learned = chosen.mapInArrow(tidy(run), "digest long, y double, x binary").groupBy("digest").agg(F.min(F.struct("y", "x")).alias("of"))
    found = learned.join(F.broadcast(sample), "digest").select("digest", "weight", "of.y", "of.x").toPandas().sort_values("digest")
    x = np.frombuffer(b"".join(found["x"]), "float32").reshape(-1, FEATURES)
    return x, found["y"].to_numpy("float64"), found["weight"].to_numpy("float64")


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = FIT_STEPS) -> tuple[np.ndarray, float]:
    """Logistic regression on weighted soft labels by gradient steps."""
    w, b = np.zeros(FEATURES), 0.0
    if not len(x):
        return w, b
    share = weight / weight.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w.astype("float32") + b)))
        g = (p - y) * share
        w -= RATE * (x.T @ g.astype("float32") + DECAY * w)
        b -= RATE * float(g.sum())
    return w, b


def train(docs: DataFrame, text: str = "text", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, intercept and labeller accuracies learned from ``docs``."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[text].cast("string").alias("text"))
    counted = vote_patterns(slim).toPandas().sort_values("pattern")
    posterior = np.full(3 ** len(LABELLERS), 0.5)
    accuracy = np.zeros((len(LABELLERS), 2))
    if len(counted):
        posterior[counted["pattern"]], accuracy, _ = expectation_maximisation(counted["pattern"].to_numpy(), counted["n"].to_numpy())
    w, b = fit(*_training_rows(slim, posterior, rows))
    return w, b, accuracy


def bounded(batch):
    """A batch in parts of few rows, so that a part's table of counts stays small."""
    for at in range(0, batch.num_rows, PART_ROWS):
        yield batch.slice(at, PART_ROWS)


def batch_scores(texts, w: np.ndarray, b: float) -> np.ndarray:
    """Score (0 to 1) of each text of an Arrow array; 0 without ink.

    Scores are sums over one text's own counts, so equal texts get equal scores wherever they are.
    """
    out = np.zeros(len(texts))
    for at in range(0, len(texts), PART_ROWS):
        part = texts[at : at + PART_ROWS]
        counts, grams = text_counts(part)
        x = features(grams, repeat_share([t or "" for t in part.to_pylist()]))
        ink = counts.sum(axis=1) - counts[:, 4] - counts[:, 5]
        value = (x.astype("float64") * w).sum(axis=1) + b
        out[at : at + PART_ROWS] = np.where(ink > 0, 1 / (1 + np.exp(-value)), 0)
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, keep) of each row."""
    w, b, _ = model or train(docs, text)
    id_type = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((w, b))

    def run(it):
        import pyarrow as pa

        for batch in it:
            s = batch_scores(batch.column(1), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(s >= REJECT_BELOW, pa.bool_())], names=["doc_id", "score", "keep"])

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, score double, keep boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the classifier, trained on ``docs``, does not reject."""
    w, b, _ = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((w, b))
    column = docs.columns.index("text")

    def run(it):
        import pyarrow as pa

        for batch in it:
            yield batch.filter(pa.array(batch_scores(batch.column(column), *shared.value) >= REJECT_BELOW))

    return docs.mapInArrow(tidy(run), docs.schema)
