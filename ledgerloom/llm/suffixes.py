"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else in the corpus, the same text included.

1. Every window of ``LENGTH`` bytes holds an anchor: the ``GRAM``-byte string with
   the least hash in it, the leftmost of equals.  Equal windows have equal
   anchors, so only texts around an anchor that occurs twice can repeat.  The
   *context* of an anchor is all its windows together.  Contexts that a slice of
   a batch holds twice are settled there; one row of each goes on.
2. Aggregates with partial sums tell the anchors that occur once (done), those
   whose contexts are all equal (repeated as a whole), and the rest: the borders
   of repeated passages.  No task holds the rows of an anchor.
3. Two different contexts share a window only if they share one of ``CORES`` parts
   of it, ``LENGTH - SHIFT`` bytes each; contexts that share none, by hash and with
   partial sums again, are done.  One of each kind fetches the bytes around the
   parts that it shares.  Tasks that hold whole anchors cut these into shards, sort
   each shard's suffixes to ``LENGTH`` bytes, and merge the shards'
   Burrows-Wheeler transforms by interleave refinement: only the vector of shard
   numbers is permuted, one block of ``STEP`` bytes a round, and the places where
   neighbours begin to differ give their common prefixes.  Runs with common
   prefixes of ``LENGTH`` are the repeated intervals.  A letter of the transforms is
   a block of ``STEP`` bytes; letters are ordered by a hash and equal only if their
   bytes are.
   Anchors with over ``HOT`` such contexts are not held by one task: the windows of
   their contexts are counted by two 64-bit hashes, with partial sums.
4. The runs found for a text are joined to it and cut.

Equality of whole contexts rests on 64 bits of anchor and 64 of context: with n
contexts of one anchor a false match has a chance of about n^2 / 2^65.

Defined results: null text is empty; texts under ``LENGTH`` bytes keep all;
repeated rows repeat each other; rows with equal doc_id and different texts are
told apart by a digest of the text; null doc_ids are kept apart likewise; very
long texts are scanned in overlapping stretches, whole; further columns, whatever
their names, are kept by ``cut_repeats``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, materialise, scratch_path, tidy, written
from .neardup import _whole_groups
from .textbytes import slices

LENGTH = 200
GRAM = 40
STARTS = LENGTH - GRAM + 1  # anchors a window can have
STEP = 40  # bytes a refinement round goes deeper; LENGTH is a multiple
CORES = 8
SHIFT = (LENGTH - GRAM) // CORES
SHARD_BYTES = 1 << 15
TASK_BYTES = 1 << 17  # contexts whose transforms are merged together; small, so that the arrays stay in a processor's cache
HOT = 6_000

_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1
_M = np.uint64(0xFF51AFD7ED558CCD)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if (base, size) not in _powers:
        for key in [k for k in _powers if k[0] == base]:
            del _powers[key]
        steps = np.full(size, base, "uint64")
        steps[0] = 1
        _powers[base, size] = np.multiply.accumulate(steps)
    return _powers[base, size][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """Polynomial hashes modulo 2^64 of any ranges of a byte array."""

    def __init__(self, data: np.ndarray, base: int):
        n = len(data)
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(n + 1, "uint64")
        np.cumsum((data.astype("uint64") + np.uint64(1)) * _power(base, n), out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[high] - self.sums[low]) * _power(self.inverse, len(self.sums))[low])


def anchors(data: np.ndarray, starts: np.ndarray, hashes: RangeHash) -> np.ndarray:
    """Sorted places of the anchors of all windows that lie inside one text."""
    n = len(data)
    sizes = np.diff(starts)
    if n < LENGTH or not (sizes >= LENGTH).any():
        return np.zeros(0, "int64")
    at = np.arange(n - GRAM + 1)
    gram = _mixed((hashes.sums[GRAM:] - hashes.sums[: n - GRAM + 1]) * _power(hashes.inverse, n + 1)[: n - GRAM + 1])
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype("uint64")
    blocks = -(-len(key) // STARTS)
    padded = np.full(blocks * STARTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    grid = padded.reshape(blocks, STARTS)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(behind[:windows], ahead[STARTS - 1 : STARTS - 1 + windows])
    inside = np.zeros(n + 1, "int8")
    whole = sizes >= LENGTH
    inside[starts[:-1][whole]] = 1
    np.add.at(inside, starts[1:][whole] - LENGTH + 1, -1)
    valid = np.cumsum(inside[:windows]).astype(bool)
    place = (least & np.uint64(0xFFFFFFFF)).astype("int64")[valid]
    return np.unique(place[np.concatenate([[True], place[1:] != place[:-1]])])


def merged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as sorted maximal ones (touching ones join)."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > high[:-1]])
    return low[new], high[np.concatenate([new[1:], [True]])]


CORE_COLUMNS = [f"cores{k}" for k in range(CORES // 2)]  # two 32-bit hashes each
ROW = "doc_id long, digest long, n long, anchor long, context long, place long, before int, after int, " + ", ".join(f"{c} long" for c in CORE_COLUMNS)


def _identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(body).alias("digest"), body.alias("text"))


def core_hashes(hashes: RangeHash, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """32-bit hashes, two a column, of the parts of each context that windows by their distance from the anchor share; 0 where the text ends before."""
    halves = []
    for k in range(CORES):
        a, b = place - k * SHIFT, place + LENGTH - (k + 1) * SHIFT
        inside = (a >= low) & (b <= high)
        h = hashes.of(np.where(inside, a, 0), np.where(inside, b, 0)) >> np.uint64(32)
        halves.append(np.where(inside, h | np.uint64(1), np.uint64(0)))
    return [(halves[k] << np.uint64(32) | halves[k + 1]).view("int64") for k in range(0, CORES, 2)]


def kinds_of(anchor: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row of each different pair, the pair of each row, and the number of rows of each pair."""
    _, first, back, count = np.unique(_mixed(anchor) ^ context, return_index=True, return_inverse=True, return_counts=True)
    if ((anchor != anchor[first][back]) | (context != context[first][back])).any():
        _, first, back, count = np.unique(np.stack([anchor, context], axis=1), axis=0, return_index=True, return_inverse=True, return_counts=True)
    return first, back.ravel(), count


def anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each kind of context of a slice, with its number ``n`` there, and settled runs (n = 0) of ``docs`` (doc_id, digest, text)."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            for part in slices(batch.column(2), overlap=LENGTH - 1):
                data, starts = part.data, part.starts
                first = RangeHash(data, _B1)
                place = anchors(data, starts, first)
                if not len(place):
                    continue
                text = np.searchsorted(starts, place, side="right") - 1
                low = np.maximum(place - (STARTS - 1), starts[text])
                high = np.minimum(place + LENGTH, starts[text + 1])
                anchor = first.of(place, place + GRAM)
                del first
                second = RangeHash(data, _B2)
                context = second.of(low, high) ^ (place - low).astype("uint64")
                kind, back, count = kinds_of(anchor, context)
                several = count[back] > 1
                run_low, run_high = merged(low[several], high[several])
                # runs of different texts may touch: cut them at text borders
                own = np.searchsorted(starts, run_low, side="right") - 1
                last = np.searchsorted(starts, run_high - 1, side="right") - 1
                if (own != last).any():
                    cuts = [(max(a, starts[t]), min(b, starts[t + 1]), t) for a, b, x, y in zip(run_low, run_high, own, last, strict=True) for t in range(x, y + 1) if starts[t + 1] > starts[t]]
                    run_low, run_high, own = (np.array(c) for c in zip(*cuts, strict=True))
                where = np.concatenate([text[kind], own])
                zero = starts[where] - part.offsets[where]
                which = pa.array(part.rows[where])
                none = np.zeros(len(own), "int64")
                join = lambda kinds, runs, t=None: pa.array(np.concatenate([kinds, runs]), t)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(which), batch.column(1).take(which), join(count, none),
                        join(anchor[kind].view("int64"), none), join(context[kind].view("int64"), none), pa.array(np.concatenate([place[kind], run_low]) - zero),
                        join((place - low)[kind], none, pa.int32()), join((high - place)[kind], run_high - run_low, pa.int32()),
                        *[join(c, none) for c in core_hashes(second, place[kind], low[kind], high[kind])],
                    ],
                    names=["doc_id", "digest", "n", "anchor", "context", "place", "before", "after", *CORE_COLUMNS],
                )

    return docs.mapInArrow(tidy(run), ROW)


def sort_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs that are settled without their bytes, and one row of each context whose bytes are needed, from ``anchor_rows``; what is returned does not read ``rows`` again.

    Everything is an aggregate with partial sums or a join, so a frequent anchor
    or context fills no task.
    """
    span = ["doc_id", "digest", (F.col("place") - F.col("before")).alias("low"), (F.col("place") + F.col("after")).alias("high")]
    found = materialise(rows.filter("n = 0").select(*span), "runs")
    rows = rows.filter("n > 0")
    seen = rows.groupBy("anchor").agg(F.sum("n").alias("_n"), (F.min("context") == F.max("context")).alias("alike")).filter("_n > 1").drop("_n")
    again = materialise(rows.join(seen, "anchor"), "repeated")
    # copies of a slice are settled there (n > 1 stands for them); single rows are settled with what repeats them elsewhere
    found = found.unionByName(again.filter("alike AND n = 1").select(*span))
    several = again.filter("NOT alike")
    one = F.min(F.struct("doc_id", "digest", "place", "before", "after")).alias("_at")
    kinds = materialise(several.groupBy("anchor", "context").agg(F.sum("n").alias("_n"), one, *[F.first(c).alias(c) for c in CORE_COLUMNS]), "kinds")
    settled = several.filter("n = 1").join(kinds.filter("_n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select(*span)
    found = found.unionByName(materialise(settled, "settled"))  # written alone, so that a frequent context's join can be split

    halves = [F.struct(F.lit(2 * k + h).alias("part"), (F.shiftrightunsigned(c, 32) if h == 0 else F.col(c).bitwiseAND(0xFFFFFFFF)).alias("core")) for k, c in enumerate(CORE_COLUMNS) for h in (0, 1)]
    cores = kinds.select("anchor", "context", F.inline(F.array(*halves))).filter("core <> 0")
    shared = cores.groupBy("anchor", "part", "core").agg((F.min("context") < F.max("context")).alias("_several")).filter("_several").drop("_several")
    sharing = cores.join(shared, ["anchor", "part", "core"], "left_semi").groupBy("anchor", "context").agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
    needs = kinds.join(sharing, ["anchor", "context"]).select("anchor", "_at.*", "_first", "_last")
    # the windows around the shared parts: from LENGTH bytes that end SHIFT after the last part to those that begin SHIFT before the first
    low = F.col("place") - F.least("before", (F.col("_last") + 1) * SHIFT)
    high = F.col("place") + F.least("after", LENGTH - F.col("_first") * SHIFT)
    return found, needs.select("doc_id", "digest", "anchor", low.alias("low"), high.alias("high"))


def _stable_order(keys: np.ndarray, most: int) -> np.ndarray:
    """Stable order of integers up to ``most``, by 16-bit counting passes."""
    order = np.argsort((keys & 0xFFFF).astype("uint16"), kind="stable")
    if most > 0xFFFF:
        order = order[np.argsort((keys[order] >> 16).astype("uint16"), kind="stable")]
    return order


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks."""
    return np.unique(key, return_inverse=True)[1]


def block_letters(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Letter of the ``STEP`` bytes at each place; every shard is cyclic on its own.

    Letters are numbered in the order of a hash of their bytes; a hash that two
    different blocks share (found by comparing bytes) is exchanged for another.
    """
    shards = [data[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
    longer = np.concatenate([x for s in shards for x in (s, np.resize(s, STEP))] + [np.zeros(8, "uint8")])
    at = np.arange(len(data)) + STEP * np.repeat(np.arange(len(shards)), np.diff(starts))
    words = np.ndarray((len(longer) - 7,), "<u8", longer, strides=(1,))
    base = _B1
    while True:
        hashes = RangeHash(longer, base)
        _, first, letter = np.unique(hashes.of(at, at + STEP), return_index=True, return_inverse=True)
        other = at[first][letter]
        if all((words[at + k] == words[other + k]).all() for k in (*range(0, STEP - 8, 8), STEP - 8)):
            return letter.astype("int32")
        base = (base * 5 + 8) & 0xFFFFFFFFFFFFFFFF | 1


def shard_suffixes(letters: np.ndarray) -> np.ndarray:
    """Places of a shard in the order of the letters of their ``LENGTH`` bytes; ``letters``: those of the ``STEP`` bytes at each place, cyclic."""
    columns = [np.roll(letters, -d).astype("int64") for d in range(0, LENGTH, STEP)]
    bits = int(letters.max()).bit_length()
    key, used = columns[0], bits
    for column in columns[1:]:
        if used + bits > 62:
            key = _ranks(key)
            used = int(key.max()).bit_length()
        key, used = key << bits | column, used + bits
    return np.argsort(key, kind="stable")


def merge_transforms(transforms: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' suffixes sorted to ``LENGTH`` bytes, and their classes of equal strings.

    ``transforms``: for each shard, in its suffix order, the rank of the block
    that precedes each suffix.  Round k makes the interleave right to k blocks.
    """
    joined = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype="uint16"), [len(t) for t in transforms])
    classes = np.zeros(len(joined), "int32")
    before = np.empty_like(joined)
    for _ in range(LENGTH // STEP):
        before[np.argsort(shard, kind="stable")] = joined
        order = _stable_order(before, most)
        block, old = before[order], classes[order]
        shard = shard[order]
        edge = (block[1:] != block[:-1]) | (old[1:] != old[:-1])  # neighbours whose common prefix ends in this block
        classes = np.concatenate([np.zeros(1, "int32"), np.cumsum(edge, dtype="int32")])
    return shard, classes


def repeated_windows(texts: list[bytes], identity: np.ndarray) -> list[np.ndarray]:
    """For each text the starts of windows that also occur at another place; ``identity``: place of each text's first byte as (document, offset)."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    shards, at = [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + SHARD_BYTES, side="right")) - 1)
        shards.append((at, end))
        at = end
    data = np.frombuffer(b"".join(texts), "uint8")
    blocks = block_letters(data, starts[[a for a, _ in shards] + [len(texts)]])
    transforms, places = [], []
    for a, b in shards:
        own = blocks[starts[a] : starts[b]]
        order = shard_suffixes(own)
        transforms.append(np.roll(own, STEP)[order])
        places.append((order + starts[a]).astype("int32"))
    shard, classes = merge_transforms(transforms, int(blocks.max()))
    place = np.empty(len(data), "int32")
    place[np.argsort(shard, kind="stable")] = np.concatenate(places)
    text = np.searchsorted(starts, place, side="right") - 1
    whole = place + LENGTH <= starts[text + 1]
    place, text, classes = place[whole], text[whole], classes[whole]
    if not len(place):
        return [np.zeros(0, "int64") for _ in texts]
    document, offset = identity[text, 0], identity[text, 1] + place - starts[text]
    edge = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    differs = (np.minimum.reduceat(document, edge) != np.maximum.reduceat(document, edge)) | (np.minimum.reduceat(offset, edge) != np.maximum.reduceat(offset, edge))
    again = np.repeat(differs, np.diff(np.concatenate([edge, [len(classes)]])))
    place, text = place[again], text[again]
    order = np.argsort(place)
    place, text = place[order].astype("int64") - starts[text[order]], text[order]
    return np.split(place, np.searchsorted(text, np.arange(1, len(texts))))


CONTEXT = "doc_id long, digest long, anchor long, low long, bytes binary"
RUN = "doc_id long, digest long, low long, high long"


def fetch_contexts(docs: DataFrame, needs: DataFrame) -> DataFrame:
    """Bytes of the contexts in ``needs``."""
    wanted = needs.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("wanted"))
    d, w = docs.alias("d"), wanted.alias("w")
    joined = d.join(w, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.digest") == F.col("w.digest"))).select("d.doc_id", "d.digest", "d.text", "w.wanted")

    def run(it):
        import pyarrow as pa

        for batch in it:
            lists = batch.column(3)
            flat = lists.flatten()
            which = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            low, high = flat.field(1).to_numpy(zero_copy_only=False), flat.field(2).to_numpy(zero_copy_only=False)
            body, held, out = b"", -1, []
            for row, a, b in zip(which.tolist(), low.tolist(), high.tolist(), strict=True):
                if row != held:
                    body, held = batch.column(2)[row].as_py().encode("utf-8", "surrogatepass"), row
                out.append(body[a:b])
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), flat.field(0), flat.field(1), pa.array(out, pa.binary())], names=["doc_id", "digest", "anchor", "low", "bytes"])

    return joined.mapInArrow(tidy(run), CONTEXT)


def _run_rows(group, starts: list[np.ndarray]):
    """Runs covered by windows that begin at ``starts`` of each context."""
    import pyarrow as pa

    low = group.column("low").to_numpy()
    rows, lows, highs = [], [], []
    for k, own in enumerate(starts):
        if len(own):
            a, b = merged(own + low[k], own + low[k] + LENGTH)
            rows.append(np.full(len(a), k))
            lows.append(a)
            highs.append(b)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, "int64")
    take = pa.array(join(rows).astype("int64"))
    table = group.select(["doc_id", "digest"]).take(take).append_column("low", pa.array(join(lows))).append_column("high", pa.array(join(highs)))
    return table.combine_chunks().to_batches()


def matched_runs(contexts: DataFrame) -> DataFrame:
    """Repeated runs among the contexts of equal anchors, by merged transforms."""

    def solve(group):
        digest = group.column("digest").to_numpy()
        ids = group.column("doc_id").fill_null(-1).to_numpy()
        low = group.column("low").to_numpy()
        _, document = np.unique(np.stack([ids, digest], axis=1), axis=0, return_inverse=True)
        texts = group.column("bytes").to_pylist()
        yield from _run_rows(group, repeated_windows(texts, np.stack([document.ravel(), low], axis=1)))

    def run(it):
        for group in _whole_groups(it, "anchor"):
            size = np.cumsum([len(b.as_buffer()) for b in group.column("bytes")])
            anchor = group.column("anchor").to_numpy()
            ends = np.flatnonzero(np.concatenate([anchor[1:] != anchor[:-1], [True]])) + 1
            begin = 0
            for k, end in enumerate(ends):  # as many whole anchors at a time as TASK_BYTES allow
                if k + 1 == len(ends) or size[ends[k + 1] - 1] - (size[begin - 1] if begin else 0) > TASK_BYTES:
                    if end - begin > 1:
                        yield from solve(group.slice(begin, end - begin))
                    begin = end

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(run), RUN)


def counted_runs(contexts: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: every window is a row, counted by two hashes."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column(4)[k].as_py(), "uint8")
                n = len(data) - LENGTH + 1
                if n < 1:
                    continue
                at = np.arange(n)
                one, two = (RangeHash(data, b).of(at, at + LENGTH).view("int64") for b in (_B1, _B2))
                take = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(at + batch.column(3)[k].as_py()), pa.array(one), pa.array(two)], names=["doc_id", "digest", "low", "one", "two"])

    windows = contexts.select("doc_id", "digest", "anchor", "low", "bytes").mapInArrow(tidy(run), "doc_id long, digest long, low long, one long, two long")
    place = F.struct("doc_id", "digest", "low")
    again = windows.groupBy("one", "two").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter(~F.col("a").eqNullSafe(F.col("b"))).select("one", "two")
    again = materialise(again, "again")  # written, so that the join of a frequent window can be split
    return windows.join(again, ["one", "two"], "left_semi").select("doc_id", "digest", "low", (F.col("low") + LENGTH).alias("high"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, runs): repeated runs of each text that has any; ``docs`` as of ``_identified``."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "anchors")
    runs, needs = sort_out(written(anchor_rows(docs), path))
    discard(spark, path)  # the largest table
    contexts = materialise(fetch_contexts(docs, needs), "contexts")
    hot = materialise(contexts.groupBy("anchor").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select("anchor"), "hot")
    runs = runs.unionByName(matched_runs(contexts.join(hot, "anchor", "left_anti")))
    if hot.limit(1).count():
        runs = runs.unionByName(materialise(counted_runs(contexts.join(hot, "anchor", "left_semi")), "counted"))
    return runs.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("low", "high")).alias("runs"))


def _with_runs(docs: DataFrame, found: DataFrame, others: list[str]) -> DataFrame:
    d, r = docs.alias("d"), found.alias("r")
    joined = d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.digest") == F.col("r.digest")), "left")
    return joined.select("d.doc_id", "d.text", "r.runs", *[F.col(f"d.{c}") for c in others])


def kept_bytes(text: str, runs) -> tuple[bytes, bytes, int]:
    """All bytes, those kept, and the number of maximal removed runs."""
    body = (text or "").encode("utf-8", "surrogatepass")
    if not runs:
        return body, body, 0
    low, high = merged(np.array([r["low"] for r in runs]), np.array([r["high"] for r in runs]))
    edges = [0, *(x for pair in zip(low.tolist(), high.tolist(), strict=True) for x in pair), len(body)]
    return body, b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(low)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    known = _identified(docs, doc_id, text)

    def run(it):
        import pyarrow as pa

        for batch in it:
            rows = []
            for value, runs in zip(batch.column(1), batch.column(2), strict=True):
                body, kept, spans = kept_bytes(value.as_py(), runs.as_py())
                rows.append((len(body), len(body) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_runs(known, repeated_runs(known), []).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text`` (a character cut in two goes whole) and ``n_chars``, where there, counted anew.

    Other columns stay as they are, whatever their names.
    """
    names = docs.columns
    columns = [f"c{k}" for k in range(len(names))]
    doc_id, text = (columns[names.index(c)] for c in ("doc_id", "text"))
    plain = docs.toDF(*columns)
    known = plain.withColumn("_digest", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    found = repeated_runs(_identified(plain, doc_id, text)).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_own"), "runs")
    joined = known.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_own")), "left").select(*columns, "runs")
    schema, at = T.StructType(joined.schema.fields[:-1]), columns.index(text)

    def run(it):
        import pyarrow as pa

        for batch in it:
            texts = []
            for value, runs in zip(batch.column(at), batch.column(len(columns)), strict=True):
                cut = runs.as_py()
                texts.append(kept_bytes(value.as_py(), cut)[1].decode("utf-8", "ignore") if cut else value.as_py())
            arrays = batch.columns[: len(columns)]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    cut = joined.mapInArrow(tidy(run), schema).toDF(*names)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return cut
