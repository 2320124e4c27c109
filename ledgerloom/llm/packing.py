"""Best-fit packing of token pieces into sequences of a fixed capacity.

Hierarchical residual packing.  Every input partition packs its own pieces by
best fit (longest first, into the fullest bin that has room) and emits the
nearly full bins.  Underfull bins become items of the next round, in which an
eighth as many tasks pack them again, and so on up the tree.  Only bins that
are still underfull move, as lists of piece descriptions without token ids.

A task of a later round gets at most about ``MAX_ITEMS`` items; the tree ends
at one task, or where a round no longer lowers the number of bins (lengths that
no two bins can share).  What is underfull then is emitted as it is: no piece is
dropped.

Defined results: null text counts as empty and becomes one piece of the end
token alone; repeated rows are packed as often as they occur; an empty table
gives an empty result; ties in length go by doc_id and piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ENCODED_BYTES, default_vocabulary, model
from .common import bounded_batches, input_partitions, materialise, tidy

CAPACITY = 4096
END_ID = 1
SLACK = 4  # a bin with at most so much room left is emitted at once
FAN_IN = 8
MAX_ITEMS = 200_000

MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
BIN = f"bin long, fill long, members array<{MEMBER}>"
FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")


def best_fit(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Bins as lists of positions in ``lengths``, which must fall.

    ``free`` has bit r set while some bin has exactly r left, so the tightest
    bin with room is found by one shift.
    """
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = {}
    free = 0
    for at, length in enumerate(lengths):
        fits = free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            held = with_room[room]
            number = held.pop()
            if not held:
                free &= ~(1 << room)
        else:
            room, number = capacity, len(bins)
            bins.append([])
        bins[number].append(at)
        if left := room - length:
            with_room.setdefault(left, []).append(number)
            free |= 1 << left
    return bins


def _pack(columns: dict[str, np.ndarray], groups: np.ndarray, round_: int, capacity: int):
    """Pack groups of members (``groups``: where each begins, and the end) and return one Arrow row a bin."""
    import pyarrow as pa

    sizes = np.diff(groups)
    fills = np.add.reduceat(columns["length"], groups[:-1]) if len(sizes) else np.zeros(0, "int64")
    first = groups[:-1]
    order = np.lexsort((columns["piece"][first], columns["doc_id"][first], -fills)) if len(sizes) else np.zeros(0, "int64")
    bins = best_fit(fills[order].tolist(), capacity)
    partition = TaskContext.get().partitionId()
    take, ends, totals = [], [0], []
    for members in bins:
        at = 0
        for item in members:
            group = order[item]
            take.append((groups[group], groups[group + 1], at))
            at += int(fills[group])
        totals.append(at)
        ends.append(ends[-1] + sum(int(sizes[order[i]]) for i in members))
    rows = np.concatenate([np.arange(a, b) for a, b, _ in take]) if take else np.zeros(0, "int64")
    shift = np.concatenate([np.full(b - a, s) for a, b, s in take]) if take else np.zeros(0, "int64")
    arrays = [columns[f][rows] + (shift if f == "offset" else 0) for f in FIELDS]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    nulls = columns["no_id"][rows]
    members = pa.StructArray.from_arrays([pa.array(a, k, mask=nulls if f == "doc_id" else None) for a, k, f in zip(arrays, kinds, FIELDS, strict=True)], names=list(FIELDS))
    base = ((round_ << 24) | partition) << 32
    for at in range(0, len(bins), 5000):
        part = slice(at, at + 5000)
        cut = ends[at : at + len(bins[part]) + 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(at, at + len(bins[part])) + base, pa.int64()), pa.array(totals[part], pa.int64()), pa.ListArray.from_arrays(pa.array(np.array(cut) - cut[0], pa.int32()), members.slice(cut[0], cut[-1] - cut[0]))],
            names=["bin", "fill", "members"],
        )


def _columns(parts: dict[str, list[np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate(v) if v else np.zeros(0, bool if k == "no_id" else "int64") for k, v in parts.items()}


def _ids(column) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype("int64"), column.is_null().to_numpy(zero_copy_only=False)


def _packer(capacity: int):
    """The first round, over Arrow batches: each partition packs its own pieces."""

    def run(it):
        parts = {f: [] for f in (*FIELDS, "no_id")}
        for batch in it:
            for name in FIELDS[:-1]:
                values, nulls = _ids(batch.column(name))
                parts[name].append(values)
                if name == "doc_id":
                    parts["no_id"].append(nulls)
            parts["offset"].append(np.zeros(batch.num_rows, "int64"))
        columns = _columns(parts)
        yield from _pack(columns, np.arange(len(columns["doc_id"]) + 1), 0, capacity)

    return run


def _pack_bins(bins: DataFrame, round_: int, capacity: int) -> DataFrame:
    """A later round: underfull bins are the items."""

    def run(it):
        parts, ends, total = {f: [] for f in (*FIELDS, "no_id")}, [np.zeros(1, "int64")], 0
        for batch in it:
            lists = batch.column("members")
            flat = lists.flatten()
            for i, name in enumerate(FIELDS):
                values, nulls = _ids(flat.field(i))
                parts[name].append(values)
                if name == "doc_id":
                    parts["no_id"].append(nulls)
            ends.append(np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) + total)
            total += len(flat)
        yield from _pack(_columns(parts), np.concatenate(ends).astype("int64"), round_, capacity)

    return bins.mapInArrow(tidy(run), BIN)


def _blocks(batches: Iterable) -> Iterator:
    """Batches (id, text) put together up to a bounded number of bytes, so that a word of several is solved once."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= ENCODED_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _tokeniser(vocabulary: str, capacity: int):
    """Token pieces of Arrow batches (doc_id, text)."""

    def run(it):
        import pyarrow as pa

        bpe, end = model(vocabulary), np.array([END_ID], "<u4").tobytes()
        for batch in _blocks(it):
            rows: list[tuple] = []
            for i, ids in zip(batch.column(0).to_pylist(), bpe.encode_all(batch.column(1)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(FIELDS[:-1]))

    return run


def _slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def pieces_of(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token pieces of whole documents: each document's ids and the end id, cut only where longer than ``capacity``."""
    run = _tokeniser(vocabulary or default_vocabulary(), capacity)
    return _slim(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """Pack rows (doc_id, piece, start, length, ids_crc32) and return them with sequence_id and offset."""
    return _pack_up(pieces.mapInArrow(tidy(_packer(capacity)), BIN), input_partitions(pieces), capacity, slack, fan_in)


def _pack_up(first: DataFrame, tasks: int, capacity: int, slack: int, fan_in: int) -> DataFrame:
    """The tree of rounds over the bins of the first one."""
    bins, round_ = materialise(first, "bins"), 0
    packed = bins.filter(F.col("fill") >= capacity - slack)
    rest = bins.filter(F.col("fill") < capacity - slack)
    left = rest.count()
    while tasks > 1 and left > 1:
        round_ += 1
        tasks = max(-(-tasks // fan_in), -(-left // MAX_ITEMS))
        bins = materialise(_pack_bins(rest.repartition(tasks, "bin"), round_, capacity), "bins")
        packed = packed.unionByName(bins.filter(F.col("fill") >= capacity - slack))
        rest = bins.filter(F.col("fill") < capacity - slack)
        before, left = left, rest.count()
        if left > MAX_ITEMS and left > 0.99 * before:
            break
    return packed.unionByName(rest).select(F.col("bin").alias("sequence_id"), F.inline("members")).select(*FIELDS[:-1], "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise whole documents and pack their pieces; one Python worker a task does both."""
    tokenise, packer = _tokeniser(vocabulary or default_vocabulary(), capacity), _packer(capacity)
    slim = _slim(docs, doc_id, text)
    return _pack_up(slim.mapInArrow(tidy(lambda it: packer(tokenise(it))), BIN), input_partitions(slim), capacity, SLACK, FAN_IN)
