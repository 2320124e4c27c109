"""Texts of an Arrow batch as one byte array, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 400_000


class Slice:
    """Stretches of texts, one after the other, as bytes.

    ``rows``: the row of each stretch; ``starts``: where each begins, and the end;
    ``offsets``: place of each stretch's first byte in its text, which begins with its padding;
    ``own``: bytes of each stretch that the next stretch of the text does not repeat.
    """

    def __init__(self, stretches: list[tuple[int, int, int, bytes]]):
        rows, offsets, own, parts = zip(*stretches, strict=True)
        self.rows, self.offsets, self.own = np.array(rows), np.array(offsets), np.array(own)
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.data = np.frombuffer(b"".join(parts), "uint8")


def slices(texts, lower: bool = False, before: bytes = b"", after: bytes = b"", overlap: int = 0, most: int | None = None) -> Iterator[Slice]:
    """Slices over rows of ``texts`` (an Arrow string array).

    Each text has ``before`` and ``after`` around it.  A text longer than
    ``SLICE_BYTES`` is cut into stretches in which every string of
    ``overlap + 1`` bytes lies in exactly one.
    """
    most = most or SLICE_BYTES
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for row, value in enumerate(texts):
        text = value.as_py() or ""
        body = before + (text.lower() if lower else text).encode("utf-8", "surrogatepass") + after
        at, end = 0, False
        while not end:
            part = body[at : at + most]
            end = at + most >= len(body)
            if held and size + len(part) > most:
                yield Slice(held)
                held, size = [], 0
            held.append((row, at, len(part) if end else most - overlap, part))
            size += len(part)
            at += most - overlap
    if held:
        yield Slice(held)
