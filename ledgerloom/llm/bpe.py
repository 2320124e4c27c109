"""BPE encoding and decoding by per-prefix dynamic programming.

For a byte-pair vocabulary every prefix of a word has exactly one possible last
token.  :class:`BpeModel` finds it from left to right: a suffix automaton of the
vocabulary (:class:`SuffixAutomaton`) follows the longest suffix of the prefix
that occurs inside any entry and so lists the entries that end at a position,
longest first; the one that is *compatible* with the last token of the prefix
before it is stored.  Following the stored tokens back from the end gives the
exact ids, in time linear in the word.  No merge queue is run, so a
megabyte-long word costs the same per byte as a short one.

Two neighbours are compatible if undoing their merges from the latest to the
earliest never uncovers a merge across the border that would have come first.

The DataFrame side (:func:`encode`) maps Arrow batches; each Python worker
builds the model once.  The different words of a block of texts are solved
together in numpy: they are sorted, so that a prefix that several words share is
solved once (:meth:`BpeModel.solve`).  Where texts are only encoded, their words are
split and numbered in Arrow, so that only the different words of a larger block
become Python strings (:meth:`BpeModel.encode_all`).  Words of over ``LONG_WORD`` bytes are
solved one by one.

Defined results: null text encodes as the empty string; empty text gives no
tokens; repeated rows are each encoded; a null doc_id stays null; very long texts
are encoded whole; an empty table gives an empty result; other columns are kept
unless they clash with an output column, whose value then wins.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

from .common import bounded_batches, tidy

END = "\x01"  # stands for the end-of-word mark inside the automaton
END_SYMBOL = 256
LONG_WORD = 62
BLOCK_WORDS = 20_000  # words that are laid out together
BLOCK_CHARS = 3_000_000  # characters of texts whose words are solved together
ENCODED_BYTES = 12_000_000  # bytes of texts that are only encoded, together
PAIR_SLOTS = 1 << 20  # pairs of tokens whose compatibility is remembered


def default_vocabulary() -> str:
    """Path of the public word-level vocabulary; callers may pass any other."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """Printable stand-in of each byte value, as byte-level vocabularies use it."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for value in range(256):
        if value in printable:
            out.append(chr(value))
        else:
            out.append(chr(spare))
            spare += 1
    return out


# The characters that the quick path handles: below U+0250 Python's case and
# category data agree with the library's.
QUICK_LIMIT = 0x250


def _character_class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(QUICK_LIMIT) if unicodedata.category(chr(c))[0] == kind)


SPACE = r"\t-\r \x85\xa0"
_LETTER, _NUMBER = _character_class("L"), _character_class("N")
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{SPACE}{_LETTER}{_NUMBER}]+")
WORD_OR_END = re.compile(WORD.pattern + "|\n")
_GROWS = "".join(c for c in map(chr, range(QUICK_LIMIT)) if max(c.lower()) >= chr(QUICK_LIMIT))
RARE = re.compile(f"[^\x00-{chr(QUICK_LIMIT - 1)}]|[{_GROWS}]")  # also what lower case takes out of the quick range
ODD_SPACE = re.compile("[\x1c-\x1f]")  # str.split() takes these as white space, the library does not
SPACES = re.compile(rf"[{SPACE}  -     　]+")


class SuffixAutomaton:
    """All substrings of a set of strings as one automaton; each state lists the strings that end in it.

    ``follow`` walks a word; ``ends[state]`` are the (size, value) of the strings
    that are suffixes of what was read, longest first.  Only those no longer than
    the current match count.
    """

    def __init__(self, strings: dict[str, int]):
        self.steps: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for string in strings:
            state = 0
            for symbol in string:
                state = self._extend(state, symbol)
        # a later string may have split the state of an earlier one: walk each again
        own: dict[int, list[tuple[int, int]]] = {}
        for string, value in strings.items():
            state = 0
            for symbol in string:
                state = self.steps[state][symbol]
            own.setdefault(state, []).append((len(string), value))
        self.ends: list[tuple] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.ends[state] = (*sorted(own.get(state, ()), reverse=True), *self.ends[self.link[state]])

    def _state(self, length: int, link: int, steps: dict[str, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.steps.append(steps)
        return len(self.link) - 1

    def _split(self, at: int, symbol: str, target: int) -> int:
        """The strings that reach ``target`` from ``at`` and its suffixes become a state of their own."""
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.steps[target]))
        self.link[target] = copy
        while at >= 0 and self.steps[at].get(symbol) == target:
            self.steps[at][symbol] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, symbol: str) -> int:
        target = self.steps[last].get(symbol)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and symbol not in self.steps[at]:
            self.steps[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            target = self.steps[at][symbol]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, symbol, target)
        return new


class BpeModel:
    """A word-level BPE vocabulary with an end-of-word mark."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.surface = {i: token for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.surface.update({i: token for token, i in self.special.items()})
        self.alphabet = byte_alphabet()

        vocab = model["vocab"]
        size = max(self.surface) + 1
        self.rank, self.left, self.right = np.full(size, -1), np.zeros(size, "int64"), np.zeros(size, "int64")
        merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[a + b]
            self.left[whole], self.right[whole], self.rank[whole] = vocab[a], vocab[b], rank
            merge[vocab[a] << 20 | vocab[b]] = rank
        self.merge_key = np.array(sorted(merge))
        self.merge_rank = np.array([merge[k] for k in self.merge_key.tolist()])
        self._lay_out(SuffixAutomaton({token[: -len(suffix)] + END if token.endswith(suffix) and token != suffix else token: i for token, i in vocab.items()}))
        self.pair_key, self.pair_fits = np.full(PAIR_SLOTS, -1), np.zeros(PAIR_SLOTS, bool)
        self._special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _lay_out(self, automaton: SuffixAutomaton) -> None:
        """The automaton as arrays: an open-addressed table of steps, and the entries that end in each state."""
        number = {c: b for b, c in enumerate(self.alphabet)} | {END: END_SYMBOL}
        steps = [(state << 9 | number[c], to) for state, own in enumerate(automaton.steps) for c, to in own.items() if c in number]
        self.step_mask = (1 << int(4 * len(steps)).bit_length()) - 1
        self.step_key, self.step_to = np.full(self.step_mask + 1, -1, "int64"), np.full(self.step_mask + 1, -1, "int32")
        key, to = (np.array(x) for x in zip(*steps, strict=True))
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):  # place what finds its slot free, move the others on by one
            free = left[self.step_key[slot[left]] < 0]
            self.step_key[slot[free]] = key[free]  # of two in one slot the last stays
            placed = left[self.step_key[slot[left]] == key[left]]
            self.step_to[slot[placed]] = to[placed]
            left = left[self.step_key[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & self.step_mask
        self.link, self.length = np.array(automaton.link), np.array(automaton.length)
        self.ends_at = np.concatenate([[0], np.cumsum([len(e) for e in automaton.ends])])
        self.ends_size, self.ends_token = (np.array([x[k] for e in automaton.ends for x in e]) for k in (0, 1))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype("int64") & self.step_mask

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state that each symbol leads to, or -1."""
        key = state << 9 | symbol
        slot = self._slot(key)
        out = np.full(len(key), -1)
        left = np.arange(len(key))
        while len(left):
            at = slot[left]
            held = self.step_key[at]
            hit = held == key[left]
            out[left[hit]] = self.step_to[at[hit]]
            left = left[~hit & (held >= 0)]
            slot[left] = (slot[left] + 1) & self.step_mask
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` followed by ``right`` survives as two tokens."""
        return bool(self._fits(np.array([left]), np.array([right]))[0])

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs, by a table of the pairs seen last."""
        key = left << 20 | right
        slot = ((key.astype("uint64") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype("int64") & (PAIR_SLOTS - 1)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            found = self._compatible(fresh >> 20, fresh & 0xFFFFF)
            out[new] = found[back]
            self.pair_key[slot[new]] = key[new]
            self.pair_fits[slot[new]] = self._settled(slot[new], key[new], out[new])
        return out

    def _settled(self, slot: np.ndarray, key: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Values for slots that several keys were written to: each slot's last key decides."""
        stays = self.pair_key[slot] == key
        last = np.zeros(PAIR_SLOTS, bool)
        last[slot[stays]] = value[stays]
        return last[slot]

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merges are undone from the latest to the earliest; a pair fits if no merge across the border would have come first."""
        out = np.ones(len(left), bool)
        limit = np.full(len(left), len(self.merge_key) + 1)
        left, right, todo = left.copy(), right.copy(), np.arange(len(left))
        while len(todo):
            a, b = left[todo], right[todo]
            key = a << 20 | b
            at = np.minimum(np.searchsorted(self.merge_key, key), len(self.merge_key) - 1)
            across = (self.merge_key[at] == key) & (self.merge_rank[at] < limit[todo])
            out[todo[across]] = False
            made_left, made_right = self.rank[a], self.rank[b]
            go = ~across & ((made_left >= 0) | (made_right >= 0))
            undo_left = made_left > made_right  # equal merges run from left to right, so the right one is undone first
            limit[todo] = np.where(undo_left, made_left, made_right + 1)
            left[todo], right[todo] = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            todo = todo[go]
        return out

    def solve(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens (UTF-8), as little-endian unsigned 32-bit integers.

        One column a prefix length: rows are the sorted words, and the rows that
        share a prefix share its state and its last token.
        """
        order = sorted(range(len(words)), key=words.__getitem__)
        words = [words[k] for k in order]
        sizes = np.array([len(w) for w in words])
        n, width = len(words), int(sizes.max()) + 1
        symbols = np.full((n, width), 0x1FF, "int16")
        inside = np.arange(width) < sizes[:, None]
        symbols[inside] = np.frombuffer(b"".join(words), "uint8")
        symbols[np.arange(n), sizes] = END_SYMBOL
        fresh = np.ones((n, width), bool)
        fresh[1:] = ~np.logical_and.accumulate(symbols[1:] == symbols[:-1], axis=1)
        state, matched = np.zeros(n, "int64"), np.zeros(n, "int64")
        last, begin = np.full((n, width + 1), -1, "int32"), np.zeros((n, width + 1), "int16")
        for at in range(width):
            rows = np.flatnonzero(sizes >= at)
            new = fresh[rows, at]
            own = rows[new]
            symbol = symbols[own, at].astype("int64")
            s, length = state[own], matched[own]
            to = self._step(s, symbol)
            while len(lost := np.flatnonzero((to < 0) & (s > 0))):
                s[lost] = self.link[s[lost]]
                length[lost] = self.length[s[lost]]
                to[lost] = self._step(s[lost], symbol[lost])
            s, length = np.maximum(to, 0), np.where(to < 0, 0, length + 1)
            token, start = np.full(len(own), -1, "int64"), np.zeros(len(own), "int64")
            place, stop = self.ends_at[s], self.ends_at[s + 1]
            todo = np.flatnonzero(place < stop)
            while len(todo):
                size, entry = self.ends_size[place[todo]], self.ends_token[place[todo]]
                short = size <= length[todo]
                before = last[own[todo], np.maximum(at + 1 - size, 0)].astype("int64")
                good = short & (size == at + 1)
                ask = np.flatnonzero(short & (before >= 0))
                good[ask] |= self._fits(before[ask], entry[ask])
                done = todo[good]
                token[done], start[done] = entry[good], at + 1 - size[good]
                todo = todo[~good]
                place[todo] += 1
                todo = todo[place[todo] < stop[todo]]
            node = np.cumsum(new) - 1
            state[rows], matched[rows] = s[node], length[node]
            last[rows, at + 1], begin[rows, at + 1] = token[node], start[node]
        return self._followed_back(last, begin, sizes + 1, order)

    @staticmethod
    def _followed_back(last: np.ndarray, begin: np.ndarray, at: np.ndarray, order: list[int]) -> list[bytes]:
        steps, rows = [], np.arange(len(at))
        counts = np.zeros(len(at), "int64")
        while len(rows):
            steps.append((rows, last[rows, at[rows]]))
            counts[rows] += 1
            at[rows] = begin[rows, at[rows]]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]), "<u4")
        for k, (rows, token) in enumerate(steps):
            flat[ends[rows] - 1 - k] = token
        data, out, a = flat.tobytes(), [b""] * len(order), 0
        for row, b in zip(order, (4 * ends).tolist(), strict=True):
            out[row] = data[a:b]
            a = b
        return out

    def _solve_long(self, word: bytes) -> bytes:
        """One word of any length: the same in plain Python, without a row for every prefix of a whole block."""
        symbols = [*word, END_SYMBOL]
        state = matched = 0
        last, start_of = [-1], [0]
        link, length, ends_at = self.link, self.length, self.ends_at
        for end, symbol in enumerate(symbols, 1):
            while (to := self._step_one(state, symbol)) < 0 and state:
                state = int(link[state])
                matched = int(length[state])
            state, matched = (to, matched + 1) if to >= 0 else (0, 0)
            token, start = -1, 0
            for k in range(ends_at[state], ends_at[state + 1]):
                size, entry = int(self.ends_size[k]), int(self.ends_token[k])
                if size <= matched and (size == end or last[end - size] >= 0 and self.compatible(last[end - size], entry)):
                    token, start = entry, end - size
                    break
            last.append(token)
            start_of.append(start)
        ids, at = [], len(symbols)
        while at:
            ids.append(last[at])
            at = start_of[at]
        return np.array(ids[::-1], "<u4").tobytes()

    def _step_one(self, state: int, symbol: int) -> int:
        key = state << 9 | symbol
        slot = (((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 40) & self.step_mask
        while (held := self.step_key[slot]) != key:
            if held < 0:
                return -1
            slot = (slot + 1) & self.step_mask
        return int(self.step_to[slot])

    def word_ids(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        return np.frombuffer(self.solve([word.encode("utf-8")])[0], "<u4").tolist() if word else []

    def _words(self, chunks: list[str]) -> tuple[list[str], list[str]]:
        """Runs without white space, and all their pre-tokens in order, each run's ended by ``"\\n"``."""
        plain, rare, pieces = [], [], []
        for chunk in chunks:
            (plain if chunk.isascii() or not RARE.search(chunk) else rare).append(chunk)
        if plain:
            pieces = WORD_OR_END.findall(unicodedata.normalize("NFC", "\n".join(plain)).lower() + "\n")
        for chunk in rare:
            pieces += self._rare_words(chunk)
            pieces.append("\n")
        return plain + rare, pieces

    @functools.cached_property
    def library(self):
        """The library's tokenizer: only its normaliser and splitter, for rare characters."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _rare_words(self, chunk: str) -> list[str]:
        """Pre-tokens by the library's normaliser and splitter."""
        normal = self.library.normalizer.normalize_str(chunk)
        back = {c: b for b, c in enumerate(self.alphabet)}
        return [bytes(back[c] for c in piece).decode("utf-8") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def segments(self, text: str) -> Iterator[int | list[str]]:
        """Special token ids and lists of white-space separated chunks, in order."""
        if self._special_split is not None and any(s in text for s in self.special):
            for piece in self._special_split.split(text):
                if piece in self.special:
                    yield self.special[piece]
                elif piece:
                    yield self._chunks(piece)
        else:
            yield self._chunks(text)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if ODD_SPACE.search(text):
            return [c for c in SPACES.split(text) if c]
        return text.split()

    def chunk_ids(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of each of ``chunks``; a word that several hold is solved once."""
        chunks, pieces = self._words(chunks)
        words = sorted(set(pieces) - {"\n"}, key=len)
        coded = "\n".join(words).encode("utf-8").split(b"\n") if words else []
        short = next((k for k, w in enumerate(words) if 4 * len(w) > LONG_WORD and len(coded[k]) > LONG_WORD), len(words))
        solved: list[bytes] = []
        for at in range(0, short, BLOCK_WORDS):  # like lengths together
            solved += self.solve(coded[at : min(at + BLOCK_WORDS, short)])
        solved += map(self._solve_long, coded[short:])
        of_word: dict[str, bytes | None] = dict(zip(words, solved, strict=True))
        of_word["\n"] = None
        ids = list(map(of_word.__getitem__, pieces))
        out, at = {}, 0
        for chunk, end in zip(chunks, [k for k, x in enumerate(ids) if x is None], strict=True):
            out[chunk] = ids[at] if end == at + 1 else b"".join(ids[at:end])
            at = end + 1
        return out

    def encode_all(self, texts) -> Iterator[bytes]:
        """Ids of whole texts (a list or an Arrow array) as little-endian unsigned 32-bit integers."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64")) // (2 * ENCODED_BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        for a, b in pairwise(cuts):
            yield from self._encode_block(texts.slice(a, b - a))

    def _encode_block(self, texts) -> Iterator[bytes]:
        """Words are split and numbered in Arrow, which also lays out the ids of the different ones by number."""
        import pyarrow as pa
        import pyarrow.compute as pc

        marked = np.zeros(len(texts), bool)
        for special in self.special:
            marked |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pc.if_else(marked, "", texts) if marked.any() else texts)
        numbered = words.flatten().dictionary_encode()
        ids = pa.array(self._ids_of(numbered.dictionary.to_pylist()), pa.large_binary()).take(numbered.indices)
        data, ends = ids.buffers()[2], np.frombuffer(ids.buffers()[1], "int64") if len(ids) else np.zeros(1, "int64")
        for k, (a, b) in enumerate(pairwise(ends[words.offsets.to_numpy()].tolist())):
            yield self._encode_marked(texts[k].as_py()) if marked[k] else data[a:b].to_pybytes() if a < b else b""

    def _encode_marked(self, text: str) -> bytes:
        """A text with special tokens."""
        return b"".join([np.array([p], "<u4").tobytes() if isinstance(p, int) else b"".join(self._ids_of(p)) for p in self.segments(text)])

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words without ASCII white space; those with other white space are split further."""
        finer = {w: parts for w in words if not (w and w.isascii()) and (parts := self._chunks(w)) != [w]}
        solved = self.chunk_ids(list({*words} - finer.keys() | {p for parts in finer.values() for p in parts}))
        solved |= {w: b"".join([solved[p] for p in parts]) for w, parts in finer.items()}
        return [solved[w] for w in words]

    @staticmethod
    def _chunks_of(block: list[list]) -> list[str]:
        return list(set().union(*[part for parts in block for part in parts if not isinstance(part, int)]))

    def _blocks(self, texts: list[str | None]) -> Iterator[list[list]]:
        """The segments of each text, a bounded number of texts at a time."""
        held, chars = [], 0
        for text in texts:
            held.append(list(self.segments(text or "")))
            chars += len(text or "")
            if chars > BLOCK_CHARS:
                yield held
                held, chars = [], 0
        if held:
            yield held

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return next(self.encode_all([text]))

    def surfaces(self, ids: bytes) -> str:
        return " ".join([self.surface[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def decode(self, ids: bytes) -> str:
        """The text that the library's decode gives without a decoder stage: token strings joined by blanks."""
        return self.surfaces(ids)

    def encode_and_decode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Both directions of whole texts: the ids, and what they decode to; equal runs of a block are decoded once."""
        for block in self._blocks(texts):
            surface, ids = self.surface, self.chunk_ids(self._chunks_of(block))
            ids_of, chunks, found = ids.__getitem__, list(ids), list(ids.values())
            flat = np.frombuffer(b"".join(found), "<u4").tolist()
            names, at, text_of = [surface[i] for i in flat], 0, {}
            for chunk, ids in zip(chunks, found, strict=True):
                to = at + len(ids) // 4
                text_of[chunk] = names[at] if to == at + 1 else " ".join(names[at:to])
                at = to
            for parts in block:
                ids, words = [], []
                for part in parts:
                    if isinstance(part, int):
                        ids.append(np.array([part], "<u4").tobytes())
                        words.append(surface[part])
                    else:
                        ids += map(ids_of, part)
                        words += filter(None, map(text_of.__getitem__, part))
                yield b"".join(ids), " ".join(words)

    def encode_and_decode(self, text: str | None) -> tuple[bytes, str]:
        return next(self.encode_and_decode_all([text]))


@functools.lru_cache(maxsize=4)
def model(path: str) -> BpeModel:
    """One model a Python worker and vocabulary."""
    return BpeModel(path)


def encode(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Add ``token_ids`` (array of long) and ``decoded`` to every row of ``df``."""
    from pyspark.sql import types as T

    vocabulary = vocabulary or default_vocabulary()
    kept = [f for f in df.schema.fields if f.name.lower() not in ("token_ids", "decoded")]
    schema = T.StructType([*kept, T.StructField("token_ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())])

    def batches(it):
        import pyarrow as pa

        bpe = model(vocabulary)
        for batch in it:
            pairs = list(bpe.encode_and_decode_all(batch.column(batch.schema.get_field_index(text)).to_pylist()))
            keep = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            ids = pa.array([np.frombuffer(i, "<u4").astype("int64") for i, _ in pairs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*keep, ids, pa.array([d for _, d in pairs], pa.string())], names=schema.names)

    return df.mapInArrow(tidy(batches), schema)


def digests(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: token count and digests of its ids and of the decoded text."""
    vocabulary = vocabulary or default_vocabulary()
    id_type = docs.schema[doc_id].dataType.simpleString()

    def batches(it):
        import pyarrow as pa

        bpe = model(vocabulary)
        for batch in it:
            rows = []
            for ids, words in bpe.encode_and_decode_all(batch.column(1).to_pylist()):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(words.encode("utf-8")).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    slim = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    return slim.mapInArrow(tidy(batches), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
