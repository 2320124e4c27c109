"""Texts that are only encoded: their words are numbered in Arrow and solved once for a larger block."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, packing

WHITE = [" ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "　", "  "]


def test_encode_all_equals_the_library():
    rng, lib, model = random.Random(5), Tokenizer.from_file(bpe.default_vocabulary()), bpe.model(bpe.default_vocabulary())
    words = ["The", "the", "don't", "ÉTÉ", "é", "İx", "漢字", "42nd", "...", "😀", "a" * 90, "<|endoftext|>", "x<|startoftext|>y", "n\x1cm", "​"]
    texts = ["".join(rng.choice(words) + rng.choice(WHITE) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", " ", "\xa0", None]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in model.encode_all(texts)] == want
    part = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
    assert [np.frombuffer(i, "<u4").tolist() for i in model.encode_all(part)] == want
    assert list(model.encode_all([])) == []


def test_words_of_several_batches_are_solved_once(monkeypatch):
    asked = []
    solve = bpe.BpeModel.chunk_ids
    monkeypatch.setattr(bpe.BpeModel, "chunk_ids", lambda self, chunks: asked.extend(chunks) or solve(self, chunks))
    batches = [pa.record_batch([pa.array([k]), pa.array(["same words here"])], names=["doc_id", "text"]) for k in range(20)]
    rows = [r for b in packing._tokeniser(bpe.default_vocabulary(), packing.CAPACITY)(iter(batches)) for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(20)) and len({r["ids_crc32"] for r in rows}) == 1
    assert sorted(asked) == ["here", "same", "words"]
