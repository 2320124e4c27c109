"""The pipeline's stages on a small table with nulls, empties, repeats, long texts and clashing columns."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import bpe, neardup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string, runs long, key binary"


def rows():
    rng = random.Random(21)
    words = {"en": ["the", "and", "house", "walk", "green", "water", "often", "three"], "de": ["der", "und", "haus", "gehen", "wasser", "nicht", "schön", "drei"]}
    texts = []
    for i in range(120):
        lang = "de" if i % 3 == 0 else "en"
        own = [f"{rng.choice(words[lang])}{rng.choice(['', 's', 'er', 'ing', 'lich'])}{'.' if k % 9 == 8 else ''}" for k in range(rng.randint(30, 160))]
        texts.append((" ".join(own), lang))
    passage = " ".join(rng.choices(words["en"], k=70))
    texts += [(texts[4][0], "en"), (texts[5][0], "en"), (texts[7][0] + " " + passage + " after it.", "en"), ("Before it " + passage + " " + texts[10][0], "en")]
    near = texts[8][0].split(" ")
    near[len(near) // 2] = "changed"
    texts += [(" ".join(near), "en"), (None, "en"), ("", None), ("  \n ", "en"), ("$$$ %%% " * 60, "en"), ("12 34 56 7890 " * 30, "en"), (" ".join(rng.choices(words["en"], k=9000)) + ".", "en")]
    out = [(i, t, lang, "s", len(t or ""), f"d{i}", 7 * i, bytearray(b"k")) for i, (t, lang) in enumerate(texts)]
    return [*out, out[20], (None, texts[30][0] + " But with another end of its own.", "en", None, None, None, None, None)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows(), COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, folder)
        found.write.parquet(f"{folder}/{k}.parquet")
        out[name] = (docs.collect(), found.columns, (after := spark.read.parquet(f"{folder}/{k}.parquet")).collect())
        docs = after
    return out


def plain(rs):
    return Counter(str(tuple(r)) for r in rs)


def test_filters_keep_clean_rows_whole(stages):
    for name in ("quality classifier", "language ID", "near-duplicates"):
        before, columns, after = stages[name]
        assert columns == [c.split()[0] for c in COLUMNS.split(", ")]
        assert not plain(after) - plain(before)
    before, _, after = stages["quality classifier"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {r.doc_id for r in before if not (r.text or "").strip() or "$$$" in r.text} <= gone and not gone & set(range(120))
    assert Counter(r.doc_id for r in after)[20] == 2
    before, _, after = stages["language ID"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} <= {r.doc_id for r in before if not any(x.isalpha() for x in r.text)}


def test_one_of_each_group_stays(stages):
    before, _, after = stages["near-duplicates"]
    sets = {r.doc_id: neardup.shingle_set(r.text, 5) for r in before if r.doc_id is not None}
    parent = {i: i for i in sets}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in sets:
        for b in sets:
            both = len(np.intersect1d(sets[a], sets[b])) if a < b else 0
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if r.doc_id is None or root(r.doc_id) == r.doc_id)


def test_passages_are_cut_and_columns_stay(stages):
    before, columns, after = stages["suffix dedup"]
    assert columns == [c.split()[0] for c in COLUMNS.split(", ")]
    data = [r.text.encode() for r in before]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = []
    for r, body in zip(before, data, strict=True):
        gone = bytearray(len(body))
        for s in range(len(body) - 199):
            if count[body[s : s + 200]] > 1:
                gone[s : s + 200] = b"\x01" * 200
        text = bytes(x for x, g in zip(body, gone, strict=True) if not g).decode("utf-8", "ignore")
        want.append((r.doc_id, text, r.lang, r.source, len(text), r.digest, r.runs, r.key))
    assert Counter(map(str, want)) == plain(after)
    assert any(len(r.text) < len(b.text) for r in after for b in before if r.doc_id == b.doc_id)


def test_everything_kept_is_packed(stages):
    before, _, after = stages["packing"]
    model, bins = bpe.model(bpe.default_vocabulary()), defaultdict(list)
    want = Counter((r.doc_id, len(model.encode(r.text)) // 4 + 1) for r in before)
    got = defaultdict(int)
    for r in after:
        bins[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id] += r.length
    assert dict(got) == {i: sum(n * k for (j, n), k in want.items() if j == i) for i, _ in want}
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
