"""The ten operators against brute force, the library or held-out accuracy on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import ann, bpe, langid, neardup, packing, quality, sharding, suffixes, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


def documents(seed=3, n=60):
    """Texts with copies, near copies, shared passages, odd characters, nulls, empties and a clashing column."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.choice([3, 40, 90, 300]))) for _ in range(n)]
    passage = " ".join(rng.choices(words, k=70))
    texts += [texts[2], texts[5], texts[5], texts[7] + " " + passage, passage + " " + texts[9], "so " * 400]
    base = rng.choices(words, k=200)
    for k in range(12):
        near = list(base)
        near[(k * 17) % 200] = "changed"
        texts.append(" ".join(near))
    texts += [None, "", "   ", "word", "Ünï çödé 中文 " * 40, "é" * 500, "x" * 20000]
    return [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_vocabulary())
    model = bpe.model(bpe.default_vocabulary())
    rng = random.Random(1)
    alphabet = [chr(c) for c in range(0x250)] + list("ΣσςßÅ😀中ｂ　​ǅ") + ["<|endoftext|>", "'s", "'LL", " the ", "in"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 25)))
        want = lib.encode(text, add_special_tokens=False).ids
        ids, words = model.encode_and_decode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want and words == lib.decode(want, skip_special_tokens=False)
        assert model.decode(ids) == words and model.encode(text) == ids
    for r in bpe.digests(docs).collect():
        text = dict((d[0], d[1]) for d in documents())[r.doc_id] or ""
        ids = lib.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.digests(empty(spark)).count() == 0
    assert set(bpe.encode(docs).columns) == {*docs.columns, "token_ids", "decoded"}


def test_packing(spark, docs):
    rows = packing.pack(packing.pieces_of(docs, capacity=256), 256).collect()
    model, bins, pieces = bpe.model(bpe.default_vocabulary()), defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 256
    for i, text, *_ in documents():
        ids = model.encode(text) + np.array([1], "<u4").tobytes()
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == [(k, 256 * k) for k in range(-(-len(ids) // 1024))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[k : k + 1024]) for k in range(0, len(ids), 1024)]
    assert len(bins) <= 1.1 * sum(r.length for r in rows) / 256
    assert packing.pack(packing.pieces_of(empty(spark))).count() == 0


def test_sharding(spark, docs):
    rows = sharding.shard(docs).collect()
    texts = {d[0]: (d[1] or "").encode() for d in documents()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in rows)
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[k] for k in range(24)) <= 1
    for k, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n))
    for n in (1, 2, 3, 100, 1025):
        image = sharding.permute(np.arange(n), n)
        assert sorted(image) == list(range(n)) and (sharding.unpermute(image, n) == np.arange(n)).all()
    assert [tuple(r) for r in sorted(rows)] == [tuple(r) for r in sorted(sharding.shard(docs.repartition(7)).collect())]
    assert sharding.shard(empty(spark)).count() == 0


def test_suffixes(spark, docs):
    data = {d[0]: (d[1] or "").encode() for d in documents()}
    count = Counter(b[i : i + 200] for b in data.values() for i in range(len(b) - 199))
    for r in suffixes.digests(docs).collect():
        body = data[r.doc_id]
        gone = bytearray(len(body))
        for s in range(len(body) - 199):
            if count[body[s : s + 200]] > 1:
                gone[s : s + 200] = b"\x01" * 200
        kept = bytes(x for x, g in zip(body, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert suffixes.digests(empty(spark)).count() == 0
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_suffixes_of_hot_anchors(spark, docs, monkeypatch):
    want = sorted(suffixes.digests(docs).collect())
    monkeypatch.setattr(suffixes, "HOT", 1)
    assert sorted(suffixes.digests(docs).collect()) == want


def test_suffixes_in_stretches_and_small_shards(spark, docs, monkeypatch):
    """Long texts in overlapping stretches, and many shards a task, give the same result; columns keep their values."""
    from ledgerloom.llm import textbytes

    want = sorted(suffixes.digests(docs).collect())
    monkeypatch.setattr(textbytes, "SLICE_BYTES", 700)
    monkeypatch.setattr(suffixes, "SHARD_BYTES", 900)
    monkeypatch.setattr(suffixes, "TASK_BYTES", 4_000)
    assert sorted(suffixes.digests(docs).collect()) == want
    wide = docs.withColumn("runs", docs.doc_id * 2)
    cut = {r.doc_id: r for r in suffixes.cut_repeats(wide).collect()}
    assert cut.keys() == {d[0] for d in documents()} and all(r.digest == "clash" and r.runs == 2 * i for i, r in cut.items())
    kept = {r.doc_id: r.kept_sha256 for r in want}
    for i, r in cut.items():
        if (r.text or "").isascii():
            assert hashlib.sha256((r.text or "").encode()).hexdigest() == kept[i] and r.n_chars == len(r.text or "")


def test_suffixes_of_null_and_repeated_ids(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    a, b, c = text(500), text(260), text(230)
    rows = [(1, a), (1, a), (2, b), (2, c + b[:210]), (None, c), (None, None), (None, c), (3, text(600))]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 500, 500), (1, 500, 500), (2, 260, 210), (2, 440, 440), (0, 230, 230), (0, 230, 230), (0, 0, 0), (3, 600, 0)])


def brute_components(texts, width):
    sets = {i: neardup.shingle_set(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("limits", [{}, {"BIG_NODE": 4, "BIG_CLUSTER": 5, "SMALL_NODE": 3}])
def test_near_duplicates(spark, docs, monkeypatch, limits):
    for name, limit in limits.items():
        monkeypatch.setattr(neardup, name, limit)
    texts = {d[0]: d[1] for d in documents()}
    want = brute_components(texts, 2)
    rows = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_of_large_nodes_are_split_independently(spark, monkeypatch):
    """Pairs of similarity 0.80 to 0.85 whose roots are large in every tree; no two pairs are alike."""
    monkeypatch.setattr(neardup, "BIG_NODE", 100)
    rng = np.random.default_rng(4)
    pairs, rows = 600, []
    for k in range(pairs):
        one = rng.integers(0, 256, neardup.COORDINATES, dtype="uint8")
        two = one.copy()
        two[rng.choice(neardup.COORDINATES, int(rng.integers(19, 26)), replace=False)] += np.uint8(1)
        rows += [(2 * k, bytearray(one), list(range(neardup.TREES))), (2 * k + 1, bytearray(two), list(range(neardup.TREES)))]
    items = spark.createDataFrame(rows, "item long, sketch binary, keys array<long>")
    cluster = {r.item: r.cluster for r in neardup.candidate_clusters(items).collect()}
    missed = [k for k in range(pairs) if 2 * k not in cluster or cluster[2 * k] != cluster.get(2 * k + 1)]
    assert missed == []


def test_items_of_one_template_do_not_become_one_cluster(spark, monkeypatch):
    """Sketches that share 45 % of their bytes, one node in all trees, with planted groups: clusters are the groups, in several tiles of cores."""
    for name, limit in {"BIG_NODE": 200, "TILE": 16}.items():
        monkeypatch.setattr(neardup, name, limit)
    rng = np.random.default_rng(9)
    template, own = rng.integers(0, 256, neardup.COORDINATES, dtype="uint8"), np.arange(58, neardup.COORDINATES)
    groups, rows = [1] * 1200 + [2] * 60 + [80, 40], []
    for g, size in enumerate(groups):
        first = template.copy()
        first[own] = rng.integers(0, 256, len(own), dtype="uint8")
        for k in range(size):
            one = first.copy()
            one[rng.choice(own, 12 if k else 0, replace=False)] += np.uint8(1 + k)  # two of a group differ in at most 24 bytes
            rows.append((g, bytearray(one), list(range(neardup.TREES))))
    items = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "item long, sketch binary, keys array<long>")
    cluster = {r.item: r.cluster for r in neardup.candidate_clusters(items).collect()}
    of_group = {}
    for k, (g, *_) in enumerate(rows):
        of_group.setdefault(g, set()).add(cluster.get(k, -1 - k))
    assert all(len(found) == 1 for found in of_group.values())
    assert len({min(found) for found in of_group.values()}) == len(groups)


def test_bridges_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (5, neardup.COORDINATES), dtype="uint8")
    for n, m in ((0, 4), (4, 0), (3, 40), (40, 3), (30, 30)):
        sets = [base[rng.integers(0, 5, k)] for k in (n, m)]
        for s in sets:
            s[rng.random(s.shape) < 0.22] += 1
        want = [j for j in range(m) if any(np.count_nonzero(c == sets[1][j]) / neardup.COORDINATES >= neardup.LINK for c in sets[0])]
        assert sorted(neardup.bridged(*sets)) == want


def test_words_of_a_long_text_in_stretches(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choices("abC \t\n\u00a0\u00e9", k=3000)) + " " + "x" * 200
    whole = neardup.shingle_set(text, 3)
    for stretch in (1, 7, 64):
        monkeypatch.setattr(neardup, "STRETCH", stretch)
        assert (neardup.shingle_set(text, 3) == whole).all()


def test_words_and_lines_of_a_long_text_are_counted_in_stretches(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices(["a", "b", " ", "\n", "\u2003", "\n\n"], k=n)) for n in (0, 3, 40, 400, 400)] + ["one line\n" * 50, "x" * 300]
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    want = [2 if len(x) < 4 else int(len(set(x)) >= 0.4 * len(x)) for x in lines]
    words = [t.split() for t in texts]
    share = [sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w) if len(w) > 3 else 0 for w in words]
    for stretch in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(quality, "STRETCH", stretch)
        assert [quality._line_vote(t) for t in texts] == want
        assert quality.repeat_share(texts).tolist() == share


def test_quality_and_language_keep_clean(spark):
    rng = random.Random(5)
    en, de = ["the", "and", "of", "with", "there", "house", "walking"], ["der", "und", "nicht", "über", "haus", "gehen", "schön"]
    rows = []
    for i in range(300):
        words = rng.choices(de if i % 3 == 0 else en, k=60)
        kind = i % 10
        text = " ".join(w + "." if k % 9 == 8 else w for k, w in enumerate(words))
        if kind == 1:
            text = " ".join(w.upper() + "!!" for w in words)
        if kind == 2:
            text = " ".join(w + rng.choice(["$$$", "%%%"]) for w in words)
        if kind == 3:
            text = "same " * 60
        rows.append((i, text, "de" if i % 3 == 0 else "en", "s", len(text), "x"))
    rows += [(900, None, None, None, None, None), (901, "", None, None, None, None), (902, "12 34", "en", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    keep = {r.doc_id: r.keep for r in quality.score(df).collect()}
    assert not keep[900] and not keep[901]
    good = [i for i in range(300) if i % 10 not in (1, 2, 3)]
    assert all(keep[i] for i in good) and sum(keep[i] for i in range(300) if i not in good) <= 3
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {i for i, k in keep.items() if k}
    found = {r.doc_id: r for r in langid.identify(df).collect()}
    assert found[900].lang_pred == found[901].lang_pred == found[902].lang_pred == "und"
    assert all(found[i].lang_pred == ("de" if i % 3 == 0 else "en") for i in good)
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    assert langid.identify(empty(spark)).count() == 0 and quality.score(empty(spark)).count() == 0
    assert langid.keep_identified(df).columns == df.columns


def test_quality_learns_from_texts_beside_nulls_and_copies(spark, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(50)]
    texts = {" ".join(rng.choices(words, k=12)) for _ in range(300)}
    rows = [(t,) for t in texts] + [(None,)] * 20_000 + [("  \n",)] * 5_000 + [("a hot copied text of some words",)] * 10_000
    df = spark.createDataFrame(rows, "text string").repartition(3)
    fitted = []
    monkeypatch.setattr(quality, "fit", lambda *given: fitted.append(given) or (np.zeros(quality.FEATURES), 0.0))
    quality.train(df, rows=100)
    quality.train(df, rows=1_000)
    assert all((x[:, : quality.HASHED].sum(axis=1) > 0).all() for x, *_ in fitted)  # nothing without ink
    (some, _, weight), (every, _, counts) = fitted
    assert len(some) == 100 and np.isclose(weight.max(), 10_000) and 200 < weight.sum() - weight.max() < 450
    assert len(every) == 301 and counts.sum() == 10_300


def test_searches(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(230, 9)).astype("float32")
    v[7] = v[50]
    v[9] = 0
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(500, None, 1), (501, [1.0, float("nan")], 1), (None, [1.0] * 9, 1), (600, [1.0, 2.0], 1), (602, [2.0, 1.0], 1), (3, [float(x) for x in v[3]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = np.floor(v.astype("float64") * 256)
    found = defaultdict(list)
    for r in sorted(topk.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 230, 50):
        s = whole @ whole[q]
        order = sorted((i for i in [*range(230), 3] if i != q), key=lambda i: (-s[i], i))[:5]
        assert found.pop(q) == [(i, int(s[i])) for i in order]
    assert dict(found) == {600: [(602, 512 * 256 + 256 * 512)]}
    near = ann.nearest(df).collect()
    d = v.astype("float64")
    size = np.sqrt((d * d).sum(axis=1))
    for q in (50, 100):
        cos = {i: d[i] @ d[q] / (size[i] * size[q]) for i in range(230) if i not in (q, 9)}
        order = sorted([*cos, 3], key=lambda i: (-round(cos[i], 12), i))[:5]
        assert [g.vec_id for g in sorted((r for r in near if r.query_id == q), key=lambda r: r.rank)] == order
    assert [(r.query_id, r.vec_id) for r in near if r.query_id == 600] == [(600, 602)]
    assert ann.nearest(df.limit(0)).count() == 0 and topk.search(df.limit(0)).count() == 0


def test_cosines_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e200, 2e200, 0.0]), (1, [1e-200, 2e-200, 1e-201]), (2, [3.0, -1.0, 2.0]), (3, [1e200, 2e200, 0.0]), (4, [5e-324, 0.0, 0.0])]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert [g[2] for g in got] == [3, 1, 4, 2] and got[0][3] == 1 or abs(got[0][3] - 1) < 1e-15
    assert all(np.isfinite(g[3]) for g in got)
    a, b = np.random.default_rng(5).normal(size=(2, 40, 7))
    direct = [sum(x * y for x, y in zip(p, q, strict=True)) / (np.sqrt(sum(x * x for x in p)) * np.sqrt(sum(y * y for y in q))) for p, q in zip(a, b, strict=True)]
    assert ann.cosines(a, b).tolist() == direct


def test_warc(spark, tmp_path):
    big = "<p>é\r\n\r\nWARC/1.1</p>" * 20
    rows = [(5, "http://a b", big), (2, None, big), (9, "u", "small"), (1, "u", "small"), (7, "u", None), (2, "again", big), (None, "n", big), (8, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df, str(tmp_path / "w")).collect()), key=str)
    n = len(big.encode())
    assert got == sorted([(5, n, "revisit", 2), (2, n, "response", None), (2, n, "response", None), (None, n, "revisit", 2), (9, 5, "response", None), (1, 5, "response", None), (7, 0, "response", None), (8, 0, "response", None)], key=str)
    payloads = {r.page_id: r.payload for r in warc.read_archives(spark, str(tmp_path / "w")).collect() if r.record_type == "response"}
    assert payloads[2] == big and payloads[7] == ""
    assert warc.round_trip(df.limit(0)).count() == 0


def test_equal_texts_get_equal_scores_wherever_they_are(spark, monkeypatch):
    """Copies at every place of a batch, in short and in long slices, in stretches or whole."""
    import pyarrow as pa

    from ledgerloom.llm import textbytes

    rng = random.Random(8)
    copy = "Das Haus ist schön, and the end of it is near."
    others = [" ".join(rng.choices(["the", "und", "house", "Weg", "!!", "7"], k=rng.randint(0, 40))) for _ in range(40)]
    texts = [copy, *others[:7], copy, copy, None, *others[7:], "", copy]
    w = np.random.default_rng(1).normal(size=quality.FEATURES)
    want = None
    for size in (17, 64, 301, 400_000):
        monkeypatch.setattr(textbytes, "SLICE_BYTES", size)
        s = quality.batch_scores(pa.array(texts, pa.string()), w, 0.3)
        assert len({s[k] for k, t in enumerate(texts) if t == copy}) == 1
        assert want is None or (s == want).all()
        want = s
    counts, _ = quality.text_counts(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert counts[k].tolist() == np.bincount(quality.CLASS_OF[list((text or "").encode())], minlength=quality.CLASSES).tolist()
    table = np.log(np.random.default_rng(2).random((2 * langid.BUCKETS, 3))).astype("float32")
    found = [langid.text_likelihoods(t, table) for t in (copy, copy[:9] + copy[9:])]
    assert (found[0] == found[1]).all()
    whole = langid.sparse_counts("über alles " * 300)
    monkeypatch.setattr(langid, "STRETCH", 13)
    assert all((a == b).all() for a, b in zip(whole, langid.sparse_counts("über alles " * 300), strict=True))


@pytest.mark.parametrize("block", [32, 2])
def test_language_equals_naive_bayes_by_hand(spark, monkeypatch, block):
    """Probabilities of every row against counts in plain Python, with several blocks of languages."""
    monkeypatch.setattr(langid, "LANGUAGES", block)
    rng = random.Random(9)
    alphabets = {"a": "abcde ", "b": "bcdef ", "c": "héllo ", "d": "жзик ", "e": "cdefg "}
    rows = [(i, "".join(rng.choices(alphabets["abcde"[i % 5]], k=rng.randint(1, 30))), "abcde"[i % 5]) for i in range(150)]
    rows += [(200, None, "a"), (201, "12 3", "b"), (None, "abc de", "a"), (3, rows[3][1], rows[3][2]), (203, "abc", None)]
    grams = lambda t: [g for p in langid.gram_buckets(t) for g in p.tolist()]
    learned = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = {lang: Counter(g for _, t, own in learned if own == lang for g in grams(t)) for lang in alphabets}
    size = {(lang, part): sum(n for g, n in c.items() if (g >= langid.BUCKETS) == part) + langid.SMOOTH * langid.BUCKETS for lang, c in counts.items() for part in (False, True)}
    got = {(r.doc_id, k): r for k, r in enumerate(langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)).collect())}
    for k, (i, text, _) in enumerate(rows):
        r = got[i, k]
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        if text is None or not any(x.isalpha() for x in text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        log = {lang: sum(np.log((c[g] + langid.SMOOTH) / size[lang, g >= langid.BUCKETS]) for g in grams(text)) for lang, c in counts.items()}
        best = max(sorted(log), key=log.get)
        assert abs(r.score - 1 / sum(np.exp(v - log[best]) for v in log.values())) < 1e-4
        assert r.lang_pred == best or abs(log[best] - log[r.lang_pred]) < 1e-4


def test_quality_equals_expectation_maximisation_and_scores_by_hand(spark):
    """The counted patterns against one row a document, and scores against loops over bytes."""
    rng = np.random.default_rng(3)
    patterns = rng.choice(3 ** len(quality.LABELLERS), 6)
    n = rng.integers(1, 9, 6)
    good, accuracy, share = quality.expectation_maximisation(patterns, n)
    rows = np.repeat(patterns, n)
    good_rows, accuracy_rows, share_rows = quality.expectation_maximisation(rows, np.ones(len(rows), "int64"))
    assert np.allclose(np.repeat(good, n), good_rows) and np.allclose(accuracy, accuracy_rows) and np.isclose(share, share_rows)
    votes = patterns[:, None] // 3 ** np.arange(len(quality.LABELLERS)) % 3
    assert all(good[k] > 0.5 for k in range(6) if not (votes[k] == 0).any()) or share < 0.5

    texts = ["The end. Of the END!", "", None, "  \n", "aé|b " * 30, "so so so so so"]
    w, b = rng.normal(size=quality.FEATURES), 0.2
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.score(df, (w, b, None)).collect():
        body = (texts[r.doc_id] or "").encode()
        if not body.strip():
            assert r.score == 0 and not r.keep
            continue
        classes = [int(quality.CLASS_OF[x]) for x in b"\n\n" + body + b"\n\n"]
        grams = Counter(((x * 32 + y) * 32 + z) * 2654435761 % 2**32 >> 22 for x, y, z in zip(classes, classes[1:], classes[2:], strict=False))
        total = sum(grams.values())
        value = b + sum(w[g] * np.sqrt(c / total) * total / (total + quality.PRIOR_GRAMS) for g, c in grams.items())
        words = (texts[r.doc_id] or "").split()
        repeated = sum(x == y for x, y in zip(words, words[1:], strict=False)) / len(words) if len(words) > 3 else 0
        value += 0.5 * w[quality.HASHED + min(int(repeated * 2 * quality.REPEATS), quality.REPEATS - 1)]
        assert abs(r.score - 1 / (1 + np.exp(-value))) < 1e-5 and r.keep == (r.score >= quality.REJECT_BELOW)


def test_near_duplicates_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    a, b, c = (" ".join(rng.choices(words, k=60)) for _ in range(3))
    rows = [(7, a), (3, a), (7, b), (9, b), (9, b), (5, c), (None, c), (None, None), (11, None), (12, " "), (4, c)]
    got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id", "kept").collect() if r.doc_id)
    assert got == sorted([(7, 3, False), (3, 3, True), (7, 3, False), (9, 3, False), (9, 3, False), (5, 4, False), (4, 4, True), (11, 11, True), (12, 12, True)])
    wide = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    assert sorted(str(tuple(r)) for r in neardup.keep_one(wide, 2).collect()) == sorted(str((*r, "x")) for r in rows if r[0] in (3, 4, 11, 12, None))


def test_near_duplicates_at_the_threshold_are_found(spark):
    """Pairs of similarity 0.80 to 0.85 by full sets, among other texts: all are linked, and nothing else is."""
    rng = np.random.default_rng(13)
    word = iter(range(10**9))
    rows, pairs = [], []
    for k in range(300):
        one = [f"w{next(word)}" for _ in range(int(rng.integers(120, 400)))]
        two = list(one)
        changed = int(len(one) * rng.uniform(0.083, 0.11))  # an end of the text: one shingle goes and comes a word
        two[len(two) - changed :] = [f"w{next(word)}" for _ in range(changed)]
        s, t = neardup.shingle_set(" ".join(one)), neardup.shingle_set(" ".join(two))
        both = len(np.intersect1d(s, t))
        if 80 <= 100 * both / (len(s) + len(t) - both) <= 85:
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    assert len(pairs) > 100
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[b] == a for a, b in pairs)
    want = brute_pairs = {b for a, b in zip(range(0, 600, 2), range(1, 600, 2), strict=True) if found[b] == a}
    texts = dict(rows)
    for b in brute_pairs:
        s, t = neardup.shingle_set(texts[b - 1]), neardup.shingle_set(texts[b])
        both = len(np.intersect1d(s, t))
        assert 100 * both >= 80 * (len(s) + len(t) - both)
    assert all(found[i] == i for i in texts if i not in want)


def test_warc_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 4_000)
    monkeypatch.setattr(warc, "SIZE_CLASSES", (200, 1_000, 4_000))
    rows = [(i, "u", f"{i} " + "x" * n) for i, n in enumerate([50] * 90 + [700] * 9 + [3_000] * 3 + [9_000])] + [(500, "u", "3 " + "x" * 50), (501, "u", "102 " + "x" * 9_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df, str(tmp_path / "w")).collect()}
    assert got == {i: (len(h), "revisit" if i == 501 else "response", 102 if i == 501 else None) for i, _, h in rows}
    sizes = [sum(len(p) for _, p in warc.parse(zlib.decompress(f.read_bytes(), 47))) for f in (tmp_path / "w").rglob("*.gz")]
    assert all(n <= 4_000 or n > 9_000 and n < 9_010 for n in sizes) and len(sizes) > 7


def test_null_ids_repeated_rows_and_ties(spark):
    """Packing, sharding, quality, language and BPE on rows without id, rows twice and equal lengths."""
    rows = [(None, "one two three"), (1, "one two three"), (1, "one two three"), (1, "three two one"), (2, None), (2, ""), (None, None), (3, "x " * 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, end = bpe.model(bpe.default_vocabulary()), np.array([1], "<u4").tobytes()
    packed = packing.pack(packing.pieces_of(df, capacity=64), 64).collect()
    want = Counter()
    for i, text in rows:
        ids = model.encode(text) + end
        for k in range(0, len(ids), 256):
            want[i, k // 256, k // 4, len(ids[k : k + 256]) // 4, zlib.crc32(ids[k : k + 256])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for placed in bins.values():
        assert [o for o, _ in sorted(placed)] == np.cumsum([0, *[n for _, n in sorted(placed)]])[:-1].tolist() and sum(n for _, n in placed) <= 64
    dealt = sharding.shard(df, shards=3).collect()
    assert Counter((r.doc_id, r.size) for r in dealt) == Counter((i, len(t or "") + 8) for i, t in rows)
    assert sorted((r.shard, r.slot) for r in dealt) == sorted((p % 3, p // 3) for p in range(len(rows)))
    assert Counter((r.doc_id, r.n_tokens) for r in bpe.digests(df).collect()) == Counter((i, len(model.encode(t)) // 4) for i, t in rows)
    scores = defaultdict(set)
    for r in quality.score(df.withColumn("score", df.doc_id)).collect():
        scores[r.doc_id].add(r.score)
    assert len(scores[1]) <= 2 and scores[2] == {0.0} and scores[None] == {0.0, max(scores[None])}
    learned = spark.createDataFrame([(k, t, lang) for k in range(40) for t, lang in (("one two", "a"), ("one two", "b"))], "doc_id long, text string, lang string")
    found = langid.identify(learned).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("a", 0.5)}  # equal likelihoods: the language that sorts first


def test_filters_and_cuts_of_empty_tables(spark):
    for keep in (quality.keep_good, langid.keep_identified, neardup.keep_one, suffixes.cut_repeats):
        out = keep(empty(spark))
        assert out.count() == 0 and out.columns == [c.split()[0] for c in DOCS.split(", ")]
