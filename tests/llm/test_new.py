"""Prefix trie, SimHash components, Merkle manifest and the list ranking below them against brute force; exact scores of large components."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import ann, langid, listrank, merkle, scans, simhash, topk, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# prefix trie


def turn_digest(role, text):
    return hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()


def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, turn_digest(role, text), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(own)] for c, own in convs.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        leaves[s] = sum(leaves[x] for x in children[s]) or 1
        saved[s] = sum(saved[x] for x in children[s]) + (len(members[s]) - 1) * (len(WORD.findall(s[-1][1])) if s else 0)
    out = []
    for s, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(s))
        parent = min(members[s[:-1]]) if s else None
        out.append((min(own), len(s), parent, len(own), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


TALK = "conv_id long, turn long, role string, text string, digest string, depth int"


def talks():
    """Blocks with shared beginnings, one long conversation, copies, negative ids, ties, repeats and nulls."""
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 45), *range(5000, 5025), *range(-43, -18), 7000]:
        for t in range(rng.choice([1, 1, 2, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"w{rng.randrange(2)} x", "clash", 9))
    rows += [(60, t, "user", "long", "", 1) for t in range(150)]
    rows += [(None, 1, "u", "x", "", 1), (80, None, None, None, "", 1), (80, 3, "user", "a b", "", 1), (80, 3, "user", "a b", "", 1), (80, 3, "user", "c", "", 1), (81, None, "user", None, None, None)]
    return rows


@pytest.mark.parametrize(("chunk", "block", "run"), [(1 << 16, None, 4096), (7, 40, 3)])
def test_trie(spark, monkeypatch, chunk, block, run):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "RUN", run)
    monkeypatch.setattr(listrank, "BLOCK", block or 1 << 15)
    rows = talks()
    got = trie.trie(spark.createDataFrame(rows, TALK).repartition(3), block)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_trie([r[:4] for r in rows])
    assert trie.trie(spark.createDataFrame([], TALK)).count() == 0


def test_trie_of_turnless_conversations(spark):
    """A conversation whose turns are all taken from an absent one has none, and still is a member of the root."""
    alone = next(c for c in range(1000, 2000) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(alone, 0, "u", "x"), (alone, 1, "u", "y")]
    got = trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [str(tuple(r)) for r in got] == brute_trie(rows)
    assert len(got) == 1 and got[0].n_leaves == 1 and got[0].parent_conv_id is None


@pytest.mark.parametrize("shuffled", [False, True])
def test_list_ranks(spark, monkeypatch, shuffled):
    """A list in the order of its numbers, and one without any order, which needs the random mates."""
    monkeypatch.setattr(listrank, "BLOCK", 50)
    n = 2000
    order = list(range(n))
    if shuffled:
        random.Random(3).shuffle(order)
    links = spark.createDataFrame(list(zip(order, [*order[1:], None], strict=True)), "arc long, next long").repartition(3)
    got = {r.arc: r.position for r in listrank.ranks(links, 60).collect()}
    assert got == {arc: k for k, arc in enumerate(order)}
    assert listrank.ranks(links.limit(0)).count() == 0


def test_prefix_sums(spark):
    df = spark.createDataFrame([(k * 37 % 101, k % 5) for k in range(101)], "k long, v long").repartition(5)
    got = {r.k: (r.upto, r.place) for r in scans.prefix_sums(df, ["k"], {"upto": F.col("v"), "place": F.lit(1)}).collect()}
    total = 0
    for place, (k, v) in enumerate(sorted((k * 37 % 101, k % 5) for k in range(101))):
        assert got[k] == (total, place)
        total += v
    assert scans.prefix_sums(df.limit(0), ["k"], {"upto": F.col("v")}).count() == 0


# SimHash


def brute_fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(groups):
    """Smallest id of each id's component; ``groups`` are sets of linked ids."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for group in groups:
        for x in group:
            a, b = find(x), find(group[0])
            parent[max(a, b)] = min(a, b)
    return find


def brute_simhash(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    known = np.array(fps, "uint64")
    links = []
    for k, (i, _) in enumerate(rows):
        if i is not None:
            links += [[i, rows[j][0]] for j in np.flatnonzero(np.bitwise_count(known ^ known[k]) <= 2) if rows[j][0] is not None]
    find = joined(links)
    return sorted(str((i, f"{f:016x}", None if i is None else find(i))) for (i, _), f in zip(rows, fps, strict=True))


def texts():
    """Many variants of one text (a dense group), unlike texts, copies, nulls, one long text."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    base = rng.choices(words, k=150)
    rows = []
    for k in range(500):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(99)}"
        rows.append((k, " ".join(own)))
    rows += [(600 + k, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40])))) for k in range(150)]
    rows += [(800, None), (801, ""), (802, " \n"), (803, "ONE two"), (804, "one TWO"), (805, "é" * 30), (806, "Ünï çödé 中文 " * 40), (None, "a b"), (None, None), (7, "other text"), (807, rows[3][1]), (3, rows[3][1])]
    return [*rows, (808, "long word " * 40_000)]


@pytest.mark.parametrize("sizes", [{}, {"sample": 64, "shard": 16, "small": 4}])
def test_simhash(spark, sizes):
    rows = texts()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string").repartition(4)
    got = sorted(str(tuple(r)) for r in simhash.near_duplicates(df, **sizes).collect())
    assert got == brute_simhash(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_fingerprints_in_stretches():
    rng = random.Random(2)
    text = "  ".join("".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(400)) + "\n"
    assert {simhash.fingerprint(text, stretch=s) for s in (1, 7, 50, 1 << 20)} == {int(np.array(brute_fingerprint(text), "uint64").view("int64"))}
    for short in ("", "a", "a b", "a b c"):
        assert {simhash.fingerprint(short, stretch=s) % 2**64 for s in (1, 2, 99)} == {brute_fingerprint(short)}


def test_vantage_point_trees_lose_no_link():
    """Random fingerprints and neighbours of them: all pairs within two bits meet in a shard, and are found in it."""
    rng = np.random.default_rng(1)
    near = rng.integers(0, 2**63, 3000, dtype="uint64")
    for _ in range(2):
        near = near ^ (np.uint64(1) << rng.integers(0, 64, len(near), dtype="uint64"))
    fps = np.unique(np.concatenate([near, near ^ np.uint64(3), near[:500] ^ np.uint64(1 << 40), np.arange(256, dtype="uint64")]))
    tree = simhash.fit(rng.choice(fps, 400, replace=False), 12)
    assert len(tree.point) > 10
    leaf, row = tree.leaves(fps)
    shards = defaultdict(set)
    for a, b in zip(leaf, row, strict=True):
        shards[b].add(a)
    found = set()
    for k in range(leaf.max() + 1):
        rows = row[leaf == k]
        for a, b in simhash.shard_links(fps[rows], 8):
            found |= {(min(x, y), max(x, y)) for x, y in zip(rows[a].tolist(), rows[b].tolist(), strict=True)}
    want = {(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 2) + i + 1}
    assert found == want
    assert all(shards[a] & shards[b] for a, b in want)
    assert len(leaf) < 6 * len(fps)


# Merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows):
    def leaf(row, low=False):
        values = [row[0], row[1], row[2], row[3], lowered(row[4]) if low and row[4] is not None else row[4]]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def climb(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def segments(levels, at):
        out = []
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            out.append((run[: at % 8], run[at % 8 + 1 :]))
            at //= 8
        return out

    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    own = {n: sorted(groups[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names}
    trees = {n: climb([leaf(r) for r in own[n]]) for n in names}
    top = climb([trees[n][-1][0] for n in names])
    out = []
    for g, n in enumerate(names):
        for k, row in enumerate(own[n]):
            path = segments(trees[n], k) + segments(top, g)
            at = leaf(row, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0)
            for left, right in path:
                at = h(*left, at, *right)
            out.append((row[0], trees[n][0][k], trees[n][-1][0], top[-1][0], h(*[x for left, right in path for x in (*left, *right)]), at, at == top[-1][0]))
    return sorted(map(str, out))


DOC = "doc_id long, source string, lang string, n_chars long, text string, leaf string, rank string"


def leaves():
    """Languages of 1 to 150 documents, more than eight of them, with nulls everywhere and repeated rows."""
    rng = random.Random(6)
    rows = []
    for lang, n in [("en", 150), ("es", 64), ("de", 9), ("fr", 8), ("it", 1), (None, 3), ("é", 2), ("", 2), ("z", 65), ("a", 1)]:
        for _ in range(n):
            k = len(rows)
            rows.append((k * 7 % 1000 - 20, rng.choice(["s", None, "ü"]), lang, rng.choice([None, k]), rng.choice([None, "", f"Text {k}", f"lower {k}", "É Ab"])))
    return [*rows, (None, None, None, None, None), (None, "s", "en", 1, "AB"), rows[0], rows[0], rows[160], (5, "s", "en", 1, "X" * 100_000)]


def test_merkle(spark):
    rows = leaves()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOC).repartition(3)
    got = merkle.verify(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_merkle(rows)
    assert merkle.verify(df.limit(0)).count() == 0
    one = rows[:1]
    assert [str(tuple(r)) for r in merkle.verify(spark.createDataFrame([(*r, "", "") for r in one], DOC)).collect()] == brute_merkle(one)


def test_some_requests_prove_what_all_prove(spark):
    df = spark.createDataFrame([(*r, "", "") for r in leaves()], DOC)
    manifest = merkle.manifest_of(df)
    key = lambda p: sorted((r.grp, r.rank, bytes(r.root).hex(), str(r.path)) for r in p.collect())
    asked = manifest.rows.filter("rank % 29 = 3")
    some = key(merkle.prove(manifest, asked))
    assert some == key(merkle.prove(manifest).filter("rank % 29 = 3")) and len(some) > 5
    dag = {bytes(r.digest).hex(): [bytes(x).hex() for x in r.children] for r in manifest.records().collect()}
    assert all(h(*children) == digest for digest, children in dag.items())


# exact scores, and neighbours in several blocks


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)


def brute_top(vectors, every=50, k=5):
    ints = [[math.floor(256 * float(x)) for x in v] for v in vectors]
    out = []
    for q in range(0, len(ints), every):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in range(len(ints)) if c != q)
        out += [(q, place, c, -s) for place, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_scores_near_2_to_the_62_are_exact(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(1e6, 3e5, (120, 16))
    vectors[60:] *= -1  # negative scores too
    assert sorted(tuple(r) for r in topk.search(embeddings(spark, vectors)).collect()) == brute_top(vectors)
    far = -np.abs(rng.normal(1e6, 1e4, (4, 16)))
    mixed = np.concatenate([np.abs(vectors[:1]), far])  # the only candidates of the query score far below zero
    assert sorted(tuple(r) for r in topk.search(embeddings(spark, mixed)).collect()) == brute_top(mixed)


def test_scores_beyond_64_bits_are_an_error(spark):
    for x in (1e8, 1e300):
        with pytest.raises(ValueError, match="64 bits"):
            topk.search(embeddings(spark, [[x] * 16] * 3))


def test_several_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(0, 2, (400, 8)), 1)
    vectors[100:120] = vectors[5]
    for module in (topk, ann):
        monkeypatch.setattr(module, "QUERY_BLOCK", 7)
        monkeypatch.setattr(module, "CANDIDATE_BLOCK", 60)
    df = embeddings(spark, vectors)
    assert sorted(tuple(r) for r in topk.search(df, every=5).collect()) == brute_top(vectors, every=5)
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, every=5).collect())
    size = np.sqrt((vectors * vectors).sum(axis=1))
    want = []
    for q in range(0, 400, 5):
        if size[q]:
            score = ann.cosines(np.repeat(vectors[q : q + 1], 400, axis=0)[size > 0], vectors[size > 0])
            order = sorted((-s, c) for s, c in zip(score, np.flatnonzero(size > 0).tolist(), strict=True) if c != q)
            want += [(q, place, c) for place, (_, c) in enumerate(order[:5], 1)]
    assert got == sorted(want)


def test_a_batch_scores_each_text_as_alone():
    rng = np.random.default_rng(8)
    table = np.log(rng.random((2 * langid.BUCKETS, 5))).astype("float32")
    many = ["über alles " * n for n in (1, 3, 900, 2000)] + ["", "x", "plain text 3"]
    for most in (1, 50, 1 << 16):
        got = langid.batch_likelihoods(many, table, most)
        assert all((row == langid.text_likelihoods(t, table)).all() for row, t in zip(got, many, strict=True))
    at, n = langid.sparse_counts(many[1])
    assert np.allclose(langid.text_likelihoods(many[1], table), (n[:, None] * table[at].astype("float64")).sum(axis=0))
