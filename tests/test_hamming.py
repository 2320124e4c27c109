"""Hashes whose bands do not part them: every third bit is set at most, as in thermometer codes."""

import random

import pytest

from ledgerloom.operators import hamming as hm
from ledgerloom.operators.assembly import components


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(hm, "TILE", 64)


def values(n, seed=5):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        levels = [rng.choice([0, 0, 0, 1, 2]) for _ in range(20)]
        out.append(tuple(sum(1 << 3 * i for i, x in enumerate(levels) if x > t) for t in (0, 1)))
    return out + out[:5]


def distance(x, y):
    return sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True))


def test_bands_that_part_nothing_are_compared_in_tiles(spark, small_tiles, monkeypatch):
    v = values(300)
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(v)], "k long, a long, b long")
    first = {x: v.index(x) for x in v}
    want = {(i, j, distance(x, y)) for x, i in first.items() for y, j in first.items() if i < j and distance(x, y) <= 11}
    want |= {(first[x], k, 0) for k, x in enumerate(v) if first[x] != k}
    dealt = []
    tiled = hm.tiled
    monkeypatch.setattr(hm, "tiled", lambda groups, *rest: dealt.append(groups) or tiled(groups, *rest))
    assert {tuple(r) for r in hm.hamming_pairs(df, "k", ["a", "b"], 11).collect()} == want
    assert len(want) > 1000 and [g.count() for g in dealt] == [len(first)]  # a row a value, not one a band


def test_forest_of_groups_connects_what_pairs_connect(spark, small_tiles):
    v = values(200, 8)
    rows = [(f"n{k:03}", k % 3, *x) for k, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, doc int, a long, b long")
    label = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for r in rows:
            for s in rows:
                if r[1] == s[1] and distance(r[2:], s[2:]) <= 9 and label[s[0]] < label[r[0]]:
                    label[r[0]], changed = label[s[0]], True
    alone = {k for k, c in label.items() if c == k and list(label.values()).count(k) == 1}
    links = hm.hamming_pairs(df, "k", ["a", "b"], 9, by=["doc"], forest=True)
    assert {tuple(r) for r in components(links, "left", "right").collect()} == {(k, c) for k, c in label.items() if k not in alone}
    assert links.count() < len(hm.hamming_pairs(df, "k", ["a", "b"], 9, by=["doc"]).collect())
