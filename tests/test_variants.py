"""Similar texts against all pairs, and what becomes of merged items."""

import random

from ledgerloom.operators import variants as va


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(seed):
    """Texts and edited copies; many share all of their frequent grams."""
    rng = random.Random(seed)
    out = {"", "a", "ab", "abc", "abd", "x" * 40, "x" * 41, "x" * 47}
    while len(out) < 260:
        text = rng.choice(["pump station ", "valve ", "", "abc"]) + "".join(rng.choices("abcd ", k=rng.randint(1, 14)))
        out.add(text)
        for _ in range(3):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "z", "ab"]) + text[at + rng.randint(0, 1) :]
            out.add(text)
    return sorted(out)


def test_pairs_equal_brute_force(spark):
    texts = words(2)
    rows = [(k, "g" if k % 5 else None, t) for k, t in enumerate(texts)] + [(9000, "g", None)]
    df = spark.createDataFrame(rows, "id long, grp string, t string")
    for least, block in ((0.85, 1000), (0.7, 7), (1.0, 1000)):
        want = {(a, b) for a, g, x in rows for b, h, y in rows if a < b and g == h and None not in (x, y) and distance(x, y) <= (1 - least) * max(len(x), len(y)) + 1e-9}
        got = [(r.a, r.b) for r in va.similar_texts(df, ["grp"], "t", least, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert va.similar_texts(df.limit(0), ["grp"], "t").count() == 0


def test_merged_items(spark):
    rows = [
        ("g", "Válvula  de bola", "2", "a", "x"), ("g", "valvula de bola", "dos", "b", "y"), ("g", "valvula de bolas", None, "c", "x"), ("g", "Bomba", "tres", "a", None),
        ("h", "valvula de bola", "1", "a", " "), (None, None, None, None, None), (None, "", "4", "b", "z"), ("g", "Bomba", "tres", "a", None),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "grp string, text string, q string, v string, n string, items string")
    exact = sorted(tuple(r)[1:] for r in va.merge_variants(df, ["grp"], "text", "q", "v", "n").filter("grp IS NOT NULL").collect())
    assert exact == [
        ("g", "Bomba", "tres", "a", "", 2), ("g", "Válvula  de bola", "2", "a,b", "x; y", 2), ("g", "valvula de bolas", None, "c", "x", 1), ("h", "valvula de bola", "1", "a", "", 1),
    ]
    fuzzy = va.merge_variants(df, ["grp"], "text", "q", "v", "n", least=0.85)
    got = sorted((tuple(r) for r in fuzzy.collect()), key=str)
    assert [r[1:] for r in got if r[1] == "g"] == [("g", "Bomba", "tres", "a", "", 2), ("g", "valvula de bolas", "2", "a,b,c", "x; y", 3)]
    assert sorted(r[0] for r in got) == [f"EXP-{k:03d}" for k in range(1, 5)]
    assert [r[2:] for r in got if r[1] is None] == [("", "4", "b", "z", 2)]
    assert va.merge_variants(df.limit(0), ["grp"], "text", "q", "v", "n", least=0.85).count() == 0
