"""Operators on small hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import rules
from ledgerloom.functions import text as tx
from ledgerloom.operators import assembly as am
from ledgerloom.operators import corpus as cp
from ledgerloom.operators import feed as fd
from ledgerloom.operators import listing as ls
from ledgerloom.sources import readers as rd


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()[0]


@pytest.mark.parametrize(
    ("column", "value", "want"),
    [
        (tx.fold_text, "CRÈME Añejo ß", "creme anejo ß"),
        (tx.fold_text, None, ""),
        (tx.normalize_key, " a  b\t c ", "A B C"),
        (tx.digits_only, "RUC 20-1", "201"),
        (tx.int_or_zero, "x", 0),
        (tx.float_or_zero, "1,234.50", 1234.5),
        (tx.is_page_number, "Página 3 de 10", True),
        (tx.slugify, "  A b/C ", "a_b_c"),
        (tx.looks_like_size_label, "(12.5 KB)", True),
        (tx.extract_year and (lambda c: tx.extract_year(c, F.lit(1))), "LP-2021-3", 2021),
        (lambda c: tx.contains_term(c, "raciones"), "OPERACIONES", False),
        (lambda c: tx.contains_term(c, "raciones"), "Raciones crudas", True),
        (lambda c: tx.parse_ddmmyy(c).cast("string"), "19/05/75", "1975-05-19"),
        (lambda c: tx.parse_ddmmyy(c).cast("string"), "1/3/2026", "2026-03-01"),
        (lambda c: tx.parse_prefix_ts(c).cast("string"), "31/02/2026 x", None),
        (lambda c: tx.format_ts(c, "America/Lima"), "2024-01-01T10:00:00Z", "01/01/2024 05:00"),
    ],
)
def test_scalars(spark, column, value, want):
    assert one(spark, column, value) == want


def test_json_list_keeps_objects_only(spark):
    column = lambda c: F.to_json(tx.parse_json_list(c, ["k"]))
    assert one(spark, column, '[{"k": 1}, 3, "x", {"j": 2}]') == '[{"k":"1"},{"k":""}]'  # a missing key has its default
    assert one(spark, column, "not json") == "[]"


@pytest.mark.parametrize("rule", ["", "(a", "a)", "other:x", "objeto:(descripcion:x)", "a OR"])
def test_malformed_rules(spark, rule):
    fields = {"objeto": F.lit("a"), "descripcion": F.lit("b")}
    with pytest.raises(rules.RuleError):
        rules.match_query(rule, fields, ["objeto"])


def test_rules(spark):
    rows = spark.createDataFrame([("compra de raciones", "lima"), ("compra de operaciones", "cusco")], "objeto string, lugar string")
    fields = {"objeto": F.col("objeto"), "lugar": F.col("lugar")}
    hit = lambda q: [r[0] for r in rows.select(rules.match_query(q, fields, ["objeto", "lugar"])).collect()]
    assert hit('objeto:("de raciones" OR servicio) -cusco') == [True, False]
    assert hit("raciones lima") == [True, False]
    assert hit('"raciones lima"') == [True, False]  # a phrase may span fields
    assert hit("compra AND -lima") == [False, True]


def test_overlay_and_decisions(spark):
    feed = spark.createDataFrame([(1, "publicada"), (2, "autorejected"), (3, "autorejected"), (4, "publicada")], "id long, status string")
    decisions = spark.createDataFrame([("t", 3, "exempt"), ("t", 4, "autorejected"), ("u", 1, "autorejected")], "tenant_id string, feed_item_id long, decision string")
    assert sorted(r[0] for r in fd.effective_rejected(feed, decisions, "t").collect()) == [2, 4]
    new = spark.createDataFrame([("t", 3, "autorejected"), ("t", 9, "autorejected")], "tenant_id string, feed_item_id long, decision string")
    after = {(r.tenant_id, r.feed_item_id): r.decision for r in fd.upsert_decisions(decisions, new).collect()}
    assert after["t", 3] == "exempt" and after["t", 9] == "autorejected" and len(after) == 4


def test_upsert_is_idempotent_and_unique(spark):
    old = spark.createDataFrame([(1, "a", 10)], "k long, digest string, v long")
    new = spark.createDataFrame([(1, "b", 11), (2, "c", 20), (2, "d", 19)], "k long, digest string, v long")
    nxt, actions = fd.upsert_feed(old, new, ["k"], "digest", ["v"], [F.desc("v")])
    assert {r.k: (r.digest, r.v) for r in nxt.collect()} == {1: ("b", 11), 2: ("c", 20)}
    assert {r.k: r.action for r in actions.collect()} == {1: "update", 2: "insert"}
    again, actions = fd.upsert_feed(nxt, new, ["k"], "digest", ["v"], [F.desc("v")])
    assert {r.action for r in actions.collect()} == {"touch"} and again.exceptAll(nxt).count() == 0


def test_changelog_rebuilds_new(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "k long, v string")
    assert {(r.k, r.kind, r.old, r.new) for r in fd.changelog(old, new, ["k"], ["v"]).collect()} == {(1, "removed", None, None), (2, "modified", "y", "z"), (4, "added", None, None)}


def test_due_for_refresh(spark):
    rows = [(1, None, "2026-06-06 12:00:00"), (2, "2026-06-05 11:10:00", "2026-06-06 12:00:00"), (3, "2026-06-05 11:10:00", "2026-07-06 12:00:00")]
    df = spark.createDataFrame(rows, "id long, checked string, deadline string").withColumns({c: F.col(c).cast("timestamp") for c in ("checked", "deadline")})
    assert sorted(r.id for r in fd.due_for_refresh(df, F.lit("2026-06-05 12:00:00").cast("timestamp"), "checked", "deadline").collect()) == [1, 2]


def test_chunks_cover_and_cut(spark):
    s = spark.createDataFrame([("d", 1, 400), ("d", 401, 600), ("d", 601, 2000), ("e", 1, 10)], "doc_id string, line_start long, line_end long")
    rows = cp.pack_chunks(s, "doc_id").orderBy("doc_id", "chunk").collect()
    assert [(r.line_start, r.line_end) for r in rows if r.doc_id == "d"] == [(1, 400), (401, 600), (601, 1100), (1051, 1550), (1501, 2000)]
    assert cp.coverage(s, ["doc_id"], "line_start", "line_end").filter("doc_id = 'd'").first().covered == 2000


def test_inheritance_and_hamming(spark):
    bom = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "item_id long, parent_id long")
    reqs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (3, "c")], "item_id long, text string")
    got = {(r.item_id, r.text, r.origin, r.parent) for r in cp.inherit_requirements(bom, reqs).collect() if r.item_id == 3}
    assert got == {(3, "c", "DIRECTO", None), (3, "a", "HEREDADO", 2), (3, "b", "HEREDADO", 2)}
    h = spark.createDataFrame([(1, 0, 0), (2, 7, 0), (3, -1, 0)], "k long, a long, b long")
    assert [(r.left, r.right, r.distance) for r in cp.hamming_pairs(h, "k", ["a", "b"], 3).collect()] == [(1, 2, 3)]


def test_rescue_and_catalog(spark, tmp_path):
    rows = spark.createDataFrame([(1, '[{"a": 1}, {"b": {"c": 2}}, {"cut'), (2, None)], "k long, t string")
    assert [r.object for r in cp.rescue_json_objects(rows, "k", "t").orderBy("place").collect()] == ['{"a": 1}', '{"b": {"c": 2}}']
    path = tmp_path / "catalog.txt"
    path.write_text("ruc|nombre_de_entidad|estado\n20-1|UNO|ACTIVO\nshort\n|x|y\n", encoding="utf-8")
    assert [tuple(r) for r in rd.read_entity_catalog(spark, str(path)).collect()] == [("201", "UNO", "ACTIVO")]
    with pytest.raises(KeyError):
        rd.source("nowhere")


def test_requirements_come_from_ancestors_of_any_depth(spark):
    """A chain of 40, a cycle, an unknown parent; kinds that do not apply stay where they are; ids by distance."""
    chain = [(k, k - 1 if k else None) for k in range(40)] + [(100, 102), (101, 100), (102, 101), (200, 999)]
    bom = spark.createDataFrame(chain, "item_id int, parent_id int")
    reqs = spark.createDataFrame([(0, "root", "a"), (1, "own", "b"), (39, "last", "a"), (100, "round", "a"), (200, "alone", "a")], "item_id int, text string, kind string")
    rows = cp.inherit_requirements(bom, reqs).collect()
    assert {r.item_id for r in rows if r.text == "root"} == set(range(40))
    assert {r.item_id for r in rows if r.text == "own"} == set(range(1, 40))
    assert sorted((r.item_id, r.origin, r.parent) for r in rows if r.text == "round") == [(100, "DIRECTO", None), (101, "HEREDADO", 100), (102, "HEREDADO", 100)]
    assert [(r.item_id, r.origin) for r in rows if r.text == "alone"] == [(200, "DIRECTO")]
    numbered = cp.inherit_requirements(bom, reqs, spark.createDataFrame([("a",)], "kind string"), numbered=True).collect()
    assert {r.item_id for r in numbered if r.text == "own"} == {1}
    assert sorted((r.requirement_id, r.text) for r in numbered if r.item_id == 39) == [("R-001", "last"), ("R-002", "root")]
    assert cp.inherit_requirements(bom.limit(0), reqs).count() == 0


def test_drawings_that_alternate_are_one(spark):
    """Crowded pages do not count; neighbours within two points and mirrored ones of one size are fused, other styles are not."""
    rows = [("d", p, 10.0 + p % 3, 5.0, 60.0 + p % 3, 9.0, "s") for p in range(12)]
    rows += [("d", p, 300.0 * (p % 2), 50.0, 300.0 * (p % 2) + 7, 90.0, "s") for p in range(12)]
    rows += [("d", p, 10.0, 5.0, 60.0, 9.0, "other") for p in range(4)]
    rows += [("d", 50, float(k), 0.0, k + 1.0, 1.0, "cad") for k in range(501)] + [(None, 1, 0.0, 0.0, 1.0, 1.0, None)]
    drawings = spark.createDataFrame(rows, "doc string, page int, x0 double, y0 double, x1 double, y1 double, style string")
    totals = spark.createDataFrame([("d", 20)], "doc string, total int")
    found = sorted((r.x0, r.y0, r.pages) for r in am.repeated_drawings(drawings, "doc", totals).collect())
    assert found == [(0, 50, 12), (10, 5, 12)]
    assert am.repeated_drawings(drawings.limit(0), "doc", totals).count() == 0


def test_batches_listings_and_regions_on_nulls_and_empty_tables(spark):
    files = spark.createDataFrame([("a", 5), ("a", None), ("b", 60 << 20), ("c", None)] + [("d", 1)] * 9 + [("e", 40 << 20), ("e", 9 << 20), ("f", 7)], "k string, size long")
    assert {r.k: r.reason for r in ls.batch_limits(files, "k", "size").collect()} == {"a": "empty file", "b": "file too large", "c": "empty batch", "d": "too many files", "e": "batch too large", "f": "ok"}
    assert ls.batch_limits(files.limit(0), "k", "size").count() == 0
    feed = spark.createDataFrame([(1, 7, "Key  a", "p"), (2, 7, "KEY A", "q"), (3, 7, None, "q"), (4, None, "key a", "q")], "id int, entity_id int, nkey string, status string")
    assert [tuple(r) for r in ls.match_business_key(feed, feed, "entity_id", "nkey", "id", [F.desc("id")]).collect()] == [(1, 2)]
    assert ls.facets(feed, ["nkey", "status"]).count() == 5
    ratio = ls.median_ratio(spark.createDataFrame([("g", 0), ("g", 0), ("h", None)], "g string, v int"), ["g"], "v").collect()
    assert sorted((r.g, r.median, r.ratio) for r in ratio if r.g == "g") == [("g", 0.0, 1.0)] * 2
    with pytest.raises(ValueError):
        ls.listing_filter(feed, "no such status", allowed=["p"])
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (1, 2, None), (2, 0, "x")], "page int, pos int, line string")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (3, 0, "x")], "page int, pos int, line string")
    (row,) = am.changed_regions(old, new, "page", "pos", "line").collect()
    assert (row.page, row.regions, row.risk) == (1, 2, "high")


def test_texts_and_names_that_need_care(spark):
    one = lambda column, *values: [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()]
    assert one(tx.fold_text, "Việt ế й Άλφα ÉÑ", None) == ["viet e и αλφα en", ""]
    assert tx.fold_literal("Việt Ά") == "viet α"
    assert one(tx.sanitize_filename, "a\\b: c?  d.docx ", "x" * 200 + ".pdf", "", " .. ", "no ext", "a/b/") == ["b_ c_ d.docx", "x" * 176 + ".pdf", "documento.pdf", "documento.pdf", "no ext.pdf", "b.pdf"]
    assert one(tx.looks_like_size_label, "(12.5 KB).pdf", "9 mb", "9 mbx", "", None) == [True, True, False, False, False]
    assert one(tx.looks_like_uuid, "x/3f2504e0-4f89-11d3-9a0c-0305e82c3301.pdf", "3f2504e0", None) == [True, False, False]
    assert one(tx.strip_preamble, "Claro, aquí\n---\n***\n\nBody", "---", None) == ["Body", "", None]
    assert one(tx.strip_marker_section, "a \n## Cronograma (ficha SEACE 1)\nx", "b ", None) == ["a", "b ", None]
    raw = spark.createDataFrame([(bytearray("€5 “x”".encode("cp1252")),), (bytearray("ñ€".encode()),), (None,)], "v binary")
    assert [r[0] for r in raw.select(rd.decode_bytes(F.col("v"))).collect()] == ["€5 “x”", "ñ€", None]
