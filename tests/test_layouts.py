import json

from ledgerloom.sources import layouts as ly

HEAD = "<tr><th>Etapa</th><th>Fecha Inicio</th><th>Fecha Fin</th></tr>"
ROW = "<TR><td> {} </td><td>{}</td><td><b>02/02/2024</b></td></TR>"


def table(rows, name="x"):
    return f'<table class="c" id="{name}">{HEAD}{"".join(ROW.format(*r) for r in rows)}</table>'


def test_schedule_and_labels(spark):
    two, one = [("Registro (Electrónica)", "01/02/2024 10:00"), ("Bases A TRAVES DEL SEACE", "01/02/2024"), ("bad", "soon")], [("Only &amp; one", "03/02/2024")]
    pages = [
        (1, f"<table><tr><td>{table(two)}</td></tr></table>" + table(one, "tbFicha:j_idt12"), "clash"),
        (2, f"<TABLE><tr><td>{table(one)}{table(two)}</td></tr></TABLE>", None),
        (3, table(one), None), (4, "", None), (5, None, None), (6, "<table>" + "long " * 200_000, None),
    ]
    df = spark.createDataFrame(pages, "page long, html string, stage string")
    got = sorted(tuple(r) for r in ly.extract_schedule(df, "page", "html").collect())
    assert got == [(1, 0, "Only & one", "03/02/2024", "02/02/2024"), (2, 0, "Registro", "01/02/2024 10:00", "02/02/2024"), (2, 1, "Bases", "01/02/2024", "02/02/2024")]
    labels = spark.createDataFrame([(1, "<tr><td>Objeto:</td><td> <i>Bien</i> </td></tr>"), (2, "<tr><td>Other</td></tr>"), (3, None)], "page long, html string")
    assert [r[0] for r in labels.orderBy("page").select(ly.label_value(labels.html, "Objeto:")).collect()] == ["Bien", "", ""]
    assert ly.extract_schedule(df.limit(0), "page", "html").count() == 0


def test_bom_variants(spark):
    files = [
        (1, json.dumps([{"name": "a", "grupo": "g2"}, {"name": "b", "grupo": "g1"}, {"name": "b"}]), None),
        (2, '{"items": [{"name"', json.dumps({"items": [{"name": "c", "qty": 2}], "grupos_identificados": ["z"]})),
        (3, None, None), (4, "[]", "x"), (5, "", ""),
    ]
    got = ly.read_bom_variants(spark.createDataFrame(files, "variant int, body string, rescued string"), "variant", "body", "rescued", ["name", "qty"])
    assert sorted((r.variant, r.place, r.name, r.qty, r.groups) for r in got.collect()) == [(1, 0, "a", None, ["Unknown", "g1", "g2"]), (1, 1, "b", None, ["Unknown", "g1", "g2"]), (1, 2, "b", None, ["Unknown", "g1", "g2"]), (2, 0, "c", "2", ["z"])]


def test_layout_blocks_and_chunks(spark):
    cell = lambda *t: {"blocks": [{"textBlock": {"text": x}} for x in t]}
    blocks = [{"blockId": "1", "textBlock": {"text": "t"}}, {"blockId": "2", "tableBlock": {"headerRows": [{"cells": [cell("a", "b"), cell()]}], "bodyRows": [{"cells": [cell("c")]}]}}, {}]
    df = spark.createDataFrame([(7, json.dumps(blocks), 10), (8, None, 0), (9, "{", 0)], "doc long, body string, at int")
    got = ly.parse_layout_blocks(df, "doc", "body", "at").orderBy("place").collect()
    assert [(r.doc, r.block_id, r.type, r.text, r.semantic_type, r.table_rows) for r in got] == [(7, "1", "text", "t", "paragraph", None), (7, "2", "table", None, None, [["a b", ""], ["c"]]), (7, "", None, None, None, None)]
    chunks = [{"chunkId": "c", "content": "x __START_OF_ANNOTATION__ logo", "pageSpan": {"pageStart": 2}, "pageHeaders": [{"text": "h"}]}, {"sourceBlockIds": ["1"]}]
    got = ly.parse_chunks(spark.createDataFrame([(7, json.dumps(chunks), 10)], "doc long, body string, at int"), "doc", "body", "at").orderBy("place").collect()
    assert [tuple(r)[2:] for r in got] == [("c", "x __START_OF_ANNOTATION__ logo", 12, 11, True, [], ["h"], []), (None, "", None, None, False, ["1"], [], [])]


def test_nested_processes(spark):
    doc = '<div class="container-agreements container-participations-item"><div class="container-text-pdf-title"><span class="title">{}</span><span class="excerpt">{}</span></div><a href="/x/getFile_store_competition_download?{}">d</a></div>'
    item = '<li class="parent-main-competition"><div class="container-title-competition"><div class="container-text-pdf-title"><span class="title"> {} </span><span class="excerpt">About</span></div></div><div class="container-competition">{}</div></li>'
    html = item.format("P-1", doc.format("Bases", "Fecha de vigencia: desde 01.02.24\n hasta 03.04.24", "name_file=a.pdf&amp;new_name=B%20a.pdf") + doc.format("No file", "", "other=1")) + item.format("P-2", "") + '<li class="parent-main-competition">no title</li>'
    df = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page long, html string")
    got = sorted(tuple(r) for r in ly.extract_nested_processes(df, "page", "html").collect())
    link = "/x/getFile_store_competition_download?name_file=a.pdf&amp;new_name=B%20a.pdf"
    assert got == [(1, 0, "P-1", "About", 0, "Bases", "01.02.24", "03.04.24", link, "a.pdf", "B a.pdf"), (1, 1, "P-2", "About", None, None, None, None, None, None, None)]
