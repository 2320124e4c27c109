"""Rules over markup with signs in attributes, tables in cells and tags left open."""

from ledgerloom.sources import layouts as ly
from ledgerloom.sources import markup as mk

HEAD = "<tr><th>Etapa</th><th>Fecha Inicio</th><th>Fecha Fin</th></tr>"


def row(*cells):
    return "<TR>" + "".join(f"<td> {c} </td>" for c in cells) + "</TR>"


def frame(spark, pages):
    return spark.createDataFrame([(k, h, "clash") for k, h in pages], "page_id long, html string, tag string")


def found(spark, pages, **more):
    return mk.elements(frame(spark, pages), "page_id", "html", **more)


def test_elements(spark):
    html = '<!-- <table> --><table id="a<b>c"><tr><td title="x>y">1<td>2 &amp; 3<tr><td><table><tr><td>in</table>out</td></tr></table><script>"<td>"</script><br/>t'
    got = [(r.at, r.up, r.tag, r.text) for r in found(spark, [(1, html), (2, None), (3, ""), (4, "<td")]).orderBy("at").collect()]
    assert got == [
        (0, None, "table", "12 & 3inout"), (1, 0, "tr", "12 & 3"), (2, 1, "td", "1"), (3, 1, "td", "2 & 3"), (4, 0, "tr", "inout"), (5, 4, "td", "inout"), (6, 5, "table", "in"), (7, 6, "tr", "in"), (8, 7, "td", "in"),
    ]
    assert found(spark, [(1, html)]).filter("tag = 'table' AND at = 0").first().attrs == {"id": "a<b>c"}
    assert found(spark, [(1, "<div> a <b> b</b></div>")]).first().joined == "ab"


def listing(*rows, extra=""):
    return f'<table><tbody id="formBuscador:dtProcesos_data">{"".join(rows)}</tbody></table>{extra}'


def listed(nid, cells=9, ri="", inner="", call="", link='id="own"'):
    body = "".join(f"<td><span>c{k}</span></td>" for k in range(cells - 1)) + f"<td>last{inner}</td>"
    onclick = f"""if(1<2){{f({{'nidProceso':'{nid}','nidConvocatoria':'v{nid}'{call}}})}}"""
    return f'<tr {ri}>{body}<td><a {link} title="a>b" href="#" onclick="{onclick}">x</a></td></tr>'


def test_listing_rows(spark):
    nested = "<table><tbody><tr><td>n1</td><td>n2</td></tr></tbody></table>"
    rows = [
        listed(1, ri='data-ri="7"', inner=nested), listed(2, call=",'formBuscador:dtProcesos:1:x':'formBuscador:dtProcesos:1:x','ntipo':'5'"), listed(1), listed(3, cells=8), listed(""),
        "<tr>" + "<td>x</td>" * 10 + "</tr>",
        "<tr>" + "<td>x</td>" * 9 + f"<td><table>{listed(9, cells=1)}</table></td></tr>",  # the link stands in a table in a cell
    ]
    pages = [(1, listing(*rows)), (2, "<table><tbody id='other'>" + listed(1) + "</tbody></table>"), (3, None), (4, listing(listed(4)) + listing(listed(5)))]
    got = {(r.page, r.nid_proceso): r for r in mk.listing_rows(found(spark, pages)).collect()}
    assert sorted(got) == [(1, "1"), (1, "2"), (1, "9"), (4, "4")]
    one, two, nine = got[1, "1"], got[1, "2"], got[1, "9"]
    assert (one.row_index, one.numero, one.version_seace, one.nid_convocatoria, one.nid_sistema, one.ntipo, one.link_id) == (7, "c0", "lastn1n2", "v1", "3", "0", "own")
    assert (two.row_index, two.ntipo, two.link_id) == (1, "5", "formBuscador:dtProcesos:1:x") and nine.numero == "x"


def test_schedules(spark):
    table = lambda rows, name="x": f'<table data-x="<td>" id="{name}">{HEAD}{"".join(row(*r) for r in rows)}</table>'
    two = [("Registro (Electrónica)", "01/02/2024 10:00", "<b>02/02</b>/2024"), ("Bases A TRAVES DEL SEACE", "01/02/2024", "02/02/2024"), ("bad", "soon", "x"), ("four", "01/02/2024", "x", "y")]
    one = [("Only &amp; one", "03/02/2024", "x")]
    pages = [
        (1, f"<table><tr><td>{table(two)}</td></tr></table>" + table(one, "f:tbFicha:j_idt12")), (2, f"<TABLE><tr><td>{table(one)}{table(two)}</td></tr></TABLE>"), (3, table(one)), (4, ""), (5, None),
        (6, table([("no", "date", "x")], "tbFicha:j_idt1") + table(one, "tbFicha:j_idt2") + table(two)), (7, table(two).replace("Fecha Fin", "Fin")),
    ]
    got = sorted(tuple(r) for r in mk.schedules(found(spark, pages)).collect())
    both = [(0, "Registro", "01/02/2024 10:00", "02/02/2024"), (1, "Bases", "01/02/2024", "02/02/2024")]
    assert got == [(1, 0, "Only & one", "03/02/2024", "x"), *[(2, *r) for r in both], *[(6, *r) for r in both]]
    same = sorted(tuple(r) for r in ly.extract_schedule(frame(spark, pages), "page_id", "html").filter("page_id IN (2)").collect())
    assert same == [(2, *r) for r in both]


def test_documents_and_labels(spark):
    link = lambda k, name="": f"""<a title="<td>" onclick="if(1<2) descargaDocGeneral('u{k}','{k}','{name}')">(9 KB)</a>"""
    html = "<table>" + row("1", "Etapa", "Bases", link(1), "01/02/2024", "") + row("1", "x", link(2, "n.pdf")) + row("2", "E2", "<table>" + row("in") + "</table>", link(3), "d", "") + "</table>" + link(4) + "<a onclick='descargaDocGeneral()'>x</a>"
    html += "<table>" + row("<b>Objeto:</b>", " <i>Bien </i><i>es</i>") + row("Otro", "Fecha: 3: 4") + "</table>"
    pages = [(1, html), (2, "Objeto: no row"), (3, None)]
    got = [tuple(r) for r in mk.documents(found(spark, pages)).orderBy("page", "place").collect()]
    assert got == [
        (1, 0, "u1", "Bases", "Etapa", "Bases", "9", "01/02/2024", "1"), (1, 1, "u2", "n.pdf", "", "", "9", "", "2"),
        (1, 2, "u3", "in", "E2", "in", "9", "(9 KB)", "3"), (1, 3, "u4", "", "", "", "9", "", "4"),
    ]
    got = sorted(tuple(r) for r in mk.label_values(found(spark, pages, texts=True), ["Objeto:", "Fecha:", "Nothing:"]).collect())
    assert got == [(1, "Fecha:", "3: 4"), (1, "Objeto:", "Bienes")]


def test_nested_processes(spark):
    doc = '<div class="container-participations-item x container-agreements"><div class="container-text-pdf-title"><span class="title">{}</span><span class="excerpt">{}</span></div><a title="a>b" href="/x/getFile_store_competition_download?{}">d</a></div>'
    item = '<li class="parent-main-competition"><div class="container-title-competition"><div class="container-text-pdf-title"><span class="title"> {} </span><span class="excerpt">About</span></div></div><div class="container-competition">{}</div></li>'
    html = item.format("P-1", doc.format("No file", "", "other=1") + doc.format("Bases", "Fecha de vigencia: desde 01.02.24\n hasta 03.04.24", "name_file=a.pdf&amp;new_name=B%20a.pdf")) + item.format("P-2", "") + '<li class="parent-main-competition">no title</li>'
    got = sorted(tuple(r) for r in mk.nested_processes(found(spark, [(1, html), (2, ""), (3, None)])).collect())
    link = "/x/getFile_store_competition_download?name_file=a.pdf&new_name=B%20a.pdf"
    assert got == [(1, 0, "P-1", "About", 1, "Bases", "01.02.24", "03.04.24", link, "a.pdf", "B a.pdf"), (1, 1, "P-2", "About", None, None, None, None, None, None, None)]


def test_pages_are_read_once_for_each_rule(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td>x</td></tr></table>")], "page int, html string")
    for rule in (mk.listing_rows, mk.schedules, mk.documents, mk.nested_processes, lambda found: mk.label_values(found, ["x"])):
        out = rule(mk.elements(pages, "page", "html", texts=True))
        assert "MapInArrow" not in out._jdf.queryExecution().toString()  # elements come from the table that they were written to
        assert "parquet" in out._jdf.queryExecution().toString()
