"""Queries of the rules over markup, on pages with signs in attributes, tables in cells and tags left open, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import markup as mk
from .queries import c, query, table


def _page(spark, sf_dir, *before: Column | str) -> DataFrame:
    """Every page with markup before its own; the page's own tables and rows stay part of the input."""
    parts = [F.lit(b) if isinstance(b, str) else b for b in before]
    return table(spark, sf_dir, "pages").select("page_id", F.concat(*parts, F.coalesce("html", F.lit(""))).alias("html"))


def _key() -> Column:
    return c("page_id").cast("string")


def _listed(at: int, nid: str, cells: int) -> Column:
    """A row of a listing whose second cell holds a table and whose cells are not closed."""
    tds = [F.concat(F.lit(f'<td title="<td>{j}>">c{j}-'), _key(), F.lit("<table><tr><td>in</td><td>ner</td></tr></table>" if j == 1 else "")) for j in range(cells)]
    call = F.concat(F.lit("if(1<2){f({'nidProceso':'"), _key(), F.lit(f"{nid}','nidConvocatoria':'v"), _key(), F.lit("','formBuscador:dtProcesos:1:x':'formBuscador:dtProcesos:1:x'})}"))
    return F.concat(F.lit(f'<tr data-ri="{at}">'), *tds, F.lit('<td><a title="a>b" href="#" onclick="'), call, F.lit('">x</a></td></tr>'))


@query("A03_listing_markup", """SELECT page_id AS page, CAST(4 + n AS INTEGER) AS row_index, 'c0-' || page_id AS numero, 'c1-' || page_id || 'inner' AS fecha_publicacion, 'c8-' || page_id AS version_seace,
  page_id || '' || n AS nid_proceso, 'v' || page_id AS nid_convocatoria, '3' AS nid_sistema, 'formBuscador:dtProcesos:1:x' AS link_id FROM pages, (VALUES (0), (1)) v(n)""")
def a03(spark, sf_dir):
    pages = _page(spark, sf_dir, '<table><tbody class="x" id="formBuscador:dtProcesos_data">', _listed(4, "0", 9), _listed(5, "1", 9), _listed(6, "1", 9), _listed(7, "2", 5), "</tbody></table>")
    rows = mk.listing_rows(mk.elements(pages, "page_id", "html"))
    return rows.select("page", "row_index", "numero", "fecha_publicacion", "version_seace", "nid_proceso", "nid_convocatoria", "nid_sistema", "link_id")


@query("A05_schedule_markup", """SELECT page_id AS page, CAST(n AS INTEGER) AS place, CASE n WHEN 0 THEN 'Bases' || page_id ELSE 'Registro' END AS stage, '0' || (page_id % 9 + 1) || '/02/2024' AS starts, 'fin' AS ends
  FROM pages, (VALUES (0), (1)) v(n) WHERE n = 0 OR page_id % 3 > 0""")
def a05_schedule(spark, sf_dir):
    row = lambda stage: F.concat(F.lit('<tr title="</table>"><td>'), stage, F.lit("<td>0"), (c("page_id") % 9 + 1).cast("string"), F.lit("/02/2024<td><b>fin</b>"))
    second = F.when(c("page_id") % 3 > 0, row(F.lit("Registro (Electrónica)"))).otherwise("")
    head = '<table><tr><td><table id="tbFicha:j_idt7"><tr><th>Etapa<th>Fecha Inicio<th>Fecha Fin</tr>'
    pages = _page(spark, sf_dir, head, row(F.concat(F.lit("Bases A TRAVES DEL SEACE&nbsp;"), _key())), second, "</table></td></tr></table>")
    return mk.schedules(mk.elements(pages, "page_id", "html"))


@query("A05_documents_markup", """SELECT page_id AS page, CAST(n AS INTEGER) AS place, 'u' || n || '-' || page_id AS uuid, CASE n WHEN 0 THEN 'Bases' ELSE 'n.pdf' END AS name, 'Etapa' AS stage, 'Bases' AS kind,
  CAST(page_id % 90 AS VARCHAR) AS size, '01/02/2024' AS "date", CAST(n + 1 AS VARCHAR) AS access FROM pages, (VALUES (0), (1)) v(n)""")
def a05_documents(spark, sf_dir):
    def row(n: int, name: str) -> Column:
        call = F.concat(F.lit(f"if(1<2) descargaDocGeneral('u{n}-"), _key(), F.lit(f"','{n + 1}','{name}');"))
        return F.concat(F.lit('<tr><td>1<td>Etapa<td>Bases<td><a title="<tr>" onclick="'), call, F.lit('">('), (c("page_id") % 90).cast("string"), F.lit(" KB)</a><td>01/02/2024<td>"))

    pages = _page(spark, sf_dir, "<table><tr><td><table>", row(0, ""), row(1, "n.pdf"), "</table></td></tr></table>")
    return mk.documents(mk.elements(pages, "page_id", "html"))


@query("A05_labels_markup", "SELECT page_id AS page, 'Nomenclatura:' AS label, 'LP-' || page_id AS value FROM pages UNION ALL SELECT page_id, 'Fecha:', page_id || ':00' FROM pages")
def a05_labels(spark, sf_dir):
    rows = ['<table><tr><td>x<td title="Nomenclatura:"><b>Nomenclatura:</b><td> LP-', _key(), "<tr><td>Fecha: ", _key(), ":00</table>"]
    return mk.label_values(mk.elements(_page(spark, sf_dir, *rows), "page_id", "html", texts=True), ["Nomenclatura:", "Fecha:", "No such label:"])


@query("A06_markup", """SELECT page_id AS page, CAST(0 AS INTEGER) AS process, 'P-' || page_id AS code, 'About' AS description, CASE WHEN page_id % 2 = 0 THEN CAST(1 AS INTEGER) END AS place,
  CASE WHEN page_id % 2 = 0 THEN page_id || ' é.pdf' END AS file, CASE WHEN page_id % 2 = 0 THEN '01.02.24' END AS valid_from, CASE WHEN page_id % 2 = 0 THEN '02.03.24' END AS valid_to FROM pages""")
def a06(spark, sf_dir):
    words = lambda title, text: F.concat(F.lit('<div class="container-text-pdf-title"><span class="x title">'), title, F.lit('</span><span class="excerpt">'), text, F.lit("</span></div>"))
    doc = lambda query: F.concat(F.lit('<div class="container-participations-item container-agreements">'), words(F.lit("T"), F.lit("Fecha de vigencia: Desde 01.02.24 Hasta 02.03.24")), F.lit('<a title="a>b" href="/getFile_store_competition_download?'), query, F.lit('">x</a></div>'))
    docs = F.when(c("page_id") % 2 == 0, F.concat(doc(F.lit("other=1")), doc(F.concat(F.lit("z=1&amp;name_file="), _key(), F.lit("%20%C3%A9.pdf"))))).otherwise("")
    pages = _page(
        spark, sf_dir, '<ul><li class="parent-main-competition"><div class="container-title-competition">', words(F.concat(F.lit("P-"), _key()), F.lit("About")),
        '</div><div class="container-competition">', docs, '</div><li class="parent-main-competition"><div>no title</div></ul>',
    )
    return mk.nested_processes(mk.elements(pages, "page_id", "html")).select("page", "process", "code", "description", "place", "file", "valid_from", "valid_to")
