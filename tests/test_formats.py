"""Scorers and gates of each format on rows that differ from a good base by one defect."""

import pytest
from pyspark.sql import functions as F

from quillscope import schemas
from quillscope.operators import format_scoring as S

BASE = dict(error=None, hasStructTree=True, hasLang=True, lang="en-US", hasOutlines=False, outlineCount=0, hasAcroForm=False, formFields=[], images=[], imageObjectCount=0, headings=["H1", "H2"], tables=[], lists=[], paragraphCount=12, totalPageCount=2, fonts=[], visibleFonts=None, accessibilityAllowed=None, displayDocTitle=True, hasXfa=False, needsRendering=False, structTreeDepth=4, hasContentOrder=True, pageCount=2, hasText=True, textLength=4000, title="Quarterly Report", links=[], imageCount=0, nonArtifactImageCount=0)
TABLE = dict(hasHeaders=True, headerCount=2, hasScope=True, hasRowStructure=True, rowCount=3, hasNestedTable=False, hasCaption=True, hasConsistentColumns=True, columnCounts=[2, 2, 2], hasHeaderAssociation=False)
DOCX = dict(documentOk=True, stylesOk=True, coreOk=True, title="T", language="en", headings=[1, 2], fakeHeadings=0, images=[], tables=[], links=[], contrast=dict(checked=0, unresolved=0, failing=[]), realItems=0, manualItems=0)
PPTX = dict(title="T", language="en", slides=[dict(title="A", hidden=False, titleFirst=True), dict(title="B", hidden=False, titleFirst=True)], images=[], tables=[], links=[], contrast=DOCX["contrast"], realItems=0, manualItems=0, hasMedia=False)
XLSX = dict(title="T", valuedCells=5, sheets=[dict(name="Costs", hidden=False, cells=5, hasTable=False, hasPivot=False)], tables=[], images=[], links=[], contrast=DOCX["contrast"])


def frame(spark, schema, rows):
    names = [f.split(" ", 1)[0] for f in _fields(schema)]
    return spark.createDataFrame([tuple({"doc_id": i, **r}[n] for n in names) for i, r in enumerate(rows)], schema)


def _fields(schema):
    depth, at, out = 0, 0, []
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[at:i].strip())
            at = i + 1
    return out


def scores(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, {})[r.id] = "?" if r.not_assessed else r.score
    return out


IMG = lambda ref, alt: dict(ref=ref, hasAlt=alt, altText="a map" if alt else None)
PDF_CASES = [
    ({}, "text_extractability", 100), ({"accessibilityAllowed": False}, "text_extractability", 0), ({"hasStructTree": False}, "text_extractability", 50), ({"hasText": False}, "text_extractability", 25),
    ({"fonts": [dict(name="ABCDEF+Arial", embedded=False)], "visibleFonts": ["Arial"]}, "text_extractability", 85), ({"fonts": [dict(name="Arial", embedded=False)], "visibleFonts": ["Times"]}, "text_extractability", 100),
    ({"headings": [], "paragraphCount": 0, "hasContentOrder": False}, "text_extractability", 50), ({}, "title_language", 100), ({"title": "report_final.pdf"}, "title_language", 75), ({"displayDocTitle": None}, "title_language", 85),
    ({"title": " ", "hasLang": False, "lang": None}, "title_language", 0), ({}, "heading_structure", 100), ({"headings": []}, "heading_structure", None), ({"headings": [], "totalPageCount": 4}, "heading_structure", 0),
    ({"headings": ["H"]}, "heading_structure", 40), ({"headings": ["H1", "H3"]}, "heading_structure", 60), ({}, "alt_text", None), ({"images": [IMG("1", True), IMG("2", False), IMG("3", True)]}, "alt_text", 66),
    ({"images": [IMG("1", False)]}, "alt_text", 0), ({"nonArtifactImageCount": 2}, "alt_text", 0), ({"images": [IMG("1", True)], "nonArtifactImageCount": 2}, "alt_text", 50), ({}, "color_contrast", "?"), ({"pageCount": 10}, "bookmarks", 45),
    ({"pageCount": 10, "outlineCount": 3}, "bookmarks", 100), ({"pageCount": 10, "hasOutlines": True}, "bookmarks", 40), ({"pageCount": 10}, "bookmarks", 45), ({"tables": [TABLE]}, "table_markup", 100), ({"tables": [TABLE | {"columnCounts": [1, 1]}]}, "table_markup", None), ({"tables": [TABLE, TABLE | {"hasHeaders": False, "hasScope": False}]}, "table_markup", 80),
    ({"links": [dict(url="u", text="click here", tagged=True), dict(url="u", text="Annual budget", tagged=True), dict(url="u", text="Other budget", tagged=False)]}, "link_quality", 33),
    ({"hasAcroForm": True, "formFields": [dict(name="a", hasTU=True), dict(name="b", hasTU=False)]}, "form_accessibility", 50), ({"structTreeDepth": 1}, "reading_order", 30), ({}, "reading_order", "?"),
]


def test_pdf_scores(spark):
    got = scores(S.pdf_categories(frame(spark, schemas.PDF, [BASE | d for d, _, _ in PDF_CASES])))
    assert [(d, i, got[n][i]) for n, (d, i, _) in enumerate(PDF_CASES)] == PDF_CASES


GATES = [
    ({}, "no-automated-failures", []), ({"error": "x"}, "incomplete", []), ({"hasStructTree": False, "lang": None, "hasLang": False}, "fail", ["no_structure", "no_language"]), ({"title": None}, "fail", ["no_title"]),
    ({"textLength": 0, "hasText": False, "imageCount": 2, "hasStructTree": False}, "fail", ["no_structure", "scanned"]), ({"lists": [dict(isWellFormed=False)]}, "fail", ["malformed_lists"]), ({"tables": [TABLE | {"hasHeaders": False}]}, "fail", ["tables_without_headers"]),
]


def test_pdf_conformance(spark):
    rows = {r.doc_id: (r.status, [f.issue for f in r.failures]) for r in S.pdf_conformance(frame(spark, schemas.PDF, [BASE | d for d, _, _ in GATES])).collect()}
    assert [rows[i] for i in range(len(GATES))] == [(s, f) for _, s, f in GATES]


OFFICE = {
    "docx": (DOCX, S.docx_categories, [({}, "heading_structure", 100), ({"headings": [2, 4], "fakeHeadings": 1}, "heading_structure", 55), ({"headings": [], "fakeHeadings": 2}, "heading_structure", 30), ({"headings": []}, "heading_structure", None), ({"images": [dict(altText="a", decorative=False)] * 9 + [dict(altText=None, decorative=False)]}, "alt_text", 85), ({"tables": [dict(hasHeaderRow=False, rowCount=2, colCount=2, nested=False, layout=False), dict(hasHeaderRow=True, rowCount=2, colCount=2, nested=True, layout=False)]}, "table_markup", 45), ({"contrast": dict(checked=10, unresolved=0, failing=[dict(ratio=2.0)])}, "color_contrast", 85), ({"contrast": dict(checked=0, unresolved=1, failing=[])}, "color_contrast", "?"), ({"realItems": 1, "manualItems": 3}, "list_structure", 25)]),
    "pptx": (PPTX, S.pptx_categories, [({}, "slide_titles", 100), ({"slides": [dict(title="A", hidden=False, titleFirst=True), dict(title="a", hidden=False, titleFirst=False)]}, "slide_titles", 100), ({"slides": [dict(title="A", hidden=False, titleFirst=True)] * 2}, "slide_titles", 90), ({"slides": [dict(title="A", hidden=True, titleFirst=True)]}, "slide_titles", 100), ({"slides": []}, "slide_titles", None), ({"slides": [dict(title="A", hidden=False, titleFirst=False), dict(title=None, hidden=False, titleFirst=False)]}, "slide_titles", 50), ({"slides": [dict(title="A", hidden=False, titleFirst=False)]}, "reading_order", 85)]),
    "xlsx": (XLSX, S.xlsx_categories, [({}, "sheet_names", 100), ({"sheets": [dict(name="Sheet1", hidden=False, cells=20, hasTable=False, hasPivot=False)]}, "sheet_names", 40), ({"sheets": [dict(name="X", hidden=False, cells=20, hasTable=False, hasPivot=False)]}, "table_markup", 60), ({"valuedCells": 0}, "text_extractability", "?"), ({"tables": [], "sheets": [dict(name="X", hidden=False, cells=40, hasTable=False, hasPivot=True)]}, "table_markup", 100), ({"tables": [], "sheets": [dict(name="X", hidden=True, cells=40, hasTable=False, hasPivot=False)]}, "table_markup", 100), ({"tables": [], "sheets": [dict(name="X", hidden=False, cells=11, hasTable=False, hasPivot=False)]}, "table_markup", None), ({"links": [dict(text="here", resolved=False)]}, "link_quality", "?")]),
}


@pytest.mark.parametrize("kind", OFFICE)
def test_office_scores(spark, kind):
    base, score, cases = OFFICE[kind]
    got = scores(score(frame(spark, getattr(schemas, kind.upper()), [base | d for d, _, _ in cases])))
    assert [(d, i, got[n][i]) for n, (d, i, _) in enumerate(cases)] == cases


def test_office_conformance(spark):
    docx = {r.doc_id: (r.status, len(r.failures)) for r in S.docx_conformance(frame(spark, schemas.DOCX, [DOCX, DOCX | {"title": None, "coreOk": False}, DOCX | {"title": None}, DOCX | {"documentOk": False}])).collect()}
    assert docx == {0: ("no-automated-failures", 0), 1: ("no-automated-failures", 0), 2: ("fail", 1), 3: ("incomplete", 0)}
    assert S.pptx_conformance(frame(spark, schemas.PPTX, [PPTX | {"language": None}])).first().status == "fail"
    assert S.xlsx_conformance(frame(spark, schemas.XLSX, [XLSX])).where(F.size("failures") > 0).count() == 0
