"""Packages made in memory, inventories, and streams driven to completion."""

import io
import zipfile

from pyspark.sql import functions as F

from quillscope.operators import lifecycle
from quillscope.sources import files, office
from quillscope.streaming import events as stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in ({"[Content_Types].xml": "<Types/>"} | parts).items():
            z.writestr(name, text)
    return out.getvalue()


def docx():
    para = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    body = para("Heading1", "One") + para("Sub", "Two") + para("Normal", "- typed") + "<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc/><w:tc/></w:tr><w:tr><w:tc/><w:tc/></w:tr></w:tbl>" + '<w:p><w:hyperlink><w:r><w:t>here</w:t></w:r></w:hyperlink></w:p>'
    styles = f'<w:styles {W}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="Heading 2"/></w:style><w:style w:styleId="Sub"><w:name w:val="Sub"/><w:basedOn w:val="H2"/></w:style><w:lang w:val="en-US"/></w:styles>'
    core = '<c:coreProperties xmlns:c="c" xmlns:dc="d"><dc:title>A title</dc:title></c:coreProperties>'
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "docProps/core.xml": core})


def test_office_records(spark):
    rows = [("a.docx", docx()), ("b.docx", b"no zip"), ("c.zip", package({"x": "y"})), ("d", None), ("e.xlsx", package({"xl/workbook.xml": '<workbook><sheets><sheet name="Sheet1"/><sheet name="H" state="hidden"/></sheets></workbook>'}))]
    got = {r.path: r for r in office.office_records(spark.createDataFrame(rows, "path string, content binary")).collect()}
    r = got["a.docx"].record
    assert (r.title, r.language, r.headings, r.links, r.manual) == ("A title", "en-US", [1, 2], ["here"], 1)
    assert [(t.header, t.rows, t.columns) for t in r.tables] == [(True, 2, 2)]
    assert got["b.docx"].error.startswith("BadZipFile") and got["c.zip"].error and got["d"].error
    assert got["e.xlsx"].kind == "xlsx" and got["e.xlsx"].record.names == ["Sheet1"]


def test_from_bytes_to_grades(spark):
    """Packages of each format, accessible and hostile ones, scored and judged."""
    from quillscope.operators import format_scoring as fs
    from quillscope.operators import scoring

    A = 'xmlns:a="a" xmlns:p="p"'
    core = '<c:coreProperties xmlns:c="c" xmlns:dc="d"><dc:title>A title</dc:title><dc:language>en-US</dc:language></c:coreProperties>'
    para = lambda style, text: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    image = lambda alt: f'<w:drawing><w:docPr id="1"{alt}/></w:drawing>'
    good = para("Heading1", "One") + para("Heading2", "Two") + image(' descr="a map"') + "<w:tbl><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc/><w:tc/></w:tr><w:tr><w:tc/><w:tc/></w:tr></w:tbl><w:p><w:hyperlink><w:r><w:t>Annual report</w:t></w:r></w:hyperlink></w:p>"
    bad = para("Heading3", "One") + para("Normal", "- typed") + image("") + "<w:tbl><w:tr><w:tc/><w:tc/></w:tr><w:tr><w:tc/><w:tc/></w:tr></w:tbl><w:p><w:hyperlink><w:r><w:t>here</w:t></w:r></w:hyperlink></w:p>"
    doc = lambda body, more: package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"} | more)
    slide = lambda title, alt: f'<p:sld {A}><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:t>{title}</a:t></p:sp><p:pic><p:cNvPr id="1"{alt}/></p:pic></p:sld>'
    deck = lambda slides, more: package({"ppt/presentation.xml": "<p:x xmlns:p='p'/>"} | {f"ppt/slides/slide{i + 1}.xml": x for i, x in enumerate(slides)} | more)
    book = lambda name, more: package({"xl/workbook.xml": f'<workbook><sheets><sheet name="{name}"/></sheets></workbook>'} | more)
    table = lambda head: {"xl/tables/table1.xml": f'<table headerRowCount="{head}"><tableColumn/><tableColumn/></table>'}
    meta = {"docProps/core.xml": core}
    files_ = [("a.docx", doc(good, meta)), ("b.docx", doc(bad, {})), ("a.pptx", deck([slide("One", ' descr="a"'), slide("Two", ' descr="b"')], meta)), ("b.pptx", deck([slide("", ' descr=""'), slide("", ' descr=""')], {})), ("a.xlsx", book("Budget", meta | table(1))), ("b.xlsx", book("Sheet1", table(0)))]
    records = office.office_records(spark.createDataFrame(files_, "path string, content binary"))
    got, verdicts = {}, {}
    for analysis, categories, gate in ((office.docx_analysis, fs.docx_categories, fs.docx_conformance), (office.pptx_analysis, fs.pptx_categories, fs.pptx_conformance), (office.xlsx_analysis, fs.xlsx_categories, fs.xlsx_conformance)):
        rows = analysis(records)
        got |= {r.doc_id: (r.overall_score, r.grade) for r in scoring.report(scoring.nest(categories(rows))).collect()}
        verdicts |= {r.doc_id: (r.status, sorted(f.criterion for f in r.failures)) for r in gate(rows).collect()}
    assert all(score >= 90 for name, (score, _) in got.items() if name[0] == "a"), got
    assert all(got[f"b.{k}"][0] <= 79 for k in ("docx", "pptx", "xlsx")) and got["b.docx"][1] == "F", got
    assert {k: v[0] for k, v in verdicts.items()} == {n: "fail" if n[0] == "b" else "no-automated-failures" for n in got}
    assert verdicts["b.docx"][1] == ["1.1.1", "1.3.1", "2.4.2", "3.1.1"]


def test_formats_by_content(spark):
    ole = bytes.fromhex("D0CF11E0A1B11AE1") + b"\0" * 600
    rows = [(1, b"{\\rtf1"), (2, ole + "WordDocument".encode("utf-16-le")), (3, ole + "Book".encode("utf-16-le")), (4, ole), (5, b"%PDF-1.7"), (6, None)]
    got = spark.createDataFrame(rows, "i int, content binary").orderBy("i").select(files.legacy_format(F.col("content")), files.is_pdf(F.col("content"))).collect()
    assert [r[0] for r in got] == ["rtf", "doc", "xls", "ole-unknown", None, None] and [r[1] for r in got] == [False, False, False, False, True, None]


def test_inventory(spark):
    lines = ['{"kind":"header","metadata":{"publicUrlBase":"https://x.gov/"}}', "", "bad", '{"path":"/a.pdf","category":"p"}', '{"path":"b.pdf","category":"q"}', '{"path":"c.pdf","category":"p","publicUrl":"https://y/c.pdf"}', '{"kind":"footer","path":"z"}']
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, value string")
    assert [r.url for r in files.inventory(df, "p").orderBy("line_no").collect()] == ["https://x.gov/a.pdf", "https://y/c.pdf"]
    assert files.inventory(df, most=1).count() == 1


def test_streams_agree_with_batch(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).alias("key"), F.col("id").alias("request_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7).alias("at"), F.concat(F.lit("h"), F.col("id") % 5).alias("content_hash"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def drive(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = drive(stream.admit(source(), 2, 100), "admitted").select("request_id", "admitted")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lifecycle.admissions(rows, 2, 100).select("request_id", "admitted").collect()))
    assert drive(stream.first_by_content(source(), "at", "1 hour"), "firsts").count() == 5
    counts = drive(stream.window_counts(source(), "at", "1 minute", "1 minute", "key"), "counts")
    assert 0 < counts.agg(F.sum("n")).first()[0] <= 60


def test_slides_in_the_order_of_the_presentation(spark):
    """Order and visibility as the package says, facts that weren't looked for null."""
    from quillscope.operators import format_scoring as fs

    title = '<sp><nvSpPr><nvPr><ph type="title"/></nvPr></nvSpPr><txBody><t>{}</t></txBody></sp>'
    text = "<sp><txBody><t>words</t></txBody></sp>"
    slide = lambda body, more="": f"<sld{more}><cSld><spTree><nvGrpSpPr/>{body}</spTree></cSld></sld>"
    links = '<Relationships><Relationship Id="r1" Target="slides/slide2.xml"/><Relationship Id="r2" Target="/ppt/slides/slide1.xml"/><Relationship Id="r3" Target="slides/slide3.xml"/></Relationships>'
    book = '<presentation xmlns:r="urn:r"><sldIdLst><sldId id="256" r:id="r1"/><sldId id="257" r:id="r2"/><sldId id="258" r:id="r3"/></sldIdLst></presentation>'
    deck = {"ppt/presentation.xml": book, "ppt/_rels/presentation.xml.rels": links, "ppt/media/a.mp4": "x", "ppt/slides/slide1.xml": slide(text + title.format("First file")), "ppt/slides/slide2.xml": slide(title.format("Second file") + text), "ppt/slides/slide3.xml": slide("", ' show="0"')}
    nested = "<document><body><tbl><tr><tc><tbl><tr><tc/></tr></tbl></tc></tr></tbl></body></document>"
    files_ = [("a.pptx", package(deck)), ("b.docx", package({"word/document.xml": nested})), ("c.xlsx", package({"xl/workbook.xml": '<workbook><sheets><sheet name="A"/></sheets></workbook>'}))]
    records = office.office_records(spark.createDataFrame(files_, "path string, content binary"))
    slides = office.pptx_analysis(records).first()
    assert [(x.title, x.hidden, x.titleFirst) for x in slides.slides] == [("Second file", False, True), ("First file", False, False), (None, True, None)] and slides.hasMedia
    words = office.docx_analysis(records).first()
    assert [(t.nested, t.layout) for t in words.tables] == [(True, None), (False, None)] and words.fakeHeadings is None
    sheets = office.xlsx_analysis(records)
    assert [(x.cells, x.hasTable) for x in sheets.first().sheets] == [(None, None)]
    assert {r.id: (r.score, r.not_assessed) for r in fs.xlsx_categories(sheets).collect()}["table_markup"] == (None, True)
