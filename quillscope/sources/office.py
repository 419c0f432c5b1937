"""Structure of DOCX, PPTX and XLSX packages: a small reader of zipped XML that
runs over binary files in Arrow batches. A file that can't be read gives a row
with its error, never a failed task."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES, MOST_TOTAL, MOST_PART = 10_000, 512 << 20, 30 << 20
_HEADING = re.compile(r"(?i)^heading\s*([1-6])$")
_MAIN = {"docx": "word/document.xml", "pptx": "ppt/presentation.xml", "xlsx": "xl/workbook.xml"}


def _name(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _attr(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _find(node, name: str):
    return next((x for x in node.iter() if _name(x) == name), None)


def _text(node) -> str:
    return "".join(x.text or "" for x in node.iter() if _name(x) == "t")


class Package:
    """Parts of one package, read within the limits."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        entries = self.zip.infolist()
        if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_TOTAL:
            raise ValueError("package too large")
        self.sizes = {e.filename: e.file_size for e in entries}

    def kind(self) -> str | None:
        return next((k for k, main in _MAIN.items() if main in self.sizes and "[Content_Types].xml" in self.sizes), None)

    def part(self, name: str):
        if name not in self.sizes:
            return None
        if self.sizes[name] > MOST_PART:
            raise ValueError(f"{name} too large")
        return ElementTree.fromstring(self.zip.read(name))

    def core(self) -> tuple[str | None, str | None]:
        core = self.part("docProps/core.xml")
        values = {_name(x): (x.text or "").strip() or None for x in core} if core is not None else {}
        return values.get("title"), values.get("language")


def _images(root) -> list[dict]:
    found = []
    for x in root.iter():
        if _name(x) in ("docPr", "cNvPr") and (_attr(x, "descr") is not None or _name(x) == "docPr"):
            mark = _find(x, "decorative")
            found.append({"alt": (_attr(x, "descr") or "").strip() or None, "decorative": mark is not None and _attr(mark, "val") in ("1", "true")})
    return found


def read_docx(p: Package) -> dict:
    root, styles = p.part(_MAIN["docx"]), p.part("word/styles.xml")
    levels, based, language = {}, {}, None
    for s in styles.iter() if styles is not None else ():
        if _name(s) == "style":
            id_, label, over = _attr(s, "styleId"), _find(s, "name"), _find(s, "basedOn")
            hit = _HEADING.match((_attr(label, "val") or "") if label is not None else "") or _HEADING.match(id_ or "")
            if hit:
                levels[id_] = int(hit[1])
            if over is not None:
                based[id_] = _attr(over, "val")
        if _name(s) == "lang" and language is None:
            language = _attr(s, "val")

    def level(style: str | None) -> int | None:
        for _ in range(8):
            if style in levels or style is None:
                break
            style = based.get(style)
        return levels.get(style)

    headings, manual, real = [], 0, 0
    for para in (x for x in root.iter() if _name(x) == "p"):
        style, text = _find(para, "pStyle"), _text(para)
        of = level(_attr(style, "val") if style is not None else None)
        if of and text.strip():
            headings.append(of)
        elif _find(para, "numPr") is not None:
            real += 1
        elif re.match(r"\s*([•‣◦⁃∙*-]|\d+[.)])\s+", text):
            manual += 1
    tables = []
    for t in (x for x in root.iter() if _name(x) == "tbl"):
        rows = [x for x in t if _name(x) == "tr"]
        head = _find(rows[0], "tblHeader") if rows else None
        nested = sum(_name(x) == "tbl" for x in t.iter()) > 1
        tables.append({"header": head is not None and (_attr(head, "val") or "true") not in ("0", "false", "off"), "nested": nested, "rows": len(rows), "columns": max((sum(_name(c) == "tc" for c in r) for r in rows), default=0)})
    links = [_text(x) for x in root.iter() if _name(x) == "hyperlink"]
    title, core_language = p.core()
    return {"title": title, "language": language or core_language, "headings": headings, "images": _images(root), "tables": tables, "links": links, "real": real, "manual": manual, "names": []}


def _slides(p: Package) -> list[str]:
    """Slide parts in the order of the presentation, as its relationships name
    them; by their numbers where it lists none."""
    links, book = p.part("ppt/_rels/presentation.xml.rels"), p.part(_MAIN["pptx"])
    targets = {} if links is None else {x.get("Id"): "ppt/" + re.sub(r"^(/ppt/|\.?/)", "", x.get("Target") or "") for x in links}
    named = [next((v for k, v in x.attrib.items() if k.startswith("{") and k.endswith("}id")), None) for x in book.iter() if _name(x) == "sldId"]
    found = [targets[i] for i in named if targets.get(i) in p.sizes]
    numbered = (n for n in p.sizes if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
    return found or sorted(numbered, key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))


def _title_first(root) -> bool | None:
    """Whether the first shape with content is the title; unknown without any."""
    tree = _find(root, "spTree")
    for shape in root if tree is None else tree:
        kind, mark = _name(shape), _find(shape, "decorative")
        if kind == "sp" and _text(shape).strip():
            ph = _find(shape, "ph")
            return ph is not None and _attr(ph, "type") in ("title", "ctrTitle")
        if kind == "graphicFrame" or (kind == "pic" and not (mark is not None and _attr(mark, "val") in ("1", "true"))):
            return False
    return None


def read_pptx(p: Package) -> dict:
    title, language = p.core()
    out = {"title": title, "language": language, "headings": [], "images": [], "tables": [], "links": [], "real": 0, "manual": 0, "names": []}
    out |= {"slides": [], "media": any(re.fullmatch(r"(?i)ppt/media/.*\.(mp4|m4v|mov|avi|wmv|mpg|mp3|m4a|wav|wma)", n) for n in p.sizes)}
    for n in _slides(p):
        root, heading = p.part(n), None
        out["slides"].append({"hidden": _attr(root, "show") in ("0", "false"), "titleFirst": _title_first(root)})
        for shape in (x for x in root.iter() if _name(x) == "sp"):
            ph = _find(shape, "ph")
            if ph is not None and _attr(ph, "type") in ("title", "ctrTitle"):
                heading = _text(shape).strip() or None
        out["names"].append(heading or "")
        out["images"] += [i for x in root.iter() if _name(x) == "pic" for i in _images(x)]
        for t in (x for x in root.iter() if _name(x) == "tbl"):
            head = _find(t, "tblPr")
            out["tables"].append({"header": head is not None and _attr(head, "firstRow") in ("1", "true"), "rows": sum(_name(x) == "tr" for x in t), "columns": sum(_name(x) == "gridCol" for x in t.iter())})
        out["links"] += [_text(r) for r in root.iter() if _name(r) == "r" and _find(r, "hlinkClick") is not None]
        lang = next((_attr(x, "lang") for x in root.iter() if _name(x) == "rPr" and _attr(x, "lang")), None)
        out["language"] = out["language"] or lang
    return out


def read_xlsx(p: Package) -> dict:
    title, language = p.core()
    book = p.part(_MAIN["xlsx"])
    names = [_attr(x, "name") or "" for x in book.iter() if _name(x) == "sheet" and _attr(x, "state") not in ("hidden", "veryHidden")]
    tables = []
    for n in sorted(x for x in p.sizes if re.fullmatch(r"xl/tables/table\d+\.xml", x)):
        root = p.part(n)
        tables.append({"header": _attr(root, "headerRowCount") != "0", "rows": None, "columns": sum(_name(x) == "tableColumn" for x in root.iter())})
    images = [i for n in sorted(p.sizes) if re.fullmatch(r"xl/drawings/drawing\d+\.xml", n) for i in _images(p.part(n))]
    return {"title": title, "language": language, "headings": [], "images": images, "tables": tables, "links": [], "real": 0, "manual": 0, "names": names}


_READ = {"docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx}
_TYPE = pa.struct([
    ("title", pa.string()), ("language", pa.string()), ("headings", pa.list_(pa.int32())), ("images", pa.list_(pa.struct([("alt", pa.string()), ("decorative", pa.bool_())]))),
    ("tables", pa.list_(pa.struct([("header", pa.bool_()), ("rows", pa.int32()), ("columns", pa.int32()), ("nested", pa.bool_())]))), ("links", pa.list_(pa.string())), ("real", pa.int32()), ("manual", pa.int32()), ("names", pa.list_(pa.string())),
    ("slides", pa.list_(pa.struct([("hidden", pa.bool_()), ("titleFirst", pa.bool_())]))), ("media", pa.bool_()),
])
_SQL = "struct<title:string,language:string,headings:array<int>,images:array<struct<alt:string,decorative:boolean>>,tables:array<struct<header:boolean,rows:int,columns:int,nested:boolean>>,links:array<string>,real:int,manual:int,names:array<string>,slides:array<struct<hidden:boolean,titleFirst:boolean>>,media:boolean>"


def office_records(files: DataFrame) -> DataFrame:
    """(path, content) to (path, kind, error, record) of office packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("error", pa.string()), ("record", _TYPE)])
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                kind = None
                try:
                    package = Package(content or b"")
                    kind = package.kind()
                    rows.append((path, kind, None if kind else "not an office package", _READ[kind](package) if kind else None))
                except Exception as e:
                    rows.append((path, kind, f"{type(e).__name__}: {e}"[:300], None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", "content").mapInArrow(run, f"path string, kind string, error string, record {_SQL}")


_NO_CONTRAST = "CAST(NULL AS struct<checked:int,unresolved:int,failing:array<struct<ratio:double>>>)"


def _unknown(kind: str) -> Column:
    """A fact that the reader doesn't look for."""
    return F.lit(None).cast(kind)


def _common(records: DataFrame, kind: str) -> tuple[DataFrame, dict[str, Column]]:
    rows = records.where(F.col("kind") == kind)
    r = F.col("record")
    images = F.transform(r["images"], lambda i: F.struct(i["alt"].alias("altText"), i["decorative"].alias("decorative")))
    links = F.transform(r["links"], lambda t: F.struct(t.alias("text"), F.lit(True).alias("resolved")))
    return rows, {"title": r["title"], "language": r["language"], "images": images, "links": links, "contrast": F.expr(_NO_CONTRAST), "realItems": r["real"], "manualItems": r["manual"]}


def docx_analysis(records: DataFrame) -> DataFrame:
    """Records of ``office_records`` as ``schemas.DOCX`` rows, keyed by path: a
    file that couldn't be read isn't ok; what the reader doesn't look for (headings
    that only look so, layout tables, contrast) is null."""
    rows, common = _common(records, "docx")
    r = F.col("record")
    tables = F.transform(r["tables"], lambda t: F.struct(t["header"].alias("hasHeaderRow"), t["rows"].alias("rowCount"), t["columns"].alias("colCount"), t["nested"].alias("nested"), _unknown("boolean").alias("layout")))
    ok = F.col("error").isNull()
    own = {"documentOk": ok, "stylesOk": ok, "coreOk": ok, "headings": r["headings"], "fakeHeadings": _unknown("int"), "tables": tables}
    return rows.select(F.col("path").alias("doc_id"), *(v.alias(k) for k, v in (common | own).items()))


def pptx_analysis(records: DataFrame) -> DataFrame:
    """The same as ``schemas.PPTX``."""
    rows, common = _common(records, "pptx")
    r = F.col("record")
    slides = F.zip_with(r["names"], r["slides"], lambda n, s: F.struct(F.nullif(n, F.lit("")).alias("title"), s["hidden"].alias("hidden"), s["titleFirst"].alias("titleFirst")))
    tables = F.transform(r["tables"], lambda t: F.struct(t["header"].alias("hasHeaderRow"), t["rows"].alias("rowCount"), t["columns"].alias("colCount")))
    return rows.select(F.col("path").alias("doc_id"), *(v.alias(k) for k, v in (common | {"slides": slides, "tables": tables, "hasMedia": r["media"]}).items()))


def xlsx_analysis(records: DataFrame) -> DataFrame:
    """The same as ``schemas.XLSX``; cells, tables and pivots of a sheet aren't
    looked for, so they stay unknown."""
    rows, common = _common(records, "xlsx")
    r = F.col("record")
    sheets = F.transform(r["names"], lambda n: F.struct(n.alias("name"), F.lit(False).alias("hidden"), _unknown("int").alias("cells"), _unknown("boolean").alias("hasTable"), _unknown("boolean").alias("hasPivot")))
    tables = F.transform(r["tables"], lambda t: F.struct(t["header"].alias("hasHeaderRow"), t["columns"].alias("columnCount")))
    return rows.select(F.col("path").alias("doc_id"), *(v.alias(k) for k, v in (common | {"sheets": sheets, "tables": tables, "valuedCells": F.lit(None).cast("int")}).items()))
