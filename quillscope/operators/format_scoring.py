"""Category scores and conformance gates of PDF, DOCX, PPTX and XLSX records,
as column expressions over one row a document: no shuffle, no UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import FORM_CRITERIA, LEVEL_AA, NEVER_ASSESSED, QUICKREF, UNDERSTANDING, UNDERSTANDING_BASE
from ..functions.numbers import half_up
from ..functions.text import classify_link, filename_like, strip, strip_subset
from .web_scoring import heading_jumps

c = F.col
#: Fixed value: names that spreadsheets give to new sheets.
DEFAULT_SHEET = r"(?i)^(sheet|hoja|feuil|tabelle|foglio|planilha|blad|ark|taul|arkusz|munkalap|list|лист) ?\d+( \(\d+\))?$"


def count(array: Column | str, test: Callable[[Column], Column] | None = None) -> Column:
    array = c(array) if isinstance(array, str) else array
    array = F.filter(array, lambda x: F.coalesce(test(x), F.lit(False))) if test else array
    return F.coalesce(F.when(array.isNotNull(), F.size(array)), F.lit(0))


def filled(text: Column) -> Column:
    return F.coalesce(strip(text) != "", F.lit(False))


def yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def share(part: Column, whole: Column) -> Column:
    return half_up(100 * part / whole)


def category(ord_: int, id_: str, weight: float, score: Column, unknown: Column | bool = False) -> Column:
    unknown = F.lit(unknown) if isinstance(unknown, bool) else unknown
    score = score.cast("int")
    return F.struct(F.lit(ord_).alias("ord"), F.lit(id_).alias("id"), F.lit(float(weight)).alias("weight"), score.alias("score"), (score.isNull() & unknown).alias("not_assessed"))


def _null() -> Column:
    return F.lit(None).cast("int")


def explode(records: DataFrame, categories: list[Column]) -> DataFrame:
    return records.select("doc_id", F.inline(F.array(*categories)))


# PDF


def content_free() -> Column:
    """A structure tree that refers to nothing, though the pages have text; an
    absent list is unknown, which is not the same as empty."""
    empty = lambda x: yes(F.size(x) == 0) & c(x).isNotNull()
    nothing = empty("headings") & empty("images") & empty("tables") & empty("lists") & ~F.coalesce("hasContentOrder", F.lit(True))
    return yes(c("hasStructTree")) & yes(c("textLength") > 0) & yes(c("paragraphCount") == 0) & nothing


def untagged_images() -> Column:
    """Painted content images beyond the tagged figures; null where unknown."""
    return F.when(c("error").isNull() & c("nonArtifactImageCount").isNotNull(), F.greatest(F.lit(0), c("nonArtifactImageCount") - count("images", lambda i: i["ref"].isNotNull())))


def bad_fonts() -> Column:
    """Fonts that aren't embedded and show text; all where the census is missing."""
    seen = F.transform("visibleFonts", strip_subset)
    return count("fonts", lambda f: ~f["embedded"] & (c("visibleFonts").isNull() | F.array_contains(seen, strip_subset(f["name"]))))


def pdf_text() -> Column:
    tree, text = yes(c("hasStructTree")), yes(c("hasText"))
    base = F.when(~F.coalesce("accessibilityAllowed", F.lit(True)), 0).when(text & tree & content_free(), 50).when(text & tree, 100).when(text, 50).when(tree, 25).otherwise(0)
    return F.when(bad_fonts() > 0, F.least(base, F.lit(85))).otherwise(base)


def pdf_title_language() -> Column:
    title = F.when(~filled(c("title")), 0).when(filename_like(c("title")), 25).when(~yes(c("displayDocTitle")), 35).otherwise(50)
    return title + F.when(yes(c("hasLang")) | filled(c("lang")), 50).otherwise(0)


def pdf_headings() -> Column:
    numbered = F.filter("headings", lambda h: h.rlike("^H[1-6]$"))
    levels = F.transform(numbered, lambda h: F.substring(h, 2, 1).cast("int"))
    substantive = yes(c("totalPageCount") >= 4) | yes(c("paragraphCount") >= 20) | yes(c("outlineCount") > 0)
    return F.when(count("headings") == 0, F.when(substantive, 0)).when(count(numbered) == 0, 40).when(heading_jumps(levels) > 0, 60).otherwise(100)


def pdf_alt() -> Column:
    figures = count("images", lambda i: i["ref"].isNotNull())
    with_alt = count("images", lambda i: i["ref"].isNotNull() & i["hasAlt"])
    loose = untagged_images()
    scored = F.when(with_alt == 0, 0).otherwise(F.floor(with_alt / (figures + F.coalesce(loose, F.lit(0))) * 100))
    return F.when(figures > 0, scored).when(yes(loose > 0), 0)


def pdf_tables() -> Column:
    data = F.filter("tables", lambda t: F.coalesce(F.try_element_at(t["columnCounts"], F.lit(1)), F.lit(2)) >= 2)
    n = count(data)
    tied = lambda t: yes(t["hasScope"]) | yes(t["hasHeaderAssociation"])
    heads, rows = count(data, lambda t: t["hasHeaders"]), count(data, lambda t: t["hasRowStructure"])
    bound, any_bound = count(data, lambda t: t["hasHeaders"] & tied(t)), count(data, tied)
    checkable, even = count(data, lambda t: t["hasConsistentColumns"].isNotNull()), count(data, lambda t: t["hasConsistentColumns"])
    part = lambda x, full, some: F.when(x == n, full).when(x > 0, some).otherwise(0)
    total = part(heads, 40, 20) + part(rows, 20, 10)
    total += F.when((heads > 0) & (bound == heads), 10).when(bound > 0, 5).otherwise(0)
    total += F.when(count(data, lambda t: t["hasNestedTable"]) == 0, 10).otherwise(0) + 5
    total += F.when((checkable > 0) & (even == checkable), 10).otherwise(0) + F.when(any_bound > 0, 5).otherwise(0)
    return F.when(n > 0, total)


def pdf_links() -> Column:
    n = count("links")
    known = yes(c("hasStructTree")) & (count("links", lambda x: x["tagged"].isNotNull()) > 0)
    loose = count("links", lambda x: known & (x["tagged"] == False))  # noqa: E712
    needs = count("links", lambda x: (~known | ~x["tagged"].eqNullSafe(False)) & (classify_link(x["text"]) == "needsFix"))
    return F.when(n > 0, F.floor((n - needs - loose) / n * 100))


def pdf_categories(records: DataFrame, order_score: Column | None = None) -> DataFrame:
    """Ten categories of each record. ``order_score``: the fidelity of its
    reading order, where that could be compared."""
    order = order_score if order_score is not None else _null()
    order = F.when(~yes(c("hasStructTree")), 0).when(yes(c("structTreeDepth") <= 1), 30).otherwise(order)
    marks = F.when(c("pageCount") >= 10, F.when(yes(c("outlineCount") > 0), 100).when(yes(c("hasOutlines")), 40).otherwise(45))
    fields = F.when(yes(c("hasAcroForm")) & (count("formFields") > 0), F.floor(count("formFields", lambda f: f["hasTU"]) / count("formFields") * 100))
    return explode(records, [
        category(1, "text_extractability", 0.2, pdf_text()), category(2, "title_language", 0.15, pdf_title_language()), category(3, "heading_structure", 0.15, pdf_headings()),
        category(4, "alt_text", 0.15, pdf_alt()), category(5, "color_contrast", 0, _null(), True), category(6, "bookmarks", 0.05, marks), category(7, "table_markup", 0.1, pdf_tables()),
        category(8, "link_quality", 0.05, pdf_links()), category(9, "form_accessibility", 0.05, fields), category(10, "reading_order", 0.1, order, True),
    ])


def scanned_pdf() -> Column:
    return c("error").isNull() & yes(c("textLength") == 0) & (yes(c("imageCount") > 0) | yes(c("imageObjectCount") > 0)) & ~yes(c("hasStructTree"))


# Office


def images_score(capped_at: int = 85) -> Column:
    real = F.filter("images", lambda i: ~yes(i["decorative"]))
    n, good = count(real), count(real, lambda i: filled(i["altText"]))
    pct = share(good, n)
    return F.when(n > 0, F.when(good < n, F.least(pct, F.lit(capped_at))).otherwise(pct))


def links_score(array: Column | str = "links") -> Column:
    n = count(array)
    return F.when(n > 0, share(n - count(array, lambda x: classify_link(x["text"]) == "needsFix"), n))


def contrast_score() -> Column:
    n, bad = F.coalesce("contrast.checked", F.lit(0)), count("contrast.failing")
    return F.when(n > 0, F.when(bad > 0, F.least(share(n - bad, n), F.lit(85))).otherwise(100))


def contrast_unknown() -> Column:
    return yes(c("contrast.unresolved") > 0)


def lists_score() -> Column:
    real, manual = F.coalesce("realItems", F.lit(0)), F.coalesce("manualItems", F.lit(0))
    pct = share(real, real + manual)
    return F.when(real + manual > 0, F.when(manual > 0, F.least(pct, F.lit(85))).otherwise(pct))


def title_language() -> Column:
    return F.when(filled(c("title")), 50).otherwise(0) + F.when(filled(c("language")), 50).otherwise(0)


def tables_score(of_each: Callable[[Column], Column]) -> Column:
    n = count("tables")
    return F.when(n > 0, half_up(F.aggregate("tables", F.lit(0.0), lambda acc, t: acc + of_each(t)) / n))


def docx_categories(records: DataFrame) -> DataFrame:
    heads, fakes = count("headings"), F.coalesce("fakeHeadings", F.lit(0))
    first = F.when((heads > 0) & (F.try_element_at("headings", F.lit(1)) != 1), 15).otherwise(0)
    skips = F.when(heads > 0, F.least(F.lit(30), 15 * heading_jumps(c("headings")))).otherwise(0)
    fake = F.when(fakes == 0, 0).when(heads == 0, 70).otherwise(F.least(F.lit(40), 15 * fakes))
    heading = F.when((heads > 0) | (fakes > 0), F.greatest(F.lit(0), 100 - first - skips - fake))

    def table_(t: Column) -> Column:
        base = F.when(~yes(t["hasHeaderRow"]) & (t["rowCount"] >= 2) & (t["colCount"] >= 2) & ~yes(t["layout"]), 30).otherwise(100)
        return F.when(yes(t["nested"]), F.least(base, F.lit(60))).otherwise(base)

    return explode(records, [
        category(1, "text_extractability", 0.05, F.lit(100)), category(2, "title_language", 0.18, title_language()), category(3, "heading_structure", 0.18, heading), category(4, "alt_text", 0.18, images_score()),
        category(5, "table_markup", 0.12, tables_score(table_)), category(6, "link_quality", 0.08, links_score()), category(7, "color_contrast", 0.12, contrast_score(), contrast_unknown()),
        category(8, "list_structure", 0.09, lists_score()), category(9, "reading_order", 0, _null(), True), category(10, "form_accessibility", 0, _null(), True),
    ])


def pptx_categories(records: DataFrame) -> DataFrame:
    shown = F.filter("slides", lambda s: ~yes(s["hidden"]))
    titled = F.filter(shown, lambda s: yes(s["title"] != ""))
    n, named = count(shown), count(titled)
    # titles count as they are: another case is another title
    titles = F.transform(titled, lambda s: s["title"])
    twice = count(F.filter(F.array_distinct(titles), lambda t: F.size(F.filter(titles, lambda u: u == t)) > 1))
    base = F.when(named < n, F.greatest(F.lit(40), F.least(F.lit(85), share(named, n)))).otherwise(100)
    slide = F.when(count("slides") > 0, F.greatest(F.lit(0), base - F.least(F.lit(30), 10 * twice)))
    # a slide whose first shape isn't known can't be judged
    order = F.when((named > 0) & (count(titled, lambda s: s["titleFirst"].isNull()) == 0), F.greatest(F.lit(0), 100 - 15 * count(titled, lambda s: ~s["titleFirst"])))
    table_ = lambda t: F.when(~yes(t["hasHeaderRow"]) & (t["rowCount"] >= 2) & (t["colCount"] >= 2), 30).otherwise(100)
    return explode(records, [
        category(1, "text_extractability", 0.05, F.lit(100)), category(2, "title_language", 0.14, title_language()), category(3, "slide_titles", 0.18, slide), category(4, "alt_text", 0.18, images_score()),
        category(5, "reading_order", 0.1, order, True), category(6, "table_markup", 0.1, tables_score(table_)), category(7, "color_contrast", 0.1, contrast_score(), contrast_unknown()),
        category(8, "list_structure", 0.07, lists_score()), category(9, "link_quality", 0.08, links_score()), category(10, "form_accessibility", 0, _null(), True),
    ])


def xlsx_categories(records: DataFrame) -> DataFrame:
    shown = F.filter("sheets", lambda s: ~yes(s["hidden"]))
    n, plain = count(shown), count(shown, lambda s: s["name"].rlike(DEFAULT_SHEET))
    names = F.when(n > 0, F.when(plain > 0, F.greatest(F.lit(40), F.least(F.lit(85), share(n - plain, n)))).otherwise(100))
    headless = count("tables", lambda t: ~yes(t["hasHeaderRow"]))
    dataful = count(shown, lambda s: (s["cells"] >= 12) & ~yes(s["hasTable"]) & ~yes(s["hasPivot"]))
    base = F.greatest(F.lit(0), 100 - 30 * headless)
    # any sheet of some size makes tables a question, a pivot or hidden one as well
    sizable = count("sheets", lambda s: s["cells"] >= 12) > 0
    uncounted = (count("tables") == 0) & (count("sheets", lambda s: s["cells"].isNull()) > 0)
    table_ = F.when((count("tables") > 0) | sizable, F.when((count("tables") == 0) & (dataful > 0), F.least(base, F.lit(60))).otherwise(base))
    resolved = F.filter("links", lambda x: x["resolved"])
    return explode(records, [
        category(1, "text_extractability", 0.05, F.when(yes(c("valuedCells") > 0), 100), True), category(2, "title_language", 0.12, F.when(filled(c("title")), 100).otherwise(50)),
        category(3, "sheet_names", 0.18, names), category(4, "table_markup", 0.25, table_, uncounted), category(5, "alt_text", 0.18, images_score()),
        category(6, "color_contrast", 0.12, contrast_score(), contrast_unknown()), category(7, "link_quality", 0.1, links_score(resolved), count("links") > 0), category(8, "form_accessibility", 0, _null(), True),
    ])


# Conformance


def _failures(rules: list[tuple[str, str, Column]]) -> Column:
    """Struct of status and failed rules; rules are (criterion, issue, test)."""
    rows = [F.when(yes(test), F.struct(F.lit(sc).alias("criterion"), F.lit(issue).alias("issue"))) for sc, issue, test in rules]
    return F.array_compact(F.array(*rows))


def _verdict(records: DataFrame, rules: list[tuple[str, str, Column]], incomplete: Column | None = None) -> DataFrame:
    stop = yes(incomplete) if incomplete is not None else F.lit(False)
    out = records.select("doc_id", stop.alias("_stop"), _failures(rules).alias("failures"))
    status = F.when(c("_stop"), "incomplete").when(F.size("failures") > 0, "fail").otherwise("no-automated-failures")
    return out.select("doc_id", status.alias("status"), F.when(c("_stop"), F.array_except("failures", "failures")).otherwise(c("failures")).alias("failures"))


def pdf_conformance(records: DataFrame, order_score: Column | None = None) -> DataFrame:
    """Verdict of each PDF record, apart from its score; a record that couldn't
    be read, or whose form is drawn by a script, is incomplete."""
    tree = yes(c("hasStructTree"))
    headless = count("tables", lambda t: ~t["hasHeaders"] & (t["rowCount"] >= 2) & (F.coalesce(F.try_element_at(t["columnCounts"], F.lit(1)), F.lit(2)) >= 2))
    return _verdict(records, [
        ("1.1.1", "access_denied", c("accessibilityAllowed") == False),  # noqa: E712
        ("1.3.1", "no_structure", ~tree), ("1.3.1", "empty_structure", content_free()),
        ("1.1.1", "scanned", (c("textLength") == 0) & (yes(c("imageCount") > 0) | yes(c("imageObjectCount") > 0))),
        ("1.1.1", "figures_without_alt", count("images", lambda i: i["ref"].isNotNull() & ~i["hasAlt"]) > 0),
        ("1.1.1", "untagged_images", untagged_images() > 0), ("3.1.1", "no_language", ~(yes(c("hasLang")) | filled(c("lang")))), ("2.4.2", "no_title", ~filled(c("title"))),
        ("1.3.1", "malformed_lists", count("lists", lambda x: ~x["isWellFormed"]) > 0), ("1.3.1", "tables_without_headers", headless > 0),
        ("1.3.1", "untagged_links", tree & ~content_free() & (count("links", lambda x: x["tagged"] == False) > 0)),  # noqa: E712
        ("4.1.2", "unlabelled_fields", yes(c("hasAcroForm")) & (count("formFields", lambda f: ~f["hasTU"]) > 0)),
    ], c("error").isNotNull() | (yes(c("hasXfa")) & yes(c("needsRendering"))))


def _office_rules(headless: Column, language: Column | None) -> list[tuple[str, str, Column]]:
    rules = [("1.1.1", "images_without_alt", count("images", lambda i: ~yes(i["decorative"]) & ~filled(i["altText"])) > 0)]
    if language is not None:
        rules.append(("3.1.1", "no_language", language))
    rules += [("2.4.2", "no_title", ~filled(c("title"))), ("1.3.1", "tables_without_headers", headless > 0), ("1.4.3", "contrast", count("contrast.failing") > 0)]
    return rules


def docx_conformance(records: DataFrame) -> DataFrame:
    styles, core = F.coalesce("stylesOk", F.lit(True)), F.coalesce("coreOk", F.lit(True))
    headless = count("tables", lambda t: ~yes(t["hasHeaderRow"]) & (t["rowCount"] >= 2) & (t["colCount"] >= 2) & ~yes(t["layout"]))
    rules = _office_rules(headless, ~filled(c("language")) & styles & core)
    rules = [(sc, issue, test & core if issue == "no_title" else test) for sc, issue, test in rules]
    return _verdict(records, rules, ~F.coalesce("documentOk", F.lit(True)))


def pptx_conformance(records: DataFrame) -> DataFrame:
    headless = count("tables", lambda t: ~yes(t["hasHeaderRow"]) & (t["rowCount"] >= 2) & (t["colCount"] >= 2))
    return _verdict(records, _office_rules(headless, ~filled(c("language"))))


def xlsx_conformance(records: DataFrame) -> DataFrame:
    headless = count("tables", lambda t: ~yes(t["hasHeaderRow"]) & (F.coalesce(t["columnCount"], F.lit(2)) >= 2))
    return _verdict(records, _office_rules(headless, None))


def levels_of(failures: Column) -> tuple[Column, Column]:
    """How many failures are of level A and of level AA."""
    aa = F.size(F.filter(failures, lambda f: f["criterion"].isin(*LEVEL_AA)))
    return F.size(failures) - aa, aa


def breakdown(failures: Column) -> Column:
    """The failures in words, by level."""
    a, aa = levels_of(failures)
    some = lambda n, level: F.concat(n.cast("string"), F.lit(f" Level {level} failure"), F.when(n == 1, "").otherwise("s"))
    both = F.concat(a.cast("string"), F.lit(" Level A and "), aa.cast("string"), F.lit(" Level AA failures"))
    return F.when(aa == 0, some(a, "A")).when(a == 0, some(aa, "AA")).otherwise(both)


def not_assessed(kind: str, *, forms: Column | None = None, media: Column | None = None, contrast: Column | None = None, order: Column | None = None) -> Column:
    """Criteria that no check of this document decides, as (criterion, level):
    those that hold for the format, those its content adds (reading order where it
    couldn't be compared, contrast where no text was measured, forms, media),
    and the five that are never assessed."""
    rows = [F.when(yes(contrast) if contrast is not None else F.lit(kind == "pdf"), _criterion("1.4.3"))]
    if order is not None:
        rows.append(F.when(yes(order), _criterion("1.3.2")))
    if forms is not None:
        rows += [F.when(yes(forms), _criterion(sc)) for sc, _ in FORM_CRITERIA]
    if media is not None:
        rows.append(F.when(yes(media), _criterion("1.2.2")))
    rows += [_criterion(sc) for sc, _ in NEVER_ASSESSED]
    return F.array_compact(F.array(*rows))


def _criterion(sc: str) -> Column:
    return F.struct(F.lit(sc).alias("criterion"), F.lit("AA" if sc in LEVEL_AA else "A").alias("level"))


def explanation(criterion: Column) -> Column:
    """Address of the page that explains a criterion; of the overview for others."""
    names = F.create_map(*(F.lit(x) for pair in UNDERSTANDING.items() for x in pair))
    name = F.try_element_at(names, criterion)
    return F.when(name.isNotNull(), F.concat(F.lit(UNDERSTANDING_BASE), name, F.lit(".html"))).otherwise(QUICKREF)
