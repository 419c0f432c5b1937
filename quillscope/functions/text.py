"""Text classifiers and escapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import ALT_DECORATIVE, ALT_FILE, ALT_FILE_END, ALT_ORNAMENT, ALT_PLACEHOLDER, TITLE_DATED, TITLE_FILE_END, TITLE_NUMBERED, TITLE_TOOL, VAGUE_LINKS
from .urls import safe_http

#: White space as scripts on the web trim it.
SPACE = r"[\s\x0B\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def classify_link(text: Column) -> Column:
    """descriptive, rawUrl or needsFix; a null text is an empty one."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    core = F.regexp_replace(t, r"[.!?:;\s]+$", "")
    short = F.length(F.regexp_replace(t, "[^a-z0-9]", "")) <= 2
    return F.when(t == "", "needsFix").when(t.rlike(r"^(https?://|www\.)"), "rawUrl").when(core.isin(*VAGUE_LINKS) | short, "needsFix").otherwise("descriptive")


def filename_like(title: Column) -> Column:
    """Whether a title looks like a file's or a tool's name."""
    t = strip(F.coalesce(title, F.lit("")))
    unspaced = ~t.rlike(r"\s") & (t.contains("_") | (F.regexp_count(t, F.lit("-")) >= 2) | ((F.length(t) >= 20) & t.rlike(r"\d")))
    return (t != "") & (t.rlike(TITLE_FILE_END) | t.rlike(TITLE_TOOL) | t.rlike(TITLE_DATED) | t.rlike(TITLE_NUMBERED) | unspaced)


def suspicious_alt(text: Column) -> Column:
    """Why an alternative text is suspicious, as a short code; null if it isn't."""
    t = strip(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(t, "^b:", "")
    foreign = F.length(F.regexp_replace(t, r"[\x20-\x7E]", ""))
    return (
        F.when(t == "", None)
        .when(t.rlike(ALT_DECORATIVE) | t.rlike(ALT_ORNAMENT), "decorative")
        .when((F.length(bare) > 20) & bare.rlike("^[0-9a-fA-F]+$"), "hex")
        .when((F.length(t) > 30) & ~t.contains(" "), "no_spaces")
        .when((F.length(t) > 5) & (foreign / F.length(t) > 0.5), "non_ascii")
        .when(t.rlike(ALT_FILE) & t.rlike(ALT_FILE_END), "filename")
        .when(t.rlike(ALT_PLACEHOLDER), "placeholder")
    )


def manual_bullet(text: Column) -> Column:
    """Whether a paragraph starts with a typed bullet or number."""
    return F.coalesce(text.rlike(r"^\s*([•‣◦⁃∙*-]|\d+[.)])\s+"), F.lit(False))


def csv_field(value: Column) -> Column:
    """A CSV field that no spreadsheet takes for a formula; null is empty."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    v = F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)
    return F.when(v.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def shorten(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def strip_subset(font: Column) -> Column:
    return F.regexp_replace(font, r"^[A-Z]{6}\+", "")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def first_version(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\d+\.\d+(\.\d+)?", 0), F.lit(""))


def percent_encode(text: Column) -> Column:
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def stored_filename(name: Column) -> Column:
    """A file's name as one safe line of at most 255 characters."""
    line = F.regexp_replace(name, SPACE, " ")
    base = F.substring(F.regexp_extract(F.regexp_replace(line, "/+$", ""), "([^/]*)$", 1), 1, 255)
    clean = strip(F.regexp_replace(base, r"[^a-zA-Z0-9._ \-]", "_"))
    return F.when(clean == "", "unnamed_file").otherwise(clean)


def sentences(text: Column) -> Column:
    """Sentences of a text: a mark, closing quotes and blanks end one where a
    capital, digit or opening quote follows."""
    # the split point follows blanks, so a sentence keeps its own marks
    cut = F.regexp_replace(strip(text), "([.!?][\"'”’)\\]]*)\\s+(?=[A-Z0-9“\"‘(])", "$1\u0001")
    return F.filter(F.transform(F.split(cut, "\u0001"), strip), lambda s: s != "")


def uptime(seconds: Column) -> Column:
    part = lambda x: F.floor(x).cast("string")
    d, h, m, s = part(seconds / 86400), part(seconds % 86400 / 3600), part(seconds % 3600 / 60), (seconds % 60).cast("string")
    short = F.concat(m, F.lit("m "), s, F.lit("s"))
    return F.when(seconds >= 86400, F.concat(d, F.lit("d "), h, F.lit("h "), short)).when(seconds % 86400 >= 3600, F.concat(h, F.lit("h "), short)).otherwise(short)


def file_size(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30), ("TB", 1 << 40)):
        out = F.when(n >= size, F.concat(F.format_string("%.1f", n / size), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_uptime(seconds: Column) -> Column:
    """Minutes, then hours and minutes, from two days on days and hours."""
    m = F.floor(seconds / 60)
    h = F.floor(m / 60)
    two = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(f" {x} "), b.cast("string"), F.lit(f" {y}"))
    one = lambda a, x: F.concat(a.cast("string"), F.lit(f" {x}"))
    return F.when(seconds < 60, one(F.floor(seconds), "s")).when(m < 60, one(m, "m")).when(h < 48, two(h, "h", m % 60, "m")).otherwise(two(F.floor(h / 24), "d", h % 24, "h"))


def clamped(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def heading_outline(headings: Column, most: int = 40) -> Column:
    """Lines of an outline of headings (level, text): its title, an indented line
    each, and how many more there are."""
    lines = F.transform(F.slice(headings, 1, most), lambda h: F.concat(F.lit("  H"), h["level"].cast("string"), F.lit(' "'), shorten(h["text"]), F.lit('"')))
    more = F.concat(F.lit("  ... and "), (F.size(headings) - most).cast("string"), F.lit(" more heading(s)"))
    return F.concat(F.array(F.lit("--- Heading Outline ---")), lines, F.when(F.size(headings) > most, F.array(more)).otherwise(F.array().cast("array<string>")))


def camel_words(text: Column) -> Column:
    """A camel-case name as words, the first with a capital."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "([A-Z])", " $1")
    return F.trim(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 20)))


def markdown_link(label: Column, url: Column) -> Column:
    return F.when(safe_http(url), F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")"))).otherwise(label)


def ua_part(packet: Column) -> Column:
    """The part of PDF/UA that an XMP packet declares, as attribute or element."""
    attribute = F.regexp_extract(packet, "(?i)pdfuaid:part\\s*=\\s*[\"']\\s*(\\d+)\\s*[\"']", 1)
    element = F.regexp_extract(packet, "(?i)<pdfuaid:part[^>]*>\\s*(\\d+)\\s*<", 1)
    return F.coalesce(F.nullif(attribute, F.lit("")), F.nullif(element, F.lit("")))


def made_by_indesign(creator: Column) -> Column:
    return F.coalesce(creator.rlike("(?i)indesign"), F.lit(False))


def source_program(file_type: Column, creator: Column) -> Column:
    """The program in which a document is best mended, as a short code."""
    office = F.when(file_type == "docx", "word").when(file_type == "pptx", "powerpoint").when(file_type == "xlsx", "excel")
    return F.coalesce(office, F.when(made_by_indesign(creator), "indesign").when(creator.rlike(r"(?i)\bword\b"), "word_recorded").otherwise("word_assumed"))


def type_label(file_type: Column) -> Column:
    return F.when(file_type == "docx", "Word").when(file_type == "pptx", "PowerPoint").when(file_type == "xlsx", "Excel").otherwise("PDF")


def page_noun(file_type: Column) -> Column:
    return F.when(file_type == "pptx", "slide").when(file_type == "xlsx", "sheet").otherwise("page")


def banner(pages: Column, file_type: Column) -> Column:
    return F.concat(pages.cast("string"), F.lit(" "), page_noun(file_type), F.when(pages == 1, "").otherwise("s"), F.lit(" · "), type_label(file_type))


def why_blank(category: Column, not_assessed: Column) -> Column:
    """Why a category has no score, as a short code."""
    always = category.isin("reading_order", "color_contrast", "bookmarks")
    none = category.isin("table_markup", "link_quality", "form_accessibility")
    unknown = F.coalesce(not_assessed, F.lit(False))
    return (
        F.when(always, F.concat(category, F.lit(":check_yourself")))
        .when(category == "alt_text", F.when(unknown, "alt_text:untagged_images").otherwise("alt_text:none_found"))
        .when(none, F.concat(category, F.lit(":none_found")))
        .otherwise(F.when(unknown, "not_assessed").otherwise("does_not_apply"))
    )


def guidance(finding: Column) -> Column:
    """Whether a finding is advice rather than a fact."""
    return F.coalesce(F.lower(finding).rlike("^(how to fix:|tip:|fix:|note:|review these)"), F.lit(False))


def first_actionable(findings: Column) -> Column:
    """The first finding that is a fact, else the first at all, else empty."""
    facts = F.filter(findings, lambda f: (f != "") & ~f.startswith("---") & ~f.startswith("  ") & ~guidance(f))
    present = F.filter(findings, lambda f: f.isNotNull())
    return F.coalesce(F.get(facts, F.lit(0)), F.get(present, F.lit(0)), F.lit(""))


def report_filename(filename: Column, day: Column) -> Column:
    """Name of an exported report, without its extension."""
    return F.concat(F.regexp_replace(filename, r"(?i)\.(pdf|docx|pptx|xlsx)$", ""), F.lit("-accessibility-report-"), F.date_format(day, "yyyy-MM-dd"))
