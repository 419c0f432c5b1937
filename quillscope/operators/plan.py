"""Action plans and cards made of a report's findings, as column expressions
over each category; ranking needs no shuffle where a document's rows are nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import grade_of, severity_of, severity_rank
from ..functions.text import first_actionable, made_by_indesign, strip
from ..functions.urls import safe_http
from .scoring import verdict

#: Headings of findings that call for advice of their own.
TEXT_IN_FIGURES, UNTAGGED_LINKS, STEPS_MARK = "--- Figures That Contain Text ---", "--- Links Not Tagged ---", "adobe acrobat"


def advice(category: Column, findings: Column) -> Column:
    """Which advice a category gets: its own, or that of what was found."""
    has = lambda mark: F.coalesce(F.exists(findings, lambda f: f.contains(mark)), F.lit(False))
    return F.when((category == "alt_text") & has(TEXT_IN_FIGURES), "alt_text:text_in_figures").when((category == "link_quality") & has(UNTAGGED_LINKS), "link_quality:untagged").otherwise(category)


def routes(file_type: Column, creator: Column) -> Column:
    """Where a fix can be made: an office file in its program, a PDF in its source
    (by InDesign, if that made it) and in an editor of PDFs."""
    office = F.coalesce(file_type, F.lit("pdf")).isin("docx", "pptx", "xlsx")
    return F.when(office, F.array(F.lit("source"))).when(made_by_indesign(creator), F.array(F.lit("source_indesign"), F.lit("acrobat"))).otherwise(F.array(F.lit("source"), F.lit("acrobat")))


def steps(categories: DataFrame) -> DataFrame:
    """Categories (doc_id, ord, id, severity, findings, file_type, creator) with
    an issue, worst first, with advice, routes and the first fact found."""
    issues = categories.where(F.col("severity").isin("Critical", "Moderate", "Minor"))
    worst = Window.partitionBy("doc_id").orderBy(F.desc("severity_rank"), "ord")
    ranked = issues.withColumn("severity_rank", severity_rank(F.col("severity"))).withColumn("rank", F.row_number().over(worst))
    why = F.coalesce(F.nullif(first_actionable(F.col("findings")), F.lit("")), F.col("id"))
    return ranked.withColumns({"advice": advice(F.col("id"), F.col("findings")), "routes": routes(F.col("file_type"), F.col("creator")), "why": why}).drop("severity_rank")


def card(findings: Column) -> Column:
    """Findings in groups: main (facts), signals (indented lines under their
    headings), signal_count and fix (what follows the heading of steps)."""
    group = "struct<heading:string,items:array<string>>"
    present = F.filter(findings, lambda f: f.isNotNull())
    starts = F.transform(present, lambda f: f.startswith("---") & F.lower(f).contains(STEPS_MARK))
    cut = F.array_position(starts, F.lit(True)).cast("int")
    before = F.filter(F.when(cut > 0, F.slice(present, F.lit(1), F.greatest(cut - 1, F.lit(0)))).otherwise(present), lambda f: f != "")
    fix = F.when(cut > 0, F.slice(present, cut + 1, F.size(present))).otherwise(F.array().cast("array<string>"))
    heading = lambda f: strip(F.regexp_replace(F.regexp_replace(f, r"^-{3}\s*", ""), r"\s*-{3}$", ""))

    def add(groups: Column, f: Column) -> Column:
        empty = F.array().cast("array<string>")
        opened = F.concat(groups, F.array(F.struct(heading(f).alias("heading"), empty.alias("items"))))
        item = F.array(F.regexp_replace(f, r"^\s+", ""))
        last = F.element_at(groups, -1)
        grown = F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(F.struct(last["heading"].alias("heading"), F.concat(last["items"], item).alias("items"))))
        first = F.array(F.struct(F.lit("").alias("heading"), item.alias("items")))
        return F.when(f.startswith("---"), opened).when(~f.startswith("  "), groups).when(F.size(groups) > 0, grown).otherwise(first)

    signals = F.aggregate(before, F.array().cast(f"array<{group}>"), add)
    main = F.filter(before, lambda f: ~f.startswith("---") & ~f.startswith("  "))
    return F.struct(main.alias("main"), signals.alias("signals"), F.size(F.filter(before, lambda f: f.startswith("  "))).alias("signal_count"), fix.alias("fix"))


def readiness(categories: Column, strict: Column | None = None) -> Column:
    """Whether a mended file can be published; without categories nothing is known.
    The strict profile's categories come first where it has any list, even an
    empty one."""
    categories = categories if strict is None else F.coalesce(strict, categories)
    n = lambda s: F.size(F.filter(categories, lambda c: c["severity"] == s))
    return F.when(categories.isNull() | (F.size(categories) <= 0), "not_rechecked").otherwise(verdict(n("Critical"), n("Moderate")))


def with_profile(categories: DataFrame, scores: Column) -> DataFrame:
    """Categories with the scores that a profile (map by id) has for them."""
    score = F.when(F.map_contains_key(scores, F.col("id")), F.try_element_at(scores, F.col("id"))).otherwise(F.col("score"))
    return categories.withColumn("score", score.cast("int")).withColumns({"grade": grade_of(F.col("score")), "severity": severity_of(F.col("score"))})


def metadata_rows(values: dict[str, Column]) -> Column:
    """Label and value rows of a file's metadata."""
    return F.array(*(F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")) for label, value in values.items()))


def safe_links(links: Column) -> Column:
    """Help links with web addresses."""
    return F.filter(links, lambda x: safe_http(x["url"]))


def safe_findings(findings: Column) -> Column:
    """Findings of a gate, with addresses that aren't web addresses emptied."""
    return F.transform(findings, lambda f: f.withField("url", F.when(safe_http(f["url"]), f["url"]).otherwise("")))
