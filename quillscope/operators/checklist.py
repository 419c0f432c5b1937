"""A checklist of 32 rules on PDF records, each passed, failed, left to a person,
skipped or not computed; a pass on nothing is marked vacuous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .format_scoring import bad_fonts, count, filled, yes
from .web_scoring import heading_jumps

c = F.col


def _longest_run(urls: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    step = lambda acc, x: F.struct(x.alias("last"), F.when(x == acc["last"], acc["n"] + 1).otherwise(1).alias("n"), F.greatest(acc["most"], F.when(x == acc["last"], acc["n"] + 1).otherwise(1)).alias("most"))
    return F.aggregate(urls, F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most")), step, lambda acc: acc["most"])


def rules() -> list[tuple[str, Column, Column]]:
    """(rule, status, vacuous) in the checklist's order."""
    no, tree = F.lit(False), yes(c("hasStructTree"))
    passed = lambda test: F.when(test, "passed").otherwise("failed")
    manual, assumed = F.lit("manual"), F.lit("passed")
    figures, tables, lists, fields, heads, links = (count(x) for x in ("images", "tables", "lists", "formFields", "headings", "links"))
    of = lambda n, status: F.when(n == 0, "passed").otherwise(status)
    none = lambda x, test: passed(count(x, test) == 0)
    known = count("links", lambda x: x["tagged"].isNotNull())
    loose = count("links", lambda x: x["tagged"] == False)  # noqa: E712
    annotations = F.when(links == 0, "passed").when(known == 0, "not_computed").when(~tree, "failed").otherwise(passed(loose == 0))
    large = yes(c("totalPageCount") >= 21)
    numbered = F.transform(F.filter("headings", lambda h: h.rlike(r"^H\d$")), lambda h: F.substring(h, 2, 1).cast("int"))
    # a page census that the record lacks counts as no page
    ordered = F.coalesce("tabOrderPages", F.lit(0)) >= F.coalesce("totalPageCount", F.lit(0))
    marked, text_tags = yes(c("isMarkedContent")), (F.coalesce("paragraphCount", F.lit(0)) == 0) & (heads == 0)
    return [
        ("accessibility_permission_flag", passed(F.coalesce("accessibilityAllowed", F.lit(True))), no),
        ("image_only_pdf", passed(yes(c("hasText")) | tree), no),
        ("tagged_pdf", passed(tree), tree & yes(c("structTreeDepth") == 0)),
        ("logical_reading_order", manual, no),
        ("primary_language", passed(yes(c("hasLang"))), no),
        ("title", passed(filled(c("title")) & yes(c("displayDocTitle"))), no),
        ("bookmarks", passed(~large | yes(c("hasOutlines"))), ~large),
        ("color_contrast", manual, no),
        ("tagged_content", passed(marked), marked & text_tags),
        ("tagged_annotations", annotations, links == 0),
        ("tab_order", passed(ordered), no),
        ("character_encoding", F.when(bad_fonts() == 0, "passed").otherwise("not_computed"), count("fonts") == 0),
        ("tagged_multimedia", assumed, F.lit(True)),
        ("screen_flicker", assumed, F.lit(True)),
        ("scripts", assumed, F.lit(True)),
        ("timed_responses", assumed, F.lit(True)),
        ("navigation_links", passed(F.coalesce(_longest_run(F.transform("links", lambda x: x["url"])), F.lit(0)) < 3), links == 0),
        ("tagged_form_fields", of(fields, "not_computed"), fields == 0),
        ("field_descriptions", of(fields, none("formFields", lambda f: ~f["hasTU"])), fields == 0),
        ("figures_alternate_text", of(figures, none("images", lambda i: ~i["hasAlt"])), figures == 0),
        ("nested_alternate_text", of(figures, "not_computed"), figures == 0),
        ("associated_with_content", of(figures, "not_computed"), figures == 0),
        ("hides_annotation", of(figures, "not_computed"), figures == 0),
        ("other_elements_alternate_text", F.lit("not_computed"), no),
        ("rows", of(tables, none("tables", lambda t: ~t["hasRowStructure"])), tables == 0),
        ("th_and_td", of(tables, "not_computed"), tables == 0),
        ("headers", of(tables, none("tables", lambda t: ~t["hasHeaders"])), tables == 0),
        ("regularity", of(tables, none("tables", lambda t: t["hasConsistentColumns"] == False)), tables == 0),  # noqa: E712
        ("summary", F.lit("skipped"), no),
        ("list_items", of(lists, "not_computed"), lists == 0),
        ("lbl_and_lbody", of(lists, none("lists", lambda x: ~x["isWellFormed"])), lists == 0),
        ("appropriate_nesting", of(heads, passed(heading_jumps(numbered) == 0)), heads == 0),
    ]


def checklist(records: DataFrame) -> DataFrame:
    """(doc_id, ord, rule, status, vacuous): 32 rows a document."""
    for name, kind in (("tabOrderPages", "int"), ("isMarkedContent", "boolean")):
        if name not in records.columns:
            records = records.withColumn(name, F.lit(None).cast(kind))
    rows = [F.struct(F.lit(i + 1).alias("ord"), F.lit(n).alias("rule"), s.alias("status"), F.coalesce(v, F.lit(False)).alias("vacuous")) for i, (n, s, v) in enumerate(rules())]
    return records.select("doc_id", F.inline(F.array(*rows)))


def checklist_summary(records: DataFrame) -> DataFrame:
    """Counts by status of each document, vacuous passes beside."""
    each = lambda s: F.count_if(F.col("status") == s).alias(s)
    vacuous = F.count_if((F.col("status") == "passed") & F.col("vacuous")).alias("vacuous_passes")
    return checklist(records).groupBy("doc_id").agg(*map(each, ("passed", "failed", "manual", "skipped", "not_computed")), vacuous, F.count("*").alias("total"))
