"""Facts of a document from its objects, listed as rows: catalog, pages, slide
order by relationships, and content by page in the order of the structure tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trees import follow


def _of(kind: str, key: str, value: Column) -> Column:
    """A value that some object of a kind has under a key; the largest of several."""
    return F.max(F.when((F.col("kind") == kind) & (F.col("key") == key) & F.col("value").isNotNull(), value))


def _has(kind: str, key: str) -> Column:
    return F.coalesce(_of(kind, key, F.lit(True)), F.lit(False))


def _true(kind: str, key: str) -> Column:
    return F.coalesce(_of(kind, key, F.col("value") == "true"), F.lit(False))


def catalog_facts(values: DataFrame) -> DataFrame:
    """One row a document of (doc_id, object, kind, key, value), where references
    are resolved: kind is the object's type, or the key it stands under in the
    catalog; values are texts. Flags are aggregates, so a document of any size is
    combined before the shuffle."""
    language = F.regexp_replace("value", "^u:", "")
    pages, tabs = (F.col("kind") == "Page") & (F.col("key") == "Type"), (F.col("kind") == "Page") & (F.col("key") == "Tabs") & (F.col("value") != "")
    return values.groupBy("doc_id").agg(
        (_has("Catalog", "StructTreeRoot") | _has("StructTreeRoot", "Type")).alias("hasStructTree"), _has("Catalog", "Lang").alias("hasLang"), _of("Catalog", "Lang", language).alias("lang"),
        _has("Catalog", "Outlines").alias("hasOutlines"), _has("Catalog", "AcroForm").alias("hasAcroForm"), _has("AcroForm", "XFA").alias("hasXfa"),
        _of("ViewerPreferences", "DisplayDocTitle", F.when(F.col("value").isin("true", "false"), F.col("value") == "true")).alias("displayDocTitle"), _true("Catalog", "NeedsRendering").alias("needsRendering"),
        _has("Catalog", "MarkInfo").alias("hasMarkInfo"), _true("MarkInfo", "Marked").alias("isMarkedContent"), _true("MarkInfo", "Suspects").alias("suspectsFlag"),
        F.count_if(pages).cast("int").alias("totalPageCount"), F.count_if(tabs).cast("int").alias("tabOrderPages"),
    )


def slide_order(slides: DataFrame, listed: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, part, place) of slides (doc_id, part): those that the presentation
    lists (doc_id, ord, rel) come first, by the targets of its relationships
    (doc_id, rel, target), the others behind them by the number in their name."""
    target = F.concat(F.lit("ppt/"), F.regexp_replace(F.regexp_replace("target", r"^\./", ""), "^/", ""))
    named = listed.join(links.select("doc_id", "rel", target.alias("part")), ["doc_id", "rel"]).groupBy("doc_id", "part").agg(F.min("ord").alias("ord"))
    number = F.regexp_extract("part", r"slide(\d+)\.xml$", 1).cast("long")
    rows = slides.join(named, ["doc_id", "part"], "left")
    order = Window.partitionBy("doc_id").orderBy(F.col("ord").isNull(), "ord", number, "part")
    return rows.select("doc_id", "part", F.row_number().over(order).alias("place"))


def headings_of(in_order: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, place, level): headings in document order where the structure tree
    has any, else as the objects list them."""
    have = in_order.select("doc_id").distinct()
    return in_order.select("doc_id", "place", "level").unionByName(listed.join(have, "doc_id", "left_anti").select("doc_id", "place", "level"))


def content_by_page(places: DataFrame, content: DataFrame) -> DataFrame:
    """(doc_id, page, marks, figure_marks): numbers of marked content by page, in the
    order of the structure tree, and those that stand directly in a figure.

    ``places`` is a tree of elements and content; ``content`` has doc_id, node, tag
    and has_page, page for elements, and mark besides for content. Content without
    a page of its own is on that of the nearest element above that names one; an
    element can name a page that isn't there, and then its content is nowhere."""
    rows = places.where("root is not null").join(content, ["doc_id", "node"])
    up = F.when(~F.coalesce("has_page", F.lit(False)), F.col("parent"))
    ends = follow(rows.select("doc_id", "node", up.alias("to"), F.lit(1).alias("steps")), ["doc_id"], ["steps"])
    pages = rows.select("doc_id", F.col("node").alias("end"), F.col("page").alias("on"))
    tags = rows.select("doc_id", F.col("node").alias("parent"), (F.col("tag") == "Figure").alias("in_figure"))
    found = rows.where("mark is not null").join(ends.select("doc_id", "node", "end"), ["doc_id", "node"]).join(pages, ["doc_id", "end"]).where("on is not null").join(tags, ["doc_id", "parent"], "left")
    listed = lambda x: F.transform(F.array_sort(F.collect_list(x)), lambda y: y["mark"])
    one = F.struct("place", "mark")
    return found.groupBy("doc_id", F.col("on").alias("page")).agg(listed(one).alias("marks"), listed(F.when(F.col("in_figure"), one)).alias("figure_marks"))
