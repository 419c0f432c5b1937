"""What analysis records are made of: predicates and joins over the parts of a
document, as an extractor lists them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .extraction import cell_count


def _yes(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def fake_heading(styled: Column, text: Column, runs: Column) -> Column:
    """A short line in bold of 14 points or more that has no heading style;
    runs are (bold, half_points)."""
    t = strip(F.coalesce(text, F.lit("")))
    big = F.exists(runs, lambda r: _yes(r["bold"]) & _yes(r["half_points"] >= 28))
    return ~_yes(styled) & (t != "") & (F.length(t) <= 120) & _yes(big)


def layout_table(header_mark: Column, style: Column, borders: Column, shading: Column) -> Column:
    """A table without any mark of a data table only arranges things."""
    return ~(_yes(header_mark) | _yes(style) | _yes(borders) | _yes(shading))


def counts_as_image(kind: Column, text: Column, has_picture: Column) -> Column:
    """A shape or group that holds text is text, unless a picture is inside."""
    shape = kind.isin("shape", "group")
    return ~(shape & (strip(F.coalesce(text, F.lit(""))) != "") & ~_yes(has_picture))


def alt_of(description: Column, title: Column) -> tuple[Column, Column]:
    """(alternative text, whether only a title is there, which nobody hears)."""
    d, t = (F.nullif(strip(x), F.lit("")) for x in (description, title))
    return d, d.isNull() & t.isNotNull()


def title_first(shapes: Column) -> Column:
    """Whether the first shape with content is the title; shapes are (kind,
    is_title, text, decorative) in order."""
    content = F.filter(shapes, lambda s: (s["kind"] == "frame") | ((s["kind"] == "picture") & ~_yes(s["decorative"])) | ((s["kind"] == "shape") & (strip(F.coalesce(s["text"], F.lit(""))) != "")))
    return _yes(F.get(content, F.lit(0))["is_title"])


def used_cells(ref: Column, held: Column) -> Column:
    """The larger of what a sheet declares and what it holds."""
    return F.greatest(cell_count(F.coalesce(ref, F.lit(""))), F.coalesce(held, F.lit(0)))


def link_texts(links: DataFrame, cells: DataFrame) -> DataFrame:
    """(doc_id, ref, display) with the text of the first cell of the range that
    a link stands on, else what it displays; unresolved where neither is known."""
    first = F.trim(F.split_part("ref", F.lit(":"), F.lit(1)))
    named = links.withColumn("cell", first).join(cells.select("doc_id", F.col("ref").alias("cell"), F.trim("text").alias("cell_text")), ["doc_id", "cell"], "left")
    text = F.trim(F.coalesce(F.nullif("cell_text", F.lit("")), F.col("display"), F.col("cell_text"), F.lit("")))
    return named.select("doc_id", "ref", text.alias("text"), (F.col("cell_text").isNotNull() | F.col("display").isNotNull()).alias("resolved"))


def applied_styles(cells: DataFrame) -> DataFrame:
    """Styles that a cell with a value uses; a cell without a style has the first."""
    return cells.where(F.col("text").isNotNull()).select("doc_id", F.coalesce("style", F.lit(0)).alias("style")).distinct()


def image_census(paints: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, images, content_images) from paint operations (doc_id, page, ord,
    name, width, height, artifact): an image counts once a page, as it is painted
    first, if it isn't tiny; unknown sizes count."""
    first = paints.groupBy("doc_id", "page", "name").agg(F.min_by(F.struct("width", "height", "artifact"), "ord").alias("p"))
    tiny = _yes((F.col("p.width") < least) | (F.col("p.height") < least))
    return first.groupBy("doc_id").agg(F.count_if(~tiny).alias("images"), F.count_if(~tiny & ~_yes(F.col("p.artifact"))).alias("content_images"))


def page_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, empty_pages, has_text) of (doc_id, page, text): pages of under ten
    characters, and whether there are more than fifty in all."""
    n = F.length(strip(F.coalesce("text", F.lit(""))))
    return pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(n < 10, F.col("page")))).alias("empty_pages"), (F.sum(F.length(F.coalesce("text", F.lit("")))) > 50).alias("has_text"))


def reachable(objects: DataFrame, references: DataFrame) -> DataFrame:
    """Objects (doc_id, ref) that the structure refers to."""
    return objects.join(references.select("doc_id", "ref"), ["doc_id", "ref"], "left_semi")


def outermost(tables: DataFrame, nested: DataFrame) -> DataFrame:
    """Tables that don't stand in another; masks of images go the same way."""
    return tables.join(nested.select("doc_id", "ref"), ["doc_id", "ref"], "left_anti")


def form_fields(widgets: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, field, label): fields once each, hidden ones left out, with the
    label of the nearest ancestor, up to five steps, that has one. Widgets are
    (doc_id, ref, parent, label, hidden, is_field); one that is listed twice is one."""
    once = widgets.groupBy("doc_id", "ref").agg(F.min(F.struct("parent", "label")).alias("w"))
    tree = once.select("doc_id", F.col("ref").alias("parent"), F.col("w.label").alias("above"), F.col("w.parent").alias("next"))
    out = widgets.where(_yes(F.col("is_field")) & ~_yes(F.col("hidden"))).dropDuplicates(["doc_id", "ref"]).select("doc_id", F.col("ref").alias("field"), F.nullif("label", F.lit("")).alias("label"), "parent")
    for _ in range(most):
        joined = out.join(tree, ["doc_id", "parent"], "left")
        out = joined.select("doc_id", "field", F.coalesce("label", F.nullif("above", F.lit(""))).alias("label"), F.col("next").alias("parent"))
    return out.select("doc_id", "field", "label")


def element_counts(elements: DataFrame) -> DataFrame:
    """Counts per document of (doc_id, tag, lang, actual_text, expansion, artifact)."""
    some = lambda c: _yes(F.col(c) != "")
    return elements.groupBy("doc_id").agg(F.count_if(F.col("tag") == "P").alias("paragraphs"), F.count_if(_yes(F.col("artifact"))).alias("artifacts"), F.count_if(some("actual_text")).alias("actual_texts"), F.count_if(some("expansion")).alias("expansions"), F.count_if(some("lang") & (F.col("tag") != "Document")).alias("lang_spans"))


def figure_alt(alt: Column, actual: Column) -> Column:
    return F.coalesce(F.nullif(strip(alt), F.lit("")), F.nullif(strip(actual), F.lit("")))


def accessibility_allowed(encrypted: Column, capability: Column) -> Column:
    """Whether readers may take the text; unknown unless a file is encrypted."""
    return F.when(_yes(encrypted), F.coalesce(capability, F.lit(True)))


def slim_issue(issue: Column, nodes: int = 25) -> Column:
    """An issue of a page audit as it is stored: at least one node counts, the
    first 25 are kept; tags that aren't texts are left out."""
    held = F.coalesce(issue["nodes"], F.array().cast("array<struct<target:array<string>>>"))
    kept = F.transform(F.slice(held, 1, nodes), lambda n: F.struct(F.coalesce(n["target"], F.array().cast("array<string>")).alias("target")))
    text = lambda c: F.coalesce(issue[c], F.lit(""))
    tags = F.array_compact(F.coalesce(issue["tags"], F.array().cast("array<string>")))
    return F.struct(text("id").alias("id"), issue["impact"].alias("impact"), text("description").alias("description"), text("helpUrl").alias("helpUrl"), tags.alias("tags"), F.greatest(F.lit(1), F.size(held)).alias("nodeCount"), kept.alias("nodes"))


def language_tally(spans: Column, lang: Column) -> Column:
    """Languages of marked passages other than the document's, with counts, by name."""
    names = F.transform(F.filter(spans, lambda s: s != ""), F.lower)
    other = F.array_sort(F.filter(F.array_distinct(names), lambda n: n != F.lower(F.coalesce(lang, F.lit("")))))
    return F.transform(other, lambda n: F.struct(n.alias("lang"), F.size(F.filter(names, lambda x: x == n)).alias("n")))


def foreign_languages(spans: Column, lang: Column) -> Column:
    """Main parts of the language tags that differ from the document's, in order of first use."""
    main = lambda x: F.split_part(F.lower(F.coalesce(x, F.lit(""))), F.lit("-"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(spans, main)), lambda n: (n != "") & (n != main(lang)))


def worst_contrast(failing: Column) -> Column:
    """The failing text of least ratio, the first of equal ones."""
    return F.aggregate(failing, F.lit(None).cast("struct<ratio:double,text:string>"), lambda best, x: F.when(best.isNull() | (x["ratio"] < best["ratio"]), x).otherwise(best))
