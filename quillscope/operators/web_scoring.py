"""Category scores of web pages from their static structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import IMPACT_WEIGHTS
from ..functions.numbers import clamp100, half_up
from ..functions.text import classify_link, filename_like


def heading_jumps(levels: Column) -> Column:
    """How often a heading is more than one level below the one before it."""
    steps = F.zip_with(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, 2, F.greatest(F.size(levels), F.lit(1))), lambda a, b: (b - a > 1).cast("int"))
    return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)


def web_categories(features: DataFrame) -> DataFrame:
    """(doc_id, ord, id, weight, score, not_assessed) of four categories."""
    title = F.when(F.col("title").isNull(), 0).when(filename_like(F.col("title")), 25).otherwise(50)
    heads = F.when(F.size("headings") == 0, 0).when(heading_jumps(F.col("headings")) > 0, 60).otherwise(100)
    needs = F.size(F.filter("links", lambda x: classify_link(x) == "needsFix"))
    links = F.when(F.size("links") == 0, None).otherwise(half_up(100 * (F.size("links") - needs) / F.size("links")))
    rows = [
        (1, "title_language", 0.15, title + F.when(F.col("lang").isNull(), 0).otherwise(50)),
        (2, "heading_structure", 0.15, heads),
        (3, "alt_text", 0.15, F.lit(None).cast("int")),
        (4, "link_quality", 0.05, links),
    ]
    made = F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(i).alias("id"), F.lit(w).alias("weight"), s.cast("int").alias("score"), F.lit(False).alias("not_assessed")) for o, i, w, s in rows))
    return features.select(F.col("page_id").alias("doc_id"), F.inline(made))


def _impact(v: Column) -> Column:
    name = F.lower(F.coalesce(v["impact"], F.lit("")))
    return F.when(name.isin(*IMPACT_WEIGHTS), name).otherwise("minor")


def page_tally(violations: Column) -> Column:
    """Nodes hit, by impact."""
    hit = lambda name: F.aggregate(F.filter(violations, lambda v: _impact(v) == name), F.lit(0), lambda n, v: n + F.greatest(v["nodes"], F.lit(1)))
    return F.struct(*(hit(name).alias(name) for name in IMPACT_WEIGHTS))


def page_score(violations: Column) -> Column:
    """100 less the weight of each violation's impact for each node it hits; an
    unknown impact is minor."""

    def weight(v: Column) -> Column:
        out = F.lit(IMPACT_WEIGHTS["minor"])
        for name, points in IMPACT_WEIGHTS.items():
            out = F.when(_impact(v) == name, points).otherwise(out)
        return out

    return clamp100(F.aggregate(violations, F.lit(100), lambda acc, v: acc - weight(v) * F.greatest(v["nodes"], F.lit(1))))
