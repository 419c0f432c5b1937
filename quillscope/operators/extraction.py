"""Structure of cells, rows, runs and links from extracted arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .format_scoring import yes


def column_counts(rows: Column) -> Column:
    """Columns that each row covers, given arrays of cells (cols, span): a cell
    that spans rows counts in the rows below as well."""

    def step(acc: Column, row: Column) -> Column:
        carried = F.aggregate(acc["carry"], F.lit(0), lambda s, x: s + x["cols"])
        own = F.aggregate(row, F.lit(0), lambda s, x: s + x["cols"])
        rest = F.filter(F.transform(acc["carry"], lambda x: F.struct(x["cols"].alias("cols"), (x["left"] - 1).alias("left"))), lambda x: x["left"] > 0)
        new = F.transform(F.filter(row, lambda x: x["span"] > 1), lambda x: F.struct(x["cols"].alias("cols"), (x["span"] - 1).alias("left")))
        return F.struct(F.concat(acc["counts"], F.array(carried + own)).alias("counts"), F.concat(rest, new).alias("carry"))

    start = F.struct(F.array().cast("array<int>").alias("counts"), F.array().cast("array<struct<cols:int,left:int>>").alias("carry"))
    return F.aggregate(rows, start, step, lambda acc: acc["counts"])


def consistent(counts: Column) -> Column:
    """Whether all rows cover as many columns; null without rows."""
    return F.when(F.size(counts) > 0, F.forall(counts, lambda n: n == F.element_at(counts, 1)))


_REF = r"^([A-Z]+)(\d+)(?::([A-Z]+)(\d+))?$"


def column_number(letters: Column) -> Column:
    """AA is 27."""
    return F.aggregate(F.split(letters, ""), F.lit(0), lambda n, x: F.when(x == "", n).otherwise(n * 26 + F.ascii(x) - 64))


def _ref(ref: Column) -> tuple[Column, Column, Column]:
    clean = F.upper(F.trim(ref))
    part = lambda i: F.regexp_extract(clean, _REF, i)
    pair = part(3) != ""
    cols = F.when(pair, F.abs(column_number(part(3)) - column_number(part(1))) + 1).otherwise(1)
    rows = F.when(pair, F.abs(part(4).try_cast("int") - part(2).try_cast("int")) + 1).otherwise(1)
    return yes(clean.rlike(_REF)), cols, rows


def column_span(ref: Column) -> Column:
    valid, cols, _ = _ref(ref)
    return F.when(valid, cols)


def cell_count(ref: Column) -> Column:
    valid, cols, rows = _ref(ref)
    return F.when(valid, cols * rows).otherwise(0)


def dominant(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Most frequent value of each group; of equal ones the first seen."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def merged_runs(rows: DataFrame, group: str, order: str, link: str, text: str) -> DataFrame:
    """Neighbouring text runs of one link as one link text, in order."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.when(F.lag(link).over(w).eqNullSafe(F.col(link)), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).where(F.col(link).isNotNull())
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return marked.groupBy(group, "_run", link).agg(F.concat_ws("", F.transform(parts, lambda x: x["t"])).alias(text), F.min(order).alias("first")).drop("_run")


def link_texts(links: DataFrame, items: DataFrame, slack: float = 5.0) -> DataFrame:
    """Text of links whose rectangles hold text anchors of their page, words in
    order: (doc_id, page, link_id, text). Pages are the join's key, so only a
    page's own rectangles and anchors meet."""
    inside = F.col("x").between(F.col("x0") - slack, F.col("x1") + slack) & F.col("y").between(F.col("y0") - slack, F.col("y1") + slack)
    met = links.join(items, ["doc_id", "page"], "left").withColumn("hit", yes(inside))
    words = F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("pos", "str"))))
    return met.groupBy("doc_id", "page", "link_id").agg(F.concat_ws(" ", F.transform(words, lambda x: x["str"])).alias("text"))


def unclaimed(annotations: DataFrame, structure: DataFrame) -> DataFrame:
    """Link annotations that no structure element refers to."""
    return annotations.where(~yes(F.col("hidden"))).join(structure, ["doc_id", "annotation"], "left_anti")


def validator_verdict(report: Column) -> dict[str, Column]:
    """Passed, distinct failing rules, total failed checks and the twenty most
    failed rules of a validator's report (compliant, failedChecks, rules)."""
    bad = F.filter(report["rules"], lambda r: r["count"] > 0)
    # counts descend, ties stay in the report's order
    ranked = F.array_sort(F.transform(bad, lambda r, i: F.struct((-r["count"]).alias("less"), i.alias("i"), r["clause"].alias("clause"), r["count"].alias("count"))))
    total = F.aggregate(bad, F.lit(0).cast("long"), lambda s, r: s + r["count"])
    top = F.transform(F.slice(ranked, 1, 20), lambda r: F.struct(r["clause"].alias("clause"), r["count"].alias("count")))
    three = F.aggregate(F.slice(ranked, 1, 3), F.lit(0).cast("long"), lambda s, r: s + r["count"])
    all_ = F.coalesce(report["failedChecks"], total)
    return {"passed": report["compliant"], "distinct_rules": F.size(bad), "total_failures": all_, "failures": top, "top3_share": F.when(all_ > 0, three / all_)}
