"""Questions over many stored results: counts by window, format and grade,
distributions, pivots and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import ERA_START, EXTENSIONS
from ..functions.numbers import half_up

REFUSED_FORMATS = ("doc", "xls", "ppt", "rtf", "csv", "other")
FORMAT_KEYS, GRADE_KEYS = (*EXTENSIONS, "unknown_extension"), ("A", "B", "C", "D", "F", "ungraded")
DOCUMENT_EVENTS = ("analyze", "audit-url", "bulk-from-inventory")


def format_of(filename: Column) -> Column:
    out = None
    for ext in EXTENSIONS:
        test = F.lower(filename).endswith("." + ext)
        out = F.when(test, ext) if out is None else out.when(test, ext)
    return out.otherwise("unknown_extension")


def grade_bucket(grade: Column) -> Column:
    return F.when(F.upper(grade).isin("A", "B", "C", "D", "F"), F.upper(grade)).otherwise("ungraded")


def window_counts(log: DataFrame, now: Column) -> DataFrame:
    """One row of totals over all time, a day and thirty days, in one scan."""
    doc, page = F.col("event_type").isin(*DOCUMENT_EVENTS), F.col("event_type") == "audit-url-page"
    day, month = F.col("created_at") > now - F.expr("interval 24 hours"), F.col("created_at") > now - F.expr("interval 30 days")
    counts = {}
    for name, test in (("documents", doc), ("pages", page), ("privileged", doc & (F.col("privileged") == 1))):
        for span, inside in (("all", F.lit(True)), ("day", day), ("month", month)):
            counts[f"{name}_{span}"] = F.count_if(test & inside)
    return log.agg(*(c.alias(n) for n, c in counts.items()), F.max(F.when(doc, F.col("created_at"))).alias("last_document"))


def counts_by(log: DataFrame, bucket: Column, name: str, now: Column) -> DataFrame:
    """Document events by bucket, over all time and thirty days."""
    docs = log.where(F.col("event_type").isin(*DOCUMENT_EVENTS))
    month = F.col("created_at") > now - F.expr("interval 30 days")
    return docs.groupBy(bucket.alias(name)).agg(F.count("*").alias("n_all"), F.count_if(month).alias("n_month"))


def zero_filled(counts: DataFrame, name: str, keys: tuple[str, ...]) -> DataFrame:
    """``counts`` with a row for each of ``keys``, in which other names have no place
    and missing ones count 0."""
    spark = counts.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias(name))
    numbers = [c for c in counts.columns if c != name]
    return every.join(counts, name, "left").select(name, *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))


def refused_format(filename: Column) -> Column:
    """What kind of file a refused upload was offered as."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    out = F.when(name.endswith(".csv") | name.endswith(".tsv"), "csv")
    for ext in ("doc", "xls", "ppt", "rtf"):
        out = out.when(name.endswith("." + ext), ext)
    return out.otherwise("other")


def refused_uploads(log: DataFrame, now: Column) -> DataFrame:
    """Refused uploads by kind over all time, a day and thirty days, every kind with
    a row, and their total."""
    spans = {"n_all": F.lit(True), "n_day": F.col("created_at") > now - F.expr("interval 24 hours"), "n_month": F.col("created_at") > now - F.expr("interval 30 days")}
    refused = log.where(F.col("event_type") == "rejected-upload").withColumn("format", refused_format(F.col("filename")))
    each = refused.groupBy("format").agg(*(F.count_if(test).alias(n) for n, test in spans.items()))
    filled = zero_filled(each, "format", REFUSED_FORMATS)
    return filled.unionByName(filled.groupBy().agg(F.lit("total").alias("format"), *(F.sum(n).alias(n) for n in spans)))


def grade_distribution(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    grades = [F.count_if(F.col("grade") == g).alias(g) for g in "ABCDF"]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("total"), *grades)


def assess(d: DataFrame) -> DataFrame:
    """Level of a distribution by its shares of good and failing grades."""
    share = lambda x: F.when(F.col("total") > 0, half_up(x / F.col("total") * 100)).otherwise(0)
    good, bad = share(F.col("A") + F.col("B")), share(F.col("D") + F.col("F"))
    level = F.when((F.col("total") == 0) | (good >= 80), "good").when(good >= 50, "mixed").when(bad >= 60, "critical").otherwise("concern")
    return d.withColumns({"passing_pct": good, "failing_pct": bad, "needs_pct": share(F.col("C") + F.col("D") + F.col("F")), "level": level})


def eras(publications: DataFrame) -> DataFrame:
    """Distribution and assessment by era and over all, in one grouping-sets pass."""
    era = F.when(F.col("publication_date") >= ERA_START, "recent").otherwise("legacy")
    rows = publications.withColumn("era", era).cube("era").agg(F.count("*").alias("total"), *(F.count_if(F.col("grade") == g).alias(g) for g in "ABCDF"))
    return assess(rows.withColumn("era", F.coalesce("era", F.lit("all"))))


def category_pivot(categories: DataFrame, ids: list[str]) -> DataFrame:
    """A wide row per document: score, grade and severity of each category."""
    one = lambda i, c: F.max(F.when(F.col("id") == i, F.col(c))).alias(f"{i}_{c}")
    return categories.groupBy("doc_id").agg(*(one(i, c) for i in ids for c in ("score", "grade", "severity")))


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("publication_date"), F.asc_nulls_first("title"), "doc_id")
