"""From category results to document reports, without a shuffle of its own:
a document's categories are an array, folded in category order so that sums of
doubles come out the same wherever the job runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

from ..functions.numbers import capped, grade_of, half_up, severity_of, severity_rank


def with_severity(categories: DataFrame) -> DataFrame:
    """(doc_id, ord, id, weight, score, not_assessed) with grade and severity."""
    return categories.withColumns({"grade": grade_of(F.col("score")), "severity": severity_of(F.col("score"))})


def nest(categories: DataFrame) -> DataFrame:
    """One row per document with its categories in order. The one shuffle; both
    sides of the exchange hold at most a document's few categories per key."""
    fields = F.struct("ord", "id", "weight", "score", "not_assessed", "grade", "severity")
    return with_severity(categories).groupBy("doc_id").agg(F.array_sort(F.collect_list(fields)).alias("categories"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` worked out once however often it is named."""
    return F.transform(F.array(value), then)[0]


def weighted_score(categories: Column) -> Column:
    """Weighted mean of an array of categories. A category without score counts
    100 where it doesn't apply and is left out where it wasn't assessed."""

    def of(counted: Column) -> Column:
        share = lambda total: F.aggregate(counted, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["score"], F.lit(100)) * (c["weight"] / total))
        total = F.aggregate(counted, F.lit(0.0), lambda acc, c: acc + c["weight"])
        return _once(total, lambda w: F.when(w == 0, 0).otherwise(_once(share(w), half_up)))

    return _once(F.filter(categories, lambda c: c["score"].isNotNull() | ~F.coalesce(c["not_assessed"], F.lit(False))), of)


def worst_rank(categories: Column) -> Column:
    scored = F.filter(categories, lambda c: c["score"].isNotNull())
    return F.coalesce(F.array_max(F.transform(scored, lambda c: severity_rank(c["severity"]))), F.lit(0))


def report(nested: DataFrame, scanned: Column | None = None) -> DataFrame:
    """Adds raw_score, overall_score, grade and capped; the score is capped by
    the worst severity found, and a scanned document scores 0."""
    scanned = F.coalesce(scanned, F.lit(False)) if scanned is not None else F.lit(False)
    out = nested.withColumn("raw_score", F.when(scanned, 0).otherwise(weighted_score(F.col("categories"))))
    out = out.withColumn("worst", worst_rank(F.col("categories")))
    out = out.withColumn("overall_score", F.when(scanned, 0).otherwise(capped(F.col("raw_score"), F.col("worst"))))
    return out.withColumns({"grade": grade_of(F.col("overall_score")), "is_capped": F.col("overall_score") < F.col("raw_score")}).drop("worst")


_STORED = {"overallScore": "double", "grade": "string", "isScanned": "boolean", "categories": "array<struct<ord:int,id:string,weight:double,score:double,not_assessed:boolean,grade:string,severity:string>>"}


def regraded(r: Column) -> Column:
    """(overall_score, grade, changed) of a stored report's struct. The score comes
    from the categories where their weights can be used, else it is the stored one;
    then the cap holds, so that the worst category bounds either. A scanned
    document has 0. Without categories or a score nothing changes, and the grade
    is taken from the score only where that changed."""

    def known(cats: Column) -> Column:
        counted = F.filter(cats, lambda c: c["score"].isNotNull() | ~F.coalesce(c["not_assessed"], F.lit(False)))
        usable = lambda weights: F.forall(weights, lambda w: w.isNotNull() & (w >= 0)) & (F.aggregate(weights, F.lit(0.0), lambda a, w: a + F.coalesce(w, F.lit(0.0))) > 0)
        raw = F.when(_once(F.transform(counted, lambda c: c["weight"]), usable), weighted_score(cats)).otherwise(r["overallScore"].cast("int"))
        bound = _once(F.struct(raw.alias("raw"), worst_rank(cats).alias("worst")), lambda x: capped(x["raw"], x["worst"]))
        return F.when(F.coalesce(r["isScanned"], F.lit(False)), 0).otherwise(bound)

    def graded(score: Column) -> Column:
        changed = F.coalesce(score != r["overallScore"], F.lit(False))
        return F.struct(score.cast("int").alias("overall_score"), F.when(changed, grade_of(score)).otherwise(r["grade"]).alias("grade"), changed.alias("changed"))

    anew = _once(F.transform(r["categories"], lambda c: c.withField("score", c["score"].cast("int"))), known)
    return _once(F.when(r["categories"].isNull() | r["overallScore"].isNull(), r["overallScore"].cast("int")).otherwise(anew), graded)


def regrade(stored: DataFrame) -> DataFrame:
    """Stored reports (doc_id, report_json) scored anew under today's rules, and
    each of their score profiles on its own categories: doc_id, overall_score,
    grade, changed, profiles (name -> the same three)."""
    fields, profile = ", ".join(f"{n} {t}" for n, t in _STORED.items()), ",".join(f"{n}:{t}" for n, t in _STORED.items())
    out = stored.withColumn("r", F.from_json("report_json", f"{fields}, scoreProfiles map<string,struct<{profile}>>"))
    return out.select("doc_id", regraded(F.col("r")).alias("x"), F.transform_values("r.scoreProfiles", lambda _, p: regraded(p)).alias("profiles")).select("doc_id", "x.*", "profiles")


def tally(categories: Column) -> dict[str, Column]:
    """Counts of a document's categories by severity, and of counted and passed ones."""
    count = lambda test: F.size(F.filter(categories, test))
    counted = lambda c: c["score"].isNotNull() | ~F.coalesce(c["not_assessed"], F.lit(False))
    return {
        "critical": count(lambda c: c["severity"] == "Critical"),
        "moderate": count(lambda c: c["severity"] == "Moderate"),
        "minor": count(lambda c: c["severity"] == "Minor"),
        "counted": count(counted),
        "passed": count(lambda c: counted(c) & (F.coalesce(c["score"], F.lit(100)) == 100)),
    }


def severity_counts(severities: Column) -> Column:
    """(critical, moderate, minor, pass, total) of an array of severities. Only these
    four names count; a null array has none."""
    names = ("Critical", "Moderate", "Minor", "Pass")
    held = F.array_compact(F.coalesce(severities, F.array().cast("array<string>")))
    n = {name: F.size(F.array_remove(held, name)) for name in names}
    n = {name: F.size(held) - left for name, left in n.items()}
    return F.struct(*(n[name].alias(name.lower()) for name in names), sum(n.values(), F.lit(0)).alias("total"))


def verdict(critical: Column, moderate: Column) -> Column:
    return F.when(critical > 0, "not_ready").when(moderate > 0, "fix_first").otherwise("ready")


def fidelity_band(similarity: Column) -> Column:
    """Score of a reading order by its similarity to the order of content."""
    return F.when(similarity >= 0.97, 100).when(similarity >= 0.9, 90).when(similarity >= 0.8, 85).when(similarity >= 0.5, 65).otherwise(30)


def _lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence; a row of its table is the bits
    of one number."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for y in b:
        met = row & places.get(y, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


@pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays, duplicates kept."""
    return pd.Series([_lcs(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], dtype="int32")


def reading_order(pages: DataFrame) -> DataFrame:
    """(doc_id, page, struct_order, stream_order, figures) to a fidelity per
    document: per page the common ids' longest common subsequence over the
    longer list, weighted by the number of distinct common ids."""
    keep = lambda c: F.filter(c, lambda x: ~F.array_contains(F.coalesce("figures", F.array().cast("array<int>")), x))
    p = pages.select("doc_id", "page", keep("struct_order").alias("s"), keep("stream_order").alias("t"))
    p = p.withColumn("shared", F.array_intersect("s", "t")).where(F.size("shared") >= 2)
    p = p.withColumns({"s": F.expr("filter(s, x -> array_contains(shared, x))"), "t": F.expr("filter(t, x -> array_contains(shared, x))")})
    p = p.withColumn("similarity", lcs_length(F.col("s"), F.col("t")) / F.greatest(F.size("s"), F.size("t")))
    each = F.array_sort(F.collect_list(F.struct("page", "similarity", F.size("shared").alias("n"))))
    d = p.groupBy("doc_id").agg(each.alias("pages"))
    total = F.aggregate("pages", F.lit(0), lambda acc, x: acc + x["n"])
    weighted = F.aggregate("pages", F.lit(0.0), lambda acc, x: acc + x["similarity"] * x["n"])
    d = d.withColumn("similarity", weighted / total)
    return d.select("doc_id", fidelity_band(F.col("similarity")).alias("score"), half_up(F.col("similarity") * 100).alias("similarity_pct"), F.size("pages").alias("pages_analyzed"), F.size(F.filter("pages", lambda x: x["similarity"] < 0.8)).alias("pages_with_drift"), F.transform(F.filter("pages", lambda x: x["similarity"] < 0.8), lambda x: x["page"]).alias("drift_pages"))
