"""Output of an outside validator, whatever its version: VARIANT values read by
paths in order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rules that are kept of a verdict
MOST_RULES = 20


def at(value: Column, path: str) -> Column:
    """What stands at a path, null where there is nothing or a JSON null."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def _of(value: Column, kinds: str, cast: str) -> Column:
    """A value of the kinds named, else null: texts aren't taken for numbers."""
    return F.when(F.schema_of_variant(value).rlike(f"^({kinds})"), F.try_variant_get(value, "$", cast))


def _text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number(value: Column) -> Column:
    return _of(value, "BIGINT|INT|DECIMAL|DOUBLE|SMALLINT|TINYINT", "bigint")


def text_at(value: Column, path: str) -> Column:
    return _text(at(value, path))


def number_at(value: Column, path: str) -> Column:
    return _number(at(value, path))


#: what is read of a rule, in one step
_RULE = "struct<clause:variant,testNumber:variant,specification:variant,ruleId:variant,id:variant,failedChecks:variant,count:variant,description:variant,message:variant>"


def _rule(r: Column) -> Column:
    number = F.try_variant_get(r["testNumber"], "$", "string")
    clause = F.coalesce(_text(r["clause"]), F.lit(""))
    count = F.coalesce(_number(r["failedChecks"]), _number(r["count"]), F.lit(1).cast("long"))
    # an array of one binds the clause
    rule = lambda c: F.coalesce(F.when((c != "") & number.isNotNull(), F.concat(c, F.lit("-"), number)), _text(r["specification"]), _text(r["ruleId"]), _text(r["id"]), F.lit("unknown"))
    whole = lambda c: F.struct(rule(c).alias("rule"), c.alias("clause"), F.coalesce(_text(r["description"]), _text(r["message"]), F.lit("")).alias("description"), count.alias("count"))
    return F.transform(F.array(clause), whole)[0]


def verdicts(outputs: DataFrame) -> DataFrame:
    """(doc_id, passed, profile, failures, total_failures, distinct_rules, error) of
    a validator's outputs (doc_id, output, exit_failed). The newest known place of
    each fact comes first, older ones after it; a rule is named by clause and test;
    failures are the most frequent rules, ties in the order of the report. A
    validator that exits with an error never passes; error says no_output,
    unparseable or no_result where there is no verdict."""
    failed = F.coalesce("exit_failed", F.lit(False))
    # an output takes far longer than its bytes would tell, so few files are dealt anew
    out = outputs.repartition("doc_id", "output").withColumn("_v", F.try_parse_json(F.nullif("output", F.lit(""))))
    v = F.col("_v")
    report = F.coalesce(at(v, "$.report"), v)
    found = at(F.coalesce(at(report, "$.jobs"), at(v, "$.jobs")), "$[0].validationResult")
    first = F.when(F.schema_of_variant(found).startswith("ARRAY"), at(found, "$[0]")).otherwise(found)
    out = out.withColumn("_r", first)
    r = F.col("_r")
    true = lambda path: F.coalesce(_of(at(r, path), "BOOLEAN", "boolean"), F.lit(False))
    listed = F.coalesce(at(r, "$.details.ruleSummaries"), at(r, "$.ruleSummaries"), at(r, "$.failedRules"))
    rules = F.coalesce(F.try_variant_get(listed, "$", "array<variant>"), F.array().cast("array<variant>"))
    out = out.withColumn("_bad", F.filter(F.transform(F.transform(rules, lambda r: F.try_variant_get(r, "$", _RULE)), _rule), lambda x: x["count"] > 0))
    ranked = F.array_sort(F.transform("_bad", lambda x, i: F.struct((-x["count"]).alias("less"), i.alias("i"), x.alias("x"))))
    total = F.coalesce(number_at(r, "$.details.failedChecks"), F.aggregate("_bad", F.lit(0).cast("long"), lambda s, x: s + x["count"]))
    error = F.when(failed & (F.coalesce("output", F.lit("")) == ""), "no_output").when(v.isNull(), "unparseable").when(r.isNull(), "no_result")
    given = lambda x, other: F.when(error.isNull(), x).otherwise(other)
    return out.select(
        "doc_id", given((true("$.isCompliant") | true("$.compliant") | true("$.passed")) & ~failed, F.lit(False)).alias("passed"),
        given(F.coalesce(text_at(r, "$.profileName"), text_at(r, "$.profile.id"), F.lit("ua1")), F.lit("ua1")).alias("profile"),
        F.transform(F.slice(ranked, 1, MOST_RULES), lambda x: x["x"]).alias("failures"), given(total, F.lit(0)).cast("long").alias("total_failures"), F.size("_bad").alias("distinct_rules"), error.alias("error"),
    )
