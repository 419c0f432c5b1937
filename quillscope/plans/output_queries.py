"""Queries over validator output, job events and stored reports as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, validator
from ..streaming import jobs
from .adapters import table
from .queries import query

c = F.col

# Output of several validator versions, one document a part: the newest lists rule
# summaries below details, older ones beside the result, the oldest failed rules.
_SHAPES = """CASE k % 6
 WHEN 0 THEN concat('{"report":{"jobs":[{"validationResult":[{"compliant":', yes, ',"profileName":"P', k % 3, '","details":{"failedChecks":', 100 + k, ',"failedRules":3,"ruleSummaries":', rules, '}}]}]}}')
 WHEN 1 THEN concat('{"jobs":[{"validationResult":{"isCompliant":', yes, ',"profile":{"id":"Q"},"ruleSummaries":', rules, '}}]}')
 WHEN 2 THEN concat('{"jobs":[{"validationResult":{"passed":"true","failedRules":', rules, '}}]}')
 WHEN 3 THEN 'no json' WHEN 4 THEN '' ELSE '{"jobs":[]}' END"""


@query(f"""WITH r AS (SELECT * FROM (SELECT p_partkey AS k, unnest(range(1, (p_partkey % 24)::INT + 1)) AS i FROM part)),
 f AS (SELECT k, i, CASE k % 6 WHEN 0 THEN '7.' || i || '-' || i % 3 WHEN 1 THEN 'ISO' ELSE 'r' || i END AS rule, CASE WHEN k % 6 < 2 THEN k * i % 9 ELSE 1 END AS n FROM r WHERE k % 6 < 3),
 p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, i) AS place FROM f WHERE n > 0),
 t AS (SELECT k, count(*) AS rules, sum(n) AS total, string_agg(rule || ':' || n, ',' ORDER BY place) FILTER (place <= 20) AS failures FROM p GROUP BY k)
 SELECT p_partkey AS doc_id, p_partkey % 6 < 2 AND p_partkey % 2 = 0 AND p_partkey % 5 <> 0 AND p_partkey % 4 < 2 AS passed,
  CASE p_partkey % 6 WHEN 0 THEN 'P' || p_partkey % 3 WHEN 1 THEN 'Q' ELSE 'ua1' END AS profile, coalesce(failures, '') AS failures,
  (CASE WHEN p_partkey % 6 = 0 THEN 100 + p_partkey ELSE coalesce(total, 0) END)::BIGINT AS total_failures, coalesce(rules, 0)::INTEGER AS distinct_rules,
  CASE WHEN p_partkey % 6 = 3 THEN 'unparseable' WHEN p_partkey % 6 = 4 THEN CASE WHEN p_partkey % 5 = 0 THEN 'no_output' ELSE 'unparseable' END WHEN p_partkey % 6 = 5 THEN 'no_result' END AS error
 FROM part LEFT JOIN t ON t.k = p_partkey""")
def validator_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from the texts of several validator versions."""
    part = table(spark, sf_dir, "part").select(c("p_partkey").alias("k"))
    rule = lambda i: F.when(
        c("k") % 6 == 0, F.format_string('{"clause":"7.%d","testNumber":%d,"failedChecks":%d}', i, i % 3, c("k") * i % 9),
    ).when(c("k") % 6 == 1, F.format_string('{"clause":"7.1","specification":"ISO","count":%d}', c("k") * i % 9)).otherwise(F.format_string('{"ruleId":"r%d"}', i))
    rules = F.concat(F.lit("["), F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.lit(24)), lambda i: i <= c("k") % 24), rule), ","), F.lit("]"))
    yes = F.when((c("k") % 2 == 0) & (c("k") % 4 < 2), "true").otherwise("false")
    outputs = part.withColumns({"rules": rules, "yes": yes}).select(c("k").alias("doc_id"), F.expr(_SHAPES).alias("output"), (c("k") % 5 == 0).alias("exit_failed"))
    shown = F.array_join(F.transform("failures", lambda f: F.concat(f["rule"], F.lit(":"), f["count"].cast("string"))), ",")
    return validator.verdicts(outputs).withColumn("failures", shown)


_EVENTS = "SELECT user_id AS job_id, event_id, ts, CASE event_id * 7 % 16 WHEN 0 THEN 'failed' WHEN 1 THEN 'expired' WHEN 2 THEN 'complete' WHEN 3 THEN 'complete' WHEN 4 THEN 'pending' WHEN 5 THEN 'pending' WHEN 6 THEN 'pending' ELSE 'running' END AS status FROM events"
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, follows in jobs.TRANSITIONS.items() for b in follows)


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS n FROM ({_EVENTS})),
 s AS (SELECT job_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, FALSE AS accepted, '' AS state FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL SELECT s.job_id, e.n, e.event_id, (s.state, e.status) IN ({_ALLOWED}), CASE WHEN (s.state, e.status) IN ({_ALLOWED}) THEN e.status ELSE s.state END FROM s JOIN e ON e.job_id = s.job_id AND e.n = s.n + 1)
 SELECT job_id, event_id, accepted, state FROM s WHERE n > 0""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events the state of their job permits, and the state after each."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return jobs.permitted(spark.sql(_EVENTS).withColumnRenamed("ts", "at")).select("job_id", "event_id", "accepted", "state")


_LINK = """'{"label":"l' || {n} || '","url":"' || CASE ({n}) % 3 WHEN 0 THEN 'https://a.b/' WHEN 1 THEN 'javascript:' ELSE 'http://c/' END || {n} || '"}'"""
_KEPT = """CASE WHEN ({n}) % 3 <> 1 THEN """ + _LINK + " END"
_CLEAN = """concat('{"categories":[{"helpLinks":[', {first}, '],"id":"a"},{"helpLinks":[', {second}, '],"id":"b"}],"conformance":{"failures":[{"sc":"1.1.1","url":"', {url}, '"}],"status":"fail"},"scoreProfiles":{"strict":{"categories":[{"helpLinks":[', {third}, ']}]}}}')"""


def _report(link: str, url: str) -> str:
    """SQL of a report, with ``link`` at each of its places."""
    links = lambda *at: "concat_ws(',', " + ", ".join(link.replace("{n}", n) for n in at) + ")"
    parts = {"first": links("(k + 0)", "(k + 1)", "(k + 2)"), "second": links("(k * 7)"), "third": links("(k * 5)", "(k * 5 + 1)"), "url": url}
    out = _CLEAN
    for name, part in parts.items():
        out = out.replace("{" + name + "}", part)
    return out


_URL = "CASE k % 4 WHEN 0 THEN 'https://w3.org/' WHEN 1 THEN 'ftp://x' WHEN 2 THEN '' ELSE 'HTTP://w3.org' END"


@query(f"""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 13 = 5 THEN NULL ELSE {_report(_KEPT, "CASE k % 4 WHEN 0 THEN 'https://w3.org/' WHEN 3 THEN 'HTTP://w3.org' ELSE '' END")} END AS report_json,
 CASE WHEN p_partkey % 13 = 5 THEN 'not_an_object' END AS error FROM (SELECT *, p_partkey AS k FROM part)""")
def cleaned_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports without links that must not be shown."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    text = _report(_LINK, _URL)
    stored = spark.sql(f"SELECT k AS doc_id, CASE WHEN k % 13 = 5 THEN 'no report' ELSE {text} END AS report_json FROM (SELECT p_partkey AS k FROM part)")
    return cleaning.cleaned_reports(stored)
