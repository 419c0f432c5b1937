"""Queries over stored state: jobs, events, reports, the cache, the service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import lifecycle, stored
from . import adapters as A
from .adapters import table
from .queries import query


def _with_now(rows: DataFrame, clock: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(clock))  # the clock is one row


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = A.jobs(spark, sf_dir)
    return _with_now(jobs, jobs.agg(F.max("created_at").alias("now")))


@query(f"""WITH {A.JOBS}, {A.JOB_EVENTS} SELECT e.job_id, any_value(j.status) AS status, count(*) AS n_events, string_agg(event, ' > ' ORDER BY occurred_at, event_id) AS timeline, min(occurred_at) AS first_at, max(occurred_at) AS last_at
 FROM job_events e JOIN jobs j ON j.id = e.job_id GROUP BY e.job_id""")
def job_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.timelines(A.jobs(spark, sf_dir), A.job_events(spark, sf_dir))


@query(f"""WITH {A.JOBS} SELECT id, CASE WHEN status = 'complete' AND expires_at < now THEN 'expire' ELSE 'fail_stuck' END AS action FROM jobs, jobs_clock
 WHERE (status = 'complete' AND expires_at < now) OR (status IN ('pending', 'running') AND created_at < now - INTERVAL 10 MINUTES)""")
def job_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.job_upkeep(_jobs(spark, sf_dir), F.col("now"))


@query(f"""WITH {A.JOBS}, d AS (SELECT CAST(l_orderkey AS VARCHAR) AS name FROM lineitem UNION SELECT 'x' || s_suppkey FROM supplier)
 SELECT name FROM d WHERE name NOT IN (SELECT CAST(id AS VARCHAR) FROM jobs, jobs_clock WHERE created_at > now - INTERVAL 7 DAYS)""")
def orphan_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folders = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("name")).union(table(spark, sf_dir, "supplier").select(F.concat(F.lit("x"), "s_suppkey"))).distinct()
    return stored.orphans(folders, _jobs(spark, sf_dir), F.col("now"))


@query(f"""WITH {A.JOBS}, {A.JOB_EVENTS}, {A.AUDIT_LOG},
 r AS (SELECT created_at + INTERVAL 365 DAYS - INTERVAL 350 DAYS AS expires_at FROM audit_log WHERE event_type = 'audit-url')
 SELECT 'jobs' AS rows_of, count(*) FILTER (status IN ('complete', 'failed', 'expired') AND coalesce(completed_at, created_at) < now - INTERVAL 30 DAYS) AS purged, count(*) - purged AS kept FROM jobs, jobs_clock
 UNION ALL SELECT 'events', count(*) FILTER (occurred_at < now - INTERVAL 20 DAYS), count(*) - count(*) FILTER (occurred_at < now - INTERVAL 20 DAYS) FROM job_events, clock
 UNION ALL SELECT 'audit_log', count(*) FILTER (created_at < now - INTERVAL 10 DAYS), count(*) - count(*) FILTER (created_at < now - INTERVAL 10 DAYS) FROM audit_log, clock
 UNION ALL SELECT 'reports', count(*) FILTER (expires_at < now - INTERVAL 5 DAYS), count(*) - count(*) FILTER (expires_at < now - INTERVAL 5 DAYS) FROM r, clock""")
def purge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are shorter than those of service where the rows cover a month only."""
    log = A.audit_log(spark, sf_dir)
    clock = A.clock(log)
    reports = stored.report_rows(log.where("event_type = 'audit-url'")).withColumn("expires_at", F.col("expires_at") - F.expr("interval 350 days"))
    counts = [stored.purge_counts(_jobs(spark, sf_dir), "jobs", F.col("now")), stored.purge_counts(_with_now(A.job_events(spark, sf_dir), clock), "events", F.col("now"), 20), stored.purge_counts(_with_now(log, clock), "audit_log", F.col("now"), 10), stored.purge_counts(_with_now(reports, clock), "reports", F.col("now"), 5)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3])


_CHANGE = "CASE event_id % 11 WHEN 0 THEN 'finalize' WHEN 1 THEN 'fail' WHEN 2 THEN 'expire' WHEN 3 THEN 'scores' WHEN 4 THEN 'status' ELSE 'step' END"
_CHANGE_TEXT = "CASE event_id % 11 WHEN 0 THEN 'out/' || user_id WHEN 1 THEN 'reason ' || event_id % 7 WHEN 4 THEN 'running' ELSE 'step ' || event_id % 5 END"


def _last(value: str, kinds: str) -> str:
    return f"arg_max(struct_pack(v := {value}), struct_pack(ts := moment, i := event_id)) FILTER (kind IN ({kinds}))"


@query(f"""WITH c AS (SELECT user_id AS job_id, event_id, ts AS moment, {_CHANGE} AS kind, {_CHANGE_TEXT} AS txt, CAST(event_id % 101 AS INT) AS number, CAST(event_id % 97 AS INT) AS input, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS valid, ts + INTERVAL 30 MINUTES AS until FROM events),
 g AS (SELECT job_id, {_last("CASE kind WHEN 'status' THEN txt WHEN 'finalize' THEN 'complete' WHEN 'fail' THEN 'failed' ELSE 'expired' END", "'status', 'finalize', 'fail', 'expire'")} AS s,
  {_last("CASE WHEN kind = 'step' THEN txt END", "'step', 'finalize', 'fail'")} AS st, {_last("CASE WHEN kind = 'finalize' THEN 100 ELSE number END", "'step', 'status', 'finalize'")} AS p,
  {_last("number", "'scores'")} AS o, {_last("input", "'scores'")} AS n, {_last("valid", "'scores'")} AS v, {_last("until", "'finalize'")} AS e, {_last("txt", "'fail'")} AS f, {_last("CASE WHEN kind = 'finalize' THEN txt END", "'finalize', 'expire'")} AS path, max(moment) FILTER (kind IN ('finalize', 'fail')) AS completed_at FROM c GROUP BY job_id)
 SELECT job_id, coalesce(s.v, 'pending') AS status, st.v AS step, coalesce(p.v, 0) AS progress_pct, o.v AS output_score, f.v AS failure_reason, path.v AS output_path, completed_at, n.v AS input_score, v.v AS output_valid, e.v AS expires_at FROM g""")
def job_states_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.folded_jobs(table(spark, sf_dir, "events").selectExpr("user_id AS job_id", "event_id", "ts AS at", f"{_CHANGE} AS kind", f"{_CHANGE_TEXT} AS text", "CAST(event_id % 101 AS INT) AS number", "CAST(event_id % 97 AS INT) AS input", "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS valid", "ts + interval 30 minutes AS until"))


_REPORTS = f"""{A.AUDIT_LOG}, rep AS (SELECT id, content_hash, created_at, created_at + to_days(CAST(id % 25 AS INT)) AS expires_at FROM audit_log WHERE event_type = 'audit-url')"""


def _reports(log: DataFrame) -> DataFrame:
    return log.where("event_type = 'audit-url'").selectExpr("id", "content_hash", "created_at", "created_at + make_interval(0, 0, 0, CAST(id % 25 AS INT)) AS expires_at")


@query(f"WITH {_REPORTS} SELECT a.id AS request, a.id * 3 % 7000 AS id, CASE WHEN r.id IS NULL THEN 404 WHEN r.expires_at < now THEN 410 ELSE 200 END AS http_status FROM audit_log a JOIN clock ON true LEFT JOIN rep r ON r.id = a.id * 3 % 7000")
def report_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir)
    asked = _with_now(log.selectExpr("id AS request", "id * 3 % 7000 AS id"), A.clock(log))
    return stored.report_lookup(asked, _reports(log), F.col("now"))


@query(f"WITH {_REPORTS} SELECT content_hash, id, created_at FROM rep, clock WHERE expires_at > now AND id % 9 <> 0 QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY created_at DESC, id DESC) = 1")
def reusable_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir)
    return stored.reusable_reports(_with_now(_reports(log), A.clock(log)), F.col("now"), F.col("id") % 9 == 0)


_NAME = "'dir/ ' || filename || chr(9) || repeat('n', CAST(id % 600 AS INT)) || '#'"


@query(f"""WITH {A.AUDIT_LOG}, n AS (SELECT *, {_NAME} AS raw FROM audit_log),
 s AS (SELECT *, trim(regexp_replace(substr(regexp_replace(replace(raw, chr(9), ' '), '^.*/', ''), 1, 255), '[^a-zA-Z0-9._ -]', '_', 'g')) AS safe FROM n)
 SELECT id, event_type, CASE WHEN event_type = 'rejected-upload' THEN safe ELSE substr(raw, 1, 512) END AS filename, CASE WHEN event_type <> 'rejected-upload' THEN score END AS score,
 CASE WHEN event_type <> 'rejected-upload' THEN grade END AS grade, CASE WHEN event_type <> 'rejected-upload' THEN content_hash END AS content_hash, coalesce(privileged, 0) AS privileged FROM s""")
def audit_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.audit_rows(A.audit_log(spark, sf_dir).withColumn("filename", F.expr(_NAME)))


@query(f"WITH {A.AUDIT_LOG} SELECT id, filename, created_at, created_at + INTERVAL 365 DAYS AS expires_at FROM audit_log WHERE event_type = 'audit-url'")
def shared_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.report_rows(A.audit_log(spark, sf_dir).where("event_type = 'audit-url'").select("id", "filename", "created_at"))


_CACHE = """pc AS (SELECT doc_id, 'u' || doc_id AS url, CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'permanent_error' ELSE 'success' END AS status, CASE WHEN doc_id % 3 = 0 THEN 'old ' || doc_id END AS summary, CAST(NULL AS VARCHAR) AS tags FROM documents),
 np AS (SELECT doc_id, 'u' || (doc_id - doc_id % 2) AS url, 'new ' || doc_id AS summary, '["t' || doc_id % 4 || '"]' AS tags FROM documents)"""


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    held = docs.selectExpr("doc_id", "concat('u', doc_id) AS url", "CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'permanent_error' ELSE 'success' END AS status", "CASE WHEN doc_id % 3 = 0 THEN concat('old ', doc_id) END AS summary", "CAST(NULL AS STRING) AS tags")
    news = docs.selectExpr("doc_id", "concat('u', doc_id - doc_id % 2) AS url", "concat('new ', doc_id) AS summary", "concat('[\"t', doc_id % 4, '\"]') AS tags")
    return held, news


@query(f"""WITH {_CACHE}, m AS (SELECT url, arg_max(summary, doc_id) AS s, arg_max(tags, doc_id) AS t FROM np GROUP BY url)
 SELECT pc.url, status, CASE WHEN summary IS NULL AND status = 'success' AND m.url IS NOT NULL THEN s ELSE summary END AS summary, CASE WHEN summary IS NULL AND status = 'success' AND m.url IS NOT NULL THEN t ELSE tags END AS tags, summary IS NULL AND status = 'success' AND m.url IS NOT NULL AS filled
 FROM pc LEFT JOIN m ON m.url = pc.url""")
def metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.backfilled(*_cache(spark, sf_dir))


@query(f"WITH {_CACHE} SELECT count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'success' AND summary IS NULL) AS without_summary FROM pc")
def cache_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, _ = _cache(spark, sf_dir)
    good = F.col("status") == "success"
    return held.agg(F.count_if(good).alias("successes"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(good & F.col("summary").isNull()).alias("without_summary"))


@query(f"""WITH {_CACHE}, r AS (SELECT url, CASE WHEN doc_id % 4 = 0 THEN 'gone' WHEN doc_id % 4 = 1 THEN 'slow' END AS error_message, doc_id % 4 = 0 AS permanent, doc_id AS audited_at FROM np),
 b AS (SELECT url, status, CAST(NULL AS VARCHAR) AS error_message, -1 AS audited_at, 0 AS turn FROM pc UNION ALL SELECT url, CASE WHEN error_message IS NULL THEN 'success' WHEN permanent THEN 'permanent_error' ELSE 'error' END, error_message, audited_at, 1 FROM r)
 SELECT url, status, error_message, audited_at FROM b QUALIFY row_number() OVER (PARTITION BY url ORDER BY turn DESC, audited_at DESC, status DESC) = 1""")
def cache_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, news = _cache(spark, sf_dir)
    held = held.select("url", "status", F.lit(None).cast("string").alias("error_message"), F.lit(-1).cast("long").alias("audited_at"))
    results = news.selectExpr("url", "CASE WHEN doc_id % 4 = 0 THEN 'gone' WHEN doc_id % 4 = 1 THEN 'slow' END AS error_message", "doc_id % 4 = 0 AS permanent", "doc_id AS audited_at")
    return stored.upserted(held, results)


@query(f"""WITH {A.JOBS}, d AS (SELECT id, output_score - input_score AS overall_delta, coalesce(output_strict, output_score) - coalesce(input_strict, input_score) AS strict_delta FROM jobs)
 SELECT id, overall_delta, strict_delta, 'auto-remediation regressed: ' || concat_ws(', ', CASE WHEN overall_delta < 0 THEN 'overall ' || overall_delta || '.0' END, CASE WHEN strict_delta < 0 THEN 'strict ' || strict_delta || '.0' END) AS reason FROM d WHERE overall_delta < 0 OR strict_delta < 0""")
def regressed_remediations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.rejections(A.jobs(spark, sf_dir)).select("id", "overall_delta", "strict_delta", "reason")


@query("""WITH p AS (SELECT p_partkey AS probe, p_partkey % 3 <> 0 AS qpdf, p_partkey % 4 <> 0 AS verapdf, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 5 <> 0 END AS chromium, CASE WHEN p_partkey % 11 = 0 THEN 'down' ELSE 'ok' END AS db,
  CASE p_partkey % 13 WHEN 0 THEN 'bad' ELSE 'ok' END AS integrity, (p_partkey * 7 % 500)::DOUBLE / 10 AS h, CASE p_partkey % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'unavailable' ELSE 'ok' END AS disk, CASE WHEN p_partkey % 17 = 0 THEN 'off' ELSE 'on' END AS tier FROM part),
 b AS (SELECT *, CASE WHEN integrity = 'ok' THEN h END AS age_hours FROM p),
 c AS (SELECT *, CASE WHEN age_hours IS NULL THEN 'unavailable' WHEN age_hours > 30 THEN 'stale' ELSE 'ok' END AS backup FROM b)
 SELECT probe, backup, age_hours, concat_ws(',', CASE WHEN db = 'down' THEN 'database' END, CASE WHEN NOT qpdf THEN 'qpdf' END, CASE WHEN NOT verapdf THEN 'verapdf' END, CASE WHEN NOT chromium THEN 'chromium' END,
  CASE WHEN backup = 'stale' THEN 'backup' END, CASE WHEN disk = 'low' THEN 'disk' END, CASE WHEN tier = 'off' THEN 'privileged_tier' END) AS degraded, db = 'down' OR NOT qpdf AS core_failure FROM c""")
def service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS probe", "p_partkey % 3 <> 0 AS qpdf", "p_partkey % 4 <> 0 AS verapdf", "CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 5 <> 0 END AS chromium", "CASE WHEN p_partkey % 11 = 0 THEN 'down' ELSE 'ok' END AS db",
        "CASE p_partkey % 13 WHEN 0 THEN 'bad' ELSE 'ok' END AS integrity", "timestamp_micros(1700000000000000 - (p_partkey * 7 % 500) * 360000000) AS finished_at", "timestamp_micros(1700000000000000) AS now",
        "CASE p_partkey % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'unavailable' ELSE 'ok' END AS disk", "CASE WHEN p_partkey % 17 = 0 THEN 'off' ELSE 'on' END AS tier",
    )
    state, age = stored.backup_state(F.col("integrity"), F.col("finished_at"), F.col("now"))
    p = p.withColumns({"backup": state, "age_hours": age})
    wrong, core = stored.degraded({e: F.col(e) for e in ("qpdf", "verapdf", "chromium")}, F.col("db"), F.col("backup"), F.col("disk"), F.col("tier"))
    return p.select("probe", "backup", "age_hours", F.array_join(wrong, ",").alias("degraded"), core.alias("core_failure"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id AS k, ts FROM events), w AS (
  SELECT k, min(ts) AS t FROM e GROUP BY k
  UNION ALL SELECT * FROM (SELECT w.k, (SELECT min(ts) FROM e WHERE e.k = w.k AND e.ts >= w.t + INTERVAL 1 DAY) AS t FROM w) WHERE t IS NOT NULL)
 SELECT k AS key, t AS at FROM w""")
def throttled_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of each key that a day's throttle lets through."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"), F.col("ts").alias("at")).agg(F.min("event_id").alias("request_id"))
    return lifecycle.admissions(rows, 1, 86_400).where("admitted").select("key", "at")


@query("""SELECT p_partkey, CASE WHEN n < 60 THEN n || ' s' WHEN n // 60 < 60 THEN n // 60 || ' m' WHEN n // 3600 < 48 THEN n // 3600 || ' h ' || n // 60 % 60 || ' m' ELSE n // 86400 || ' d ' || n // 3600 % 24 || ' h' END AS uptime,
 strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS iso, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE strftime(t, '%Y-%m-%dT%H:%M:%SZ') END AS stored_iso,
 CASE p_partkey % 4 WHEN 0 THEN 'some day' WHEN 1 THEN strftime(t, '%Y-01-01T00:00:00.000Z') WHEN 2 THEN strftime(t, '%Y-%m-%dT00:00:00.000Z') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S.000Z') END AS pdf_date
 FROM (SELECT p_partkey, p_partkey * 997 AS n, make_timestamp((p_partkey * 99991 + 1600000000) * 1000000) AS t FROM part)""")
def times_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey * 997 AS n", "timestamp_micros((p_partkey * 99991 + 1600000000) * 1000000) AS t")
    kept = F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, F.date_format("t", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raw = F.when(F.col("p_partkey") % 4 == 0, "some day").when(F.col("p_partkey") % 4 == 1, F.date_format("t", "'D:'yyyy")).when(F.col("p_partkey") % 4 == 2, F.date_format("t", "'D:'yyyyMMdd")).otherwise(F.concat(F.date_format("t", "yyyyMMddHHmmss"), F.lit("+05'30'")))
    return p.select("p_partkey", text.human_uptime(F.col("n")).alias("uptime"), dates.iso_seconds(F.col("t")).alias("iso"), dates.stored_utc(kept).alias("stored_iso"), dates.pdf_date(raw).alias("pdf_date"))
