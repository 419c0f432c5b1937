"""Questions and upkeep of stored state: events, jobs, reports, and the cache of
audited publications. Updates are folds over change rows or joins that write a
new table, since the tables are files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamped, stored_filename

#: How long rows are kept.
OUTPUT_MINUTES, STUCK_MINUTES, RECENT_DAYS = 30, 10, 7
JOB_DAYS, EVENT_DAYS, LOG_DAYS, REPORT_GRACE_DAYS, REPORT_DAYS = 30, 2555, 365, 30, 365
#: What may be wrong with a service; without the first it can't audit.
CORE_ENGINES, OPTIONAL_ENGINES = ("qpdf",), ("verapdf", "chromium")
BACKUP_STALE_HOURS = 30


def before(now: Column, **spans: int) -> Column:
    unit, n = next(iter(spans.items()))
    return now - F.expr(f"interval {n} {unit}")


def audit_rows(events: DataFrame) -> DataFrame:
    """Rows to append to the audit log from (event_type, filename, score, grade,
    content_hash, privileged): a refused upload has a safe file name and neither
    score, grade nor hash, so that it never counts as audited content."""
    refused = F.col("event_type") == "rejected-upload"
    unless = lambda c: F.when(~refused, F.col(c)).alias(c)
    name = F.when(refused, stored_filename(F.col("filename"))).otherwise(F.col("filename"))
    return events.select("id", F.coalesce("event_type", F.lit("analyze")).alias("event_type"), F.coalesce(clamped(name, 512), F.lit("")).alias("filename"), unless("score"), unless("grade"), unless("content_hash"), F.coalesce(F.col("privileged").cast("int"), F.lit(0)).alias("privileged"))


def report_rows(reports: DataFrame) -> DataFrame:
    """Reports as they are stored, with the day they expire."""
    return reports.withColumn("expires_at", F.col("created_at") + F.expr(f"interval {REPORT_DAYS} days"))


def report_lookup(asked: DataFrame, reports: DataFrame, now: Column) -> DataFrame:
    """(request, id, http_status): 200, 404 for an unknown id, 410 for an expired one."""
    found = asked.join(reports.select("id", "expires_at"), "id", "left")
    return found.select("request", "id", F.when(F.col("expires_at").isNull(), 404).when(F.col("expires_at") < now, 410).otherwise(200).alias("http_status"))


def reusable_reports(reports: DataFrame, now: Column, force: Column | None = None) -> DataFrame:
    """The latest unexpired report of each content; ``force`` asks for a new audit."""
    usable = (F.col("expires_at") > now) & ~F.coalesce(force, F.lit(False)) if force is not None else F.col("expires_at") > now
    return reports.where(usable).groupBy("content_hash").agg(F.max_by(F.struct("id", "created_at"), F.struct("created_at", "id")).alias("r")).select("content_hash", "r.*")


def timelines(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Each job with its events in order of (time, id); a job has few events."""
    ordered = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("occurred_at", "event_id", "event"))).alias("events"))
    out = ordered.join(jobs.select(F.col("id").alias("job_id"), "status"), "job_id")
    return out.select("job_id", "status", F.size("events").cast("long").alias("n_events"), F.array_join(F.transform("events", lambda e: e["event"]), " > ").alias("timeline"), F.get("events", F.lit(0))["occurred_at"].alias("first_at"), F.element_at("events", -1)["occurred_at"].alias("last_at"))


def job_upkeep(jobs: DataFrame, now: Column) -> DataFrame:
    """(id, action): outputs that expire, jobs that hang, in one pass."""
    expire = (F.col("status") == "complete") & (F.col("expires_at") < now)
    stuck = F.col("status").isin("pending", "running") & (F.col("created_at") < before(now, minutes=STUCK_MINUTES))
    action = F.when(expire, "expire").when(stuck, "fail_stuck")
    return jobs.select("id", action.alias("action")).where("action is not null")


def orphans(folders: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Output folders (name) that no job of the last days has."""
    known = jobs.where(F.col("created_at") > before(now, days=RECENT_DAYS)).select(F.col("id").cast("string").alias("name"))
    return folders.join(known, "name", "left_anti")


def purged(table: str) -> tuple[Column, int]:
    """(the column of age, days it is kept) of each kind of stored row."""
    done = F.when(F.col("status").isin("complete", "failed", "expired"), F.coalesce("completed_at", "created_at"))
    return {"jobs": (done, JOB_DAYS), "events": (F.col("occurred_at"), EVENT_DAYS), "audit_log": (F.col("created_at"), LOG_DAYS), "reports": (F.col("expires_at"), REPORT_GRACE_DAYS)}[table]


def purge(rows: DataFrame, table: str, now: Column, days: int | None = None) -> DataFrame:
    """``rows`` that stay; one without an age stays."""
    age, kept = purged(table)
    return rows.where(~F.coalesce(age < before(now, days=days or kept), F.lit(False)))


def purge_counts(rows: DataFrame, table: str, now: Column, days: int | None = None) -> DataFrame:
    age, kept = purged(table)
    gone = F.coalesce(age < before(now, days=days or kept), F.lit(False))
    return rows.agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept")).select(F.lit(table).alias("rows_of"), "purged", "kept")


def folded_jobs(changes: DataFrame) -> DataFrame:
    """State of each job from change rows (job_id, kind, at, event_id, text,
    number, input, valid, until), as updates in order would leave it: kinds step,
    status, scores (input score, output score, whether the output is valid),
    finalize (with the time its output expires), fail and expire. Each column keeps what its last setter gave it, so
    one aggregate, combined before the shuffle, replaces the sequence."""
    kind, order = F.col("kind"), F.struct("at", "event_id")

    def last(value: Column, *kinds: str) -> Column:
        # in a struct, since a value may be set to null
        return F.max_by(F.when(kind.isin(*kinds), F.struct(value.alias("v"))), F.when(kind.isin(*kinds), order))["v"]

    status = F.when(kind == "status", F.col("text")).when(kind == "finalize", "complete").when(kind == "fail", "failed").otherwise("expired")
    progress = F.when(kind == "finalize", 100).otherwise(F.col("number"))
    return changes.groupBy("job_id").agg(
        F.coalesce(last(status, "status", "finalize", "fail", "expire"), F.lit("pending")).alias("status"),
        last(F.when(kind == "step", F.col("text")), "step", "finalize", "fail").alias("step"),
        F.coalesce(last(progress, "step", "status", "finalize"), F.lit(0)).alias("progress_pct"),
        last(F.col("input"), "scores").alias("input_score"),
        last(F.col("number"), "scores").alias("output_score"),
        last(F.col("valid"), "scores").alias("output_valid"),
        last(F.col("text"), "fail").alias("failure_reason"),
        last(F.when(kind == "finalize", F.col("text")), "finalize", "expire").alias("output_path"),
        F.max(F.when(kind.isin("finalize", "fail"), F.col("at"))).alias("completed_at"),
        last(F.col("until"), "finalize").alias("expires_at"),
    )


def backfilled(cache: DataFrame, publications: DataFrame) -> DataFrame:
    """The cache with summaries and tags of the publications where a stored
    success has no summary; of publications that share a URL the last row counts."""
    news = publications.groupBy("url").agg(F.max_by(F.struct("summary", "tags"), "doc_id").alias("p"))
    out = cache.join(news, "url", "left")
    fill = F.col("summary").isNull() & (F.col("status") == "success") & F.col("p").isNotNull()
    return out.select("url", "status", F.when(fill, F.col("p.summary")).otherwise(F.col("summary")).alias("summary"), F.when(fill, F.col("p.tags")).otherwise(F.col("tags")).alias("tags"), F.coalesce(fill, F.lit(False)).alias("filled"))


def upserted(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache (url, status, error_message, audited_at) after results that
    replace rows of their URL: an error that can't go away is permanent."""
    failed = F.col("error_message").isNotNull()
    status = F.when(~failed, "success").when(F.coalesce("permanent", F.lit(False)), "permanent_error").otherwise("error")
    new = results.select("url", status.alias("status"), "error_message", "audited_at")
    both = cache.select(new.columns).withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    kept = both.groupBy("url").agg(F.max_by(F.struct("status", "error_message", "audited_at"), F.struct("turn", "audited_at", "status")).alias("r"))
    return kept.select("url", "r.*")


def rejections(runs: DataFrame) -> DataFrame:
    """Remediations (input_score, output_score, input_strict, output_strict)
    that made a file worse, with the reason; a missing strict score is the overall one."""
    strict = F.coalesce("output_strict", "output_score") - F.coalesce("input_strict", "input_score")
    overall = F.col("output_score") - F.col("input_score")
    worse = lambda delta, name: F.when(delta < 0, F.concat(F.lit(name + " "), F.format_string("%.1f", delta.cast("double"))))
    reason = F.concat(F.lit("auto-remediation regressed: "), F.concat_ws(", ", worse(overall, "overall"), worse(strict, "strict")))
    return runs.withColumns({"overall_delta": overall, "strict_delta": strict}).where((F.col("overall_delta") < 0) | (F.col("strict_delta") < 0)).withColumn("reason", reason)


def backup_state(integrity: Column, finished_at: Column, now: Column) -> tuple[Column, Column]:
    """(status, age in hours to one decimal) of the last backup: unavailable
    unless it is known to be whole, stale after thirty hours."""
    hours = (F.unix_micros(now) - F.unix_micros(finished_at)) / F.lit(3.6e9)
    age = F.when((integrity == "ok") & finished_at.isNotNull(), F.greatest(F.lit(0.0), F.floor(hours * 10 + 0.5) / 10))
    return F.when(age.isNull(), "unavailable").when(age > BACKUP_STALE_HOURS, "stale").otherwise("ok"), age


def degraded(engines: dict[str, Column], database: Column, backup: Column, disk: Column, privileged: Column) -> tuple[Column, Column]:
    """(what is wrong, as names in a fixed order; whether the service can't audit).
    Only an established failure counts: unknown is not down."""
    down = database == "down"
    names = [F.when(down, "database"), *(F.when(~engines[e], e) for e in (*CORE_ENGINES, *OPTIONAL_ENGINES)), F.when(backup == "stale", "backup"), F.when(disk == "low", "disk"), F.when(privileged == "off", "privileged_tier")]
    core = down
    for e in CORE_ENGINES:
        core = core | ~engines[e]
    return F.array_compact(F.array(*names)), core
