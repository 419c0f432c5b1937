"""Stored results over time: latest versions, reuse by content, retention,
before and after, and admission in a sliding window."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import CLEAN, ISSUES
from ..functions.numbers import severity_of, severity_rank


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key. ``max_by`` aggregates before the shuffle, so a
    key with many versions costs one row per task, not a sorted window."""
    others = [c for c in rows.columns if c != key]
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r"))
    return packed.select(key, *(F.col(f"r.{c}").alias(c) for c in others))


def pending(publications: DataFrame, cache: DataFrame) -> DataFrame:
    """Publications without a usable result in the cache."""
    done = cache.where(F.col("status").isin("success", "permanent_error")).select("url")
    return publications.join(done, "url", "left_anti")


def audited_within(rows: DataFrame, log: DataFrame, hours: int = 1) -> DataFrame:
    """Rows whose content was audited in the hours before they came in. Audits
    are reduced to the first and last of each content and span of that length,
    so a frequent content makes no pairs: a row looks at its own span and the one
    before."""
    span = lambda at: F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (hours * 3_600_000_000))
    seen = log.groupBy(F.col("content_hash").alias("h"), span("created_at").alias("span")).agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))
    asked = rows.withColumn("_span", span("asked_at"))
    own = seen.select(F.col("h").alias("_h1"), F.col("span").alias("_s1"), F.col("first").alias("_first"))
    past = seen.select(F.col("h").alias("_h2"), (F.col("span") + 1).alias("_s2"), F.col("last").alias("_last"))
    out = asked.join(own, (F.col("content_hash") == F.col("_h1")) & (F.col("_span") == F.col("_s1")), "left").join(past, (F.col("content_hash") == F.col("_h2")) & (F.col("_span") == F.col("_s2")), "left")
    near = (F.col("_first") < F.col("asked_at")) | (F.col("_last") > F.col("asked_at") - F.expr(f"interval {hours} hours"))
    return out.where(near).select(rows.columns)


def retained(log: DataFrame, now: Column, days: int = 365) -> DataFrame:
    return log.where(F.col("created_at") >= now - F.expr(f"interval {days} days"))


def outcome(before: DataFrame, after: DataFrame) -> DataFrame:
    """What became of each category that was or is flagged: (doc_id, id, ord, before,
    after, delta, severity, disposition). Severity decides, not the score: a
    category is flagged as long as its severity names an issue. One that was
    flagged and isn't listed any more stays flagged, with its old severity and no
    ord; one that is clean on both sides has nothing to report. Severity is taken
    from the rows, or from the score where they have none."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        severity = F.col("severity") if "severity" in rows.columns else severity_of(F.col("score"))
        return rows.select("doc_id", "id", F.struct("ord", "score", severity.alias("severity"), F.coalesce(severity.isin(*ISSUES), F.lit(False)).alias("flagged")).alias(name))

    out = side(before, "b").join(side(after, "a"), ["doc_id", "id"], "full_outer")
    delta = F.col("a.score") - F.col("b.score")
    there = F.col("a").isNotNull()
    moved = F.when(F.col("b.score").isNull(), "new").when(delta > 0, "improved").when(delta < 0, "declined").otherwise("unchanged")
    disposition = F.when(there & F.col("a.flagged"), moved).when(F.col("b.flagged"), F.when(there, "fixed").otherwise("unchanged"))
    severity = F.when(there, F.coalesce("a.severity", F.lit(CLEAN))).otherwise(F.col("b.severity"))
    rows = out.select("doc_id", "id", F.col("a.ord").alias("ord"), F.col("b.score").alias("before"), F.col("a.score").alias("after"), delta.alias("delta"), severity.alias("severity"), disposition.alias("disposition"), F.col("b.ord").alias("_old"))
    return rows.where(F.col("disposition").isNotNull())


def job_states(events: DataFrame) -> DataFrame:
    """Current state of each job from its events, the last by (time, id)."""
    return events.groupBy("job_id").agg(F.max_by("status", F.struct("occurred_at", "event_id")).alias("status"), F.count("*").alias("n_events"), F.max("occurred_at").alias("updated_at"))


def admissions(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(key, request_id, at, admitted): a request is admitted while fewer than
    ``limit`` admitted ones lie within the window before it. Refused requests
    don't count, so this is a sequential fold per key; keys are sorted by Spark
    and streamed, so a hot key is never held in memory."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for b in batches:
            ok = []
            for k, t in zip(b["key"], b["us"], strict=True):
                if k != key:
                    key, held = k, []
                held = [x for x in held if x > t - seconds * 1_000_000]
                ok.append(len(held) < limit)
                if ok[-1]:
                    held.append(t)
            yield b.assign(admitted=ok)[["key", "request_id", "us", "admitted"]]

    rows = requests.select("key", "request_id", F.unix_micros(F.col("at").cast("timestamp")).alias("us")).repartition("key").sortWithinPartitions("key", "us", "request_id")
    out = rows.mapInPandas(run, "key long, request_id long, us long, admitted boolean")
    return out.select("key", "request_id", F.timestamp_micros("us").alias("at"), "admitted")


def islands(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Runs of equal neighbouring values: (group, value, first, length)."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    marked = rows.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(group, "island", value).agg(F.min(order).alias("first"), F.count("*").alias("length"))


def outcome_order(outcomes: DataFrame) -> DataFrame:
    """Outcomes of each document in two lists of ids: what is still flagged, worst
    severity first, in the order of the categories within one, those that aren't
    listed any more behind them; and what was fixed, in the order of categories."""
    fixed = F.col("disposition") == "fixed"
    key = F.struct((-severity_rank(F.col("severity"))).alias("r"), F.col("ord").isNull().alias("gone"), F.coalesce("ord", "_old").alias("ord"), F.col("id").alias("id"))
    ids = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, key))), lambda y: y["id"])
    return outcomes.groupBy("doc_id").agg(ids(~fixed).alias("still_flagged"), ids(fixed).alias("fixed"))


def recent_states(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Jobs of the last hours by status."""
    return jobs.where(F.col("created_at") > now - F.expr(f"interval {hours} hours")).groupBy("status").agg(F.count("*").alias("n"))
