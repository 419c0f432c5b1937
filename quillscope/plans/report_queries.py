"""Queries over finished reports: gates, bulk runs, outcomes and uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import lifecycle, reports, scoring
from ..operators.format_scoring import DEFAULT_SHEET
from ..sources import files
from . import adapters as A
from .adapters import table
from .queries import _REPORT, OUTCOMES, query

c = F.col


@query(f"{_REPORT} SELECT count(*) AS reports, count(*) FILTER (overall_score < 60) AS below, min(overall_score) AS lowest, count(*) FILTER (overall_score < 60) = 0 AS passed FROM report")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.threshold_gate(scoring.report(scoring.nest(A.category_results(spark, sf_dir))), 60)


@query("""SELECT user_id AS file, count(*) FILTER (event_id % 5 > 0) AS total, count(*) FILTER (event_id % 5 IN (1, 2)) AS analyzed, count(*) FILTER (event_id % 5 IN (3, 4)) AS failed, count(*) FILTER (event_id % 5 = 0) AS skipped FROM events GROUP BY user_id""")
def bulk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("event_id") % 5
    rows = table(spark, sf_dir, "events").select(c("user_id").alias("file"), (k > 0).alias("is_entry"), F.when(k.isin(1, 2), c("event_id") % 101).alias("overall_score"), F.when(k.isin(3, 4), "timeout").alias("error"))
    return reports.bulk_summary(rows)


@query(f"""WITH {A.AUDIT_LOG} SELECT id AS doc_id, filename, CASE WHEN id % 3 > 0 THEN id % 40 END AS page_count, CASE WHEN id % 4 = 0 THEN 77 ELSE score END AS strict_score, CASE WHEN id % 4 = 0 THEN 'C' ELSE grade END AS strict_grade, created_at FROM audit_log WHERE event_type = 'audit-url'""")
def flat_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir).where("event_type = 'audit-url'")
    rows = log.select(c("id").alias("doc_id"), "filename", F.when(c("id") % 3 > 0, c("id") % 40).alias("page_count"), c("score").alias("overall_score"), "grade", "created_at")
    own = c("doc_id") % 4 == 0
    return reports.flat(rows, F.when(own, 77), F.when(own, "C"))


@query(f"""WITH {A.categories_sql("l_linestatus = 'O'", "b")}, {A.categories_sql("l_linestatus = 'F'", "a")},
 {OUTCOMES}, r AS (SELECT *, CASE severity WHEN 'Critical' THEN 0 WHEN 'Moderate' THEN 1 ELSE 2 END AS rank FROM outcomes)
 SELECT doc_id, coalesce(string_agg(id, ',' ORDER BY rank, ord IS NULL, coalesce(ord, old)) FILTER (disposition <> 'fixed'), '') AS still_flagged,
  coalesce(string_agg(id, ',' ORDER BY ord) FILTER (disposition = 'fixed'), '') AS fixed FROM r GROUP BY doc_id""")
def outcome_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lifecycle.outcome_order(lifecycle.outcome(A.category_results(spark, sf_dir, "O"), A.category_results(spark, sf_dir, "F")))
    return out.select("doc_id", F.array_join("still_flagged", ",").alias("still_flagged"), F.array_join("fixed", ",").alias("fixed"))


@query(f"WITH {A.JOBS} SELECT status, count(*) AS n FROM jobs, jobs_clock WHERE created_at > now - INTERVAL 24 HOURS GROUP BY status")
def jobs_of_the_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = A.jobs(spark, sf_dir)
    clock = jobs.agg(F.max("created_at").alias("now"))
    return lifecycle.recent_states(jobs.join(F.broadcast(clock)), c("now"))  # the clock is one row


@query("""WITH p AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.Xlsx' ELSE '.bin' END AS f, CASE p_partkey % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Application/PDF' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 3 THEN NULL ELSE 'text/html' END AS m,
  ['Sheet1', 'sheet 2', 'Tabelle3', 'Budget', 'Feuil4 (2)', 'Sheet', 'лист 7'][p_partkey % 7 + 1] AS sheet, ['• one', '- two', '1. three', '12) four', 'five', '-six', ' * seven'][p_partkey % 7 + 1] AS line FROM part)
 SELECT k AS p_partkey, k % 5 IN (0, 1) OR k % 7 IN (0, 1) AS accepted, k % 7 NOT IN (3, 5) AS default_sheet, k % 7 NOT IN (4, 5) AS typed_bullet FROM p""")
def uploads_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF and DOCX are enabled here."""
    k = c("p_partkey")
    pick = lambda *xs: F.get(F.array(*(F.lit(x).cast("string") for x in xs)), (k % len(xs)).cast("int"))
    name = F.concat("p_name", F.when(k % 5 == 0, ".PDF").when(k % 5 == 1, ".docx").when(k % 5 == 2, ".Xlsx").otherwise(".bin"))
    media = pick("application/pdf", "Application/PDF", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", None, "text/html", "text/html", "text/html")
    sheet = pick("Sheet1", "sheet 2", "Tabelle3", "Budget", "Feuil4 (2)", "Sheet", "лист 7")
    line = pick("• one", "- two", "1. three", "12) four", "five", "-six", " * seven")
    return table(spark, sf_dir, "part").select("p_partkey", files.accepted(name, media, ("pdf", "docx")).alias("accepted"), sheet.rlike(DEFAULT_SHEET).alias("default_sheet"), text.manual_bullet(line).alias("typed_bullet"))


@query(f"""WITH {A.PDF_RECORDS} SELECT doc_id, k % 5 = 0 AS has_identifier, CASE WHEN k % 5 = 0 THEN '1' END AS part, tree AS is_tagged, FALSE AS is_marked, (k % 9)::INT AS artifact_runs, (k % 4)::INT AS tree_depth, 0 AS fonts, 0 AS embedded_fonts, TRUE AS all_fonts_embedded,
 lang AS has_language, k % 4 IN (1, 2) AS has_title FROM q""")
def pdf_ua_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("doc_id")
    return reports.ua_signals(A.pdf_records(spark, sf_dir).withColumns({"pdfUaPart": F.when(k % 5 == 0, "1"), "artifactCount": (k % 9).cast("int")}))
