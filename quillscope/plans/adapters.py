"""Relations of the domain, derived from the given tables by fixed column
expressions, and the same derivations as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dims import CATEGORY_WEIGHTS
from ..functions.numbers import grade_of

CATEGORY_IDS = ("text_extractability", "title_language", "heading_structure", "alt_text", "bookmarks", "table_markup", "link_quality")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "analyze").when(F.col("event_type") == "view", "audit-url").when(F.col("event_type") == "purchase", "bulk-from-inventory").when(F.col("event_type") == "signup", "rejected-upload").otherwise("audit-url-page")
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".DOCX", ".pptx", ".xlsx", ".doc", ".csv"))), (F.col("event_id") % 6 + 1).cast("int"))
    score = (F.floor(F.abs("value")).cast("int") % 101).cast("int")
    out = e.select(F.col("event_id").alias("id"), kind.alias("event_type"), F.concat(F.lit("f"), F.col("user_id").cast("string"), ext).alias("filename"), score.alias("score"), F.sha2(F.col("user_id").cast("string"), 256).alias("content_hash"), F.when(F.col("event_id") % 7 == 0, 1).when(F.col("event_id") % 7 == 1, None).otherwise(0).alias("privileged"), F.col("ts").alias("created_at"))
    out = out.withColumn("score", F.when(F.col("event_type") != "rejected-upload", F.col("score")))
    return out.withColumn("grade", grade_of(F.col("score")))


AUDIT_LOG = """
audit_log AS (
  SELECT event_id AS id,
    CASE event_type WHEN 'click' THEN 'analyze' WHEN 'view' THEN 'audit-url' WHEN 'purchase' THEN 'bulk-from-inventory' WHEN 'signup' THEN 'rejected-upload' ELSE 'audit-url-page' END AS event_type,
    'f' || user_id || CASE event_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.pptx' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.doc' ELSE '.csv' END AS filename,
    CASE WHEN event_type <> 'signup' THEN CAST(floor(abs(value)) AS INT) % 101 END AS score,
    sha256(CAST(user_id AS VARCHAR)) AS content_hash,
    CASE event_id % 7 WHEN 0 THEN 1 WHEN 1 THEN NULL ELSE 0 END AS privileged, ts AS created_at,
    CASE WHEN event_type = 'signup' THEN NULL WHEN CAST(floor(abs(value)) AS INT) % 101 >= 90 THEN 'A' WHEN CAST(floor(abs(value)) AS INT) % 101 >= 80 THEN 'B' WHEN CAST(floor(abs(value)) AS INT) % 101 >= 70 THEN 'C' WHEN CAST(floor(abs(value)) AS INT) % 101 >= 60 THEN 'D' ELSE 'F' END AS grade
  FROM events),
clock AS (SELECT max(ts) AS now FROM events)"""


def clock(log: DataFrame) -> DataFrame:
    return log.agg(F.max("created_at").alias("now"))


def category_results(spark: SparkSession, sf_dir: str, status: str | None = None) -> DataFrame:
    """One row per document and category; ``status`` keeps one line status."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber") <= len(CATEGORY_IDS))
    if status:
        li = li.where(F.col("l_linestatus") == status)
    # dealt by order once: neither this nor nesting by order shuffles again
    held = F.min_by(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    li = li.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(held.alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("l_linenumber"))
    score = F.when((F.col("l_returnflag") == "N") & (F.col("l_partkey") % 3 == 0), None).otherwise(F.least(F.lit(100), F.col("l_quantity").cast("int") * 2 + (F.col("l_suppkey") % 3).cast("int") * 20))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), pick(CATEGORY_IDS).alias("id"), pick([CATEGORY_WEIGHTS[i] for i in CATEGORY_IDS]).alias("weight"), score.cast("int").alias("score"), ((F.col("l_returnflag") == "N") & (F.col("l_partkey") % 6 == 0)).alias("not_assessed"))


def categories_sql(where: str = "TRUE", name: str = "cat") -> str:
    ids = ", ".join(f"'{i}'" for i in CATEGORY_IDS)
    weights = ", ".join(f"{CATEGORY_WEIGHTS[i]}::DOUBLE" for i in CATEGORY_IDS)
    return f"""
{name}0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn
  FROM lineitem WHERE l_linenumber <= 7 AND ({where})),
{name}1 AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, [{ids}][l_linenumber] AS id, [{weights}][l_linenumber] AS weight,
  CASE WHEN l_returnflag = 'N' AND l_partkey % 3 = 0 THEN NULL ELSE least(100, CAST(l_quantity AS INT) * 2 + CAST(l_suppkey % 3 AS INT) * 20) END::INT AS score,
  (l_returnflag = 'N' AND l_partkey % 6 = 0) AS not_assessed FROM {name}0 WHERE rn = 1),
{name} AS (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN score IS NULL THEN NULL WHEN score >= 100 THEN 'No issues found' WHEN score >= 70 THEN 'Minor' WHEN score >= 40 THEN 'Moderate' ELSE 'Critical' END AS severity FROM {name}1)"""


REPORT = """
counted AS (SELECT doc_id, list(coalesce(score, 100)::DOUBLE ORDER BY ord) AS s, list(weight ORDER BY ord) AS w FROM cat WHERE score IS NOT NULL OR NOT not_assessed GROUP BY doc_id),
total AS (SELECT doc_id, s, w, list_reduce(w, lambda a, b: a + b) AS t FROM counted),
raw AS (SELECT doc_id, CAST(floor(list_reduce(list_transform(s, lambda x, i: x * (w[i] / t)), lambda a, b: a + b) + 0.5) AS INT) AS raw_score FROM total),
worst AS (SELECT doc_id, max(CASE severity WHEN 'Critical' THEN 3 WHEN 'Moderate' THEN 2 WHEN 'Minor' THEN 1 ELSE 0 END) AS rank FROM cat GROUP BY doc_id),
scored AS (SELECT worst.doc_id, coalesce(raw_score, 0) AS raw_score, least(coalesce(raw_score, 0), CASE rank WHEN 3 THEN 69 WHEN 2 THEN 79 WHEN 1 THEN 89 ELSE 100 END) AS overall_score FROM worst LEFT JOIN raw USING (doc_id)),
report AS (SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade, overall_score < raw_score AS is_capped FROM scored)"""


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.substring_index("text", "\n", 1).alias("title"))
    date = F.when(F.col("doc_id") % 17 == 0, None).otherwise(F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 4000).cast("int")), "yyyy-MM-dd"))
    return d.select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.gov/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"), "title", date.alias("publication_date"), grade_of((F.col("doc_id") * 37 % 101).cast("int")).alias("grade"))


PUBLICATIONS = """
pub AS (SELECT doc_id, 'https://' || source || '.example.gov/' || doc_id || '.pdf' AS url, split_part(text, chr(10), 1) AS title,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE strftime(DATE '2015-01-01' + CAST(doc_id % 4000 AS INT), '%Y-%m-%d') END AS publication_date,
  CASE WHEN doc_id * 37 % 101 >= 90 THEN 'A' WHEN doc_id * 37 % 101 >= 80 THEN 'B' WHEN doc_id * 37 % 101 >= 70 THEN 'C' WHEN doc_id * 37 % 101 >= 60 THEN 'D' ELSE 'F' END AS grade FROM documents)"""


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    status = F.when(F.col("quality") == 1, "success").when(F.col("doc_id") % 2 == 0, "permanent_error").otherwise("error")
    return publications(spark, sf_dir).join(labels, "doc_id").select("url", status.alias("status"))


def pdf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis records of made-up documents, one per part, with every defect."""
    k, i = "CAST(p_partkey AS INT)", "CAST(i AS INT)"
    many = lambda n: f"slice(sequence(1, 8), 1, {n})"
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS doc_id", f"CASE WHEN {k} % 97 = 0 THEN 'unreadable' END AS error", f"{k} % 3 <> 0 AS hasStructTree", f"{k} % 7 <> 0 AS hasLang", "CAST(NULL AS STRING) AS lang", f"{k} % 6 = 0 AS hasOutlines", f"{k} % 3 AS outlineCount", f"{k} % 2 = 0 AS hasAcroForm",
        f"transform({many(f'{k} % 3')}, i -> named_struct('name', 'f', 'hasTU', ({k} + {i}) % 2 = 0)) AS formFields",
        f"transform({many(f'{k} % 4')}, i -> named_struct('ref', 'r', 'hasAlt', ({k} + {i}) % 3 <> 0, 'altText', 'x')) AS images", f"{k} % 2 AS imageObjectCount",
        f"transform({many(f'{k} % 5')}, i -> concat('H', 1 + {i} * {k} % 3)) AS headings",
        f"transform({many(f'{k} % 3')}, i -> named_struct('hasHeaders', ({k} + {i}) % 4 <> 0, 'headerCount', 2, 'hasScope', ({k} + {i}) % 5 = 0, 'hasRowStructure', ({k} + {i}) % 6 <> 0, 'rowCount', 3, 'hasNestedTable', ({k} + {i}) % 9 = 0, 'hasCaption', true, 'hasConsistentColumns', ({k} + {i}) % 8 <> 0, 'columnCounts', array({i}, 2), 'hasHeaderAssociation', ({k} + {i}) % 7 = 0)) AS tables",
        f"transform({many(f'{k} % 2')}, i -> named_struct('isWellFormed', {k} % 5 <> 0)) AS lists", f"{k} % 25 AS paragraphCount", f"{k} % 30 + 1 AS totalPageCount",
        "CAST(array() AS array<struct<name:string,embedded:boolean>>) AS fonts", "CAST(NULL AS array<string>) AS visibleFonts", f"CASE {k} % 11 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS accessibilityAllowed", f"{k} % 2 = 0 AS displayDocTitle",
        f"{k} % 50 = 0 AS hasXfa", f"{k} % 100 = 0 AS needsRendering", f"{k} % 4 AS structTreeDepth", "true AS hasContentOrder", f"{k} % 30 + 1 AS pageCount", f"{k} % 5 <> 0 AS hasText", f"CASE WHEN {k} % 5 <> 0 THEN 1000 ELSE 0 END AS textLength",
        f"CASE {k} % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('report_', {k}, '.pdf') WHEN 2 THEN p_name ELSE ' ' END AS title",
        f"transform({many(f'{k} % 4')}, i -> named_struct('url', 'u', 'text', element_at(array('click here', 'Annual report', 'https://a.b'), 1 + ({k} + {i}) % 3), 'tagged', ({k} + {i}) % 4 <> 0)) AS links", f"{k} % 2 AS imageCount", f"CASE WHEN {k} % 6 <> 0 THEN {k} % 5 END AS nonArtifactImageCount",
    )


PDF_RECORDS = """
p0 AS (SELECT p_partkey AS doc_id, CAST(p_partkey AS INT) AS k, p_name FROM part),
p AS (SELECT doc_id, k, p_name, k % 97 = 0 AS bad, k % 3 <> 0 AS tree, k % 7 <> 0 AS lang, k % 5 <> 0 AS txt, k % 30 + 1 AS pages, k % 25 AS paras, k % 3 AS outlines, k % 6 = 0 AS outline_tree,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 'report_' || k || '.pdf' WHEN 2 THEN p_name ELSE ' ' END AS title,
  list_transform(range(1, k % 5 + 1), lambda i: 1 + i * k % 3) AS hs,
  len(list_filter(range(1, k % 4 + 1), lambda i: (k + i) % 3 <> 0)) AS alts, k % 4 AS figs, CASE WHEN k % 97 <> 0 AND k % 6 <> 0 THEN greatest(0, k % 5 - k % 4) END AS loose,
  list_filter(range(1, k % 3 + 1), lambda i: i >= 2) AS ts, k % 4 AS n_links,
  len(list_filter(range(1, k % 4 + 1), lambda i: (k % 3 = 0 OR (k + i) % 4 <> 0) AND (k + i) % 3 = 0)) AS needs,
  CASE WHEN k % 3 <> 0 THEN len(list_filter(range(1, k % 4 + 1), lambda i: (k + i) % 4 = 0)) ELSE 0 END AS untagged,
  k % 3 AS n_fields, len(list_filter(range(1, k % 3 + 1), lambda i: (k + i) % 2 = 0)) AS labelled FROM p0),
q AS (SELECT *, len(ts) AS n, len(hs) > 1 AND len(list_filter(range(1, len(hs)), lambda i: hs[i + 1] - hs[i] > 1)) > 0 AS jump,
  len(list_filter(ts, lambda i: (k + i) % 4 <> 0)) AS heads, len(list_filter(ts, lambda i: (k + i) % 6 <> 0)) AS trs,
  len(list_filter(ts, lambda i: (k + i) % 4 <> 0 AND ((k + i) % 5 = 0 OR (k + i) % 7 = 0))) AS bound, len(list_filter(ts, lambda i: (k + i) % 5 = 0 OR (k + i) % 7 = 0)) AS anybound,
  len(list_filter(ts, lambda i: (k + i) % 9 = 0)) AS nested, len(list_filter(ts, lambda i: (k + i) % 8 <> 0)) AS even FROM p)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remediation jobs made of orders."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'pending' END END AS status", "o_orderdate AS created_at",
        "CASE WHEN o_orderstatus IN ('F', 'P') AND o_orderkey % 5 <> 0 THEN o_orderdate + make_interval(0, 0, 0, 0, CAST(o_orderkey % 100 AS INT)) END AS completed_at",
        "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 400 AS INT)) END AS expires_at",
        "CAST(o_orderkey * 37 % 101 AS INT) AS input_score", "CAST(o_orderkey * 53 % 101 AS INT) AS output_score", "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 29 % 101 AS INT) END AS input_strict", "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey * 31 % 101 AS INT) END AS output_strict",
    )


JOBS = """
jobs AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'failed' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'pending' END END AS status, o_orderdate AS created_at,
  CASE WHEN o_orderstatus IN ('F', 'P') AND o_orderkey % 5 <> 0 THEN o_orderdate + to_hours(CAST(o_orderkey % 100 AS INT)) END AS completed_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey % 400 AS INT)) END AS expires_at,
  CAST(o_orderkey * 37 % 101 AS INT) AS input_score, CAST(o_orderkey * 53 % 101 AS INT) AS output_score, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 29 % 101 AS INT) END AS input_strict, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey * 31 % 101 AS INT) END AS output_strict FROM orders),
jobs_clock AS (SELECT max(o_orderdate) AS now FROM orders)"""

EVENT_KINDS = ("received", "processing_started", "normalize_complete", "input_deleted", "tagging_complete", "intermediate_deleted", "validation_passed", "validation_failed", "verapdf_passed", "verapdf_failed", "verapdf_unavailable", "output_ready", "downloaded", "output_deleted", "verified_absent", "verify_failed", "error", "expired")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of jobs made of the event stream."""
    kinds = ", ".join(f"'{k}'" for k in EVENT_KINDS)
    return table(spark, sf_dir, "events").selectExpr("user_id AS job_id", "event_id", "ts AS occurred_at", f"element_at(array({kinds}), CAST(event_id % 18 AS INT) + 1) AS event")


JOB_EVENTS = f"job_events AS (SELECT user_id AS job_id, event_id, ts AS occurred_at, [{', '.join(f"'{k}'" for k in EVENT_KINDS)}][event_id % 18 + 1] AS event FROM events)"
