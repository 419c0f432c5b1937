"""Named queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import color, numbers, text, urls
from ..operators import extraction, fleet, format_scoring, lifecycle, reports, scoring, web_scoring
from ..sources import web
from . import adapters as A
from .adapters import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_REPORT = f"WITH {A.categories_sql()}, {A.REPORT}"


@query(f"{_REPORT} SELECT doc_id, raw_score, overall_score, grade, is_capped FROM report")
def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.report(scoring.nest(A.category_results(spark, sf_dir))).drop("categories")


@query(f"{_REPORT} SELECT count(*) AS total, count(*) FILTER (grade = 'A') AS A, count(*) FILTER (grade = 'B') AS B, count(*) FILTER (grade = 'C') AS C, count(*) FILTER (grade = 'D') AS D, count(*) FILTER (grade = 'F') AS F FROM report")
def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.grade_distribution(scoring.report(scoring.nest(A.category_results(spark, sf_dir))))


@query(f"""WITH {A.categories_sql()} SELECT doc_id,
 count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'Moderate') AS moderate, count(*) FILTER (severity = 'Minor') AS minor,
 count(*) FILTER (score IS NOT NULL OR NOT not_assessed) AS counted, count(*) FILTER ((score IS NOT NULL OR NOT not_assessed) AND coalesce(score, 100) = 100) AS passed,
 CASE WHEN count(*) FILTER (severity = 'Critical') > 0 THEN 'not_ready' WHEN count(*) FILTER (severity = 'Moderate') > 0 THEN 'fix_first' ELSE 'ready' END AS verdict
 FROM cat GROUP BY doc_id""")
def severity_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.nest(A.category_results(spark, sf_dir))
    counts = {n: c.cast("long") for n, c in scoring.tally(F.col("categories")).items()}
    return d.withColumns(counts).withColumn("verdict", scoring.verdict(F.col("critical"), F.col("moderate"))).drop("categories")


@query(f"""WITH {A.categories_sql()} SELECT doc_id, string_agg(id || ' is wrong; seen ' || score || ' times', '; ' ORDER BY ord) FILTER (severity = 'Critical') AS critical_findings FROM cat GROUP BY doc_id""")
def critical_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of critical categories as one text."""
    found = lambda c: F.array(F.concat(c["id"], F.lit(" is wrong")), F.concat(F.lit("seen "), c["score"].cast("string"), F.lit(" times")))
    nested = scoring.nest(A.category_results(spark, sf_dir))
    cats = F.transform("categories", lambda c: c.withField("findings", found(c)))
    return nested.select("doc_id", reports.critical_findings(cats).alias("critical_findings"))


@query("WITH " + A.categories_sql() + " SELECT doc_id, " + ", ".join(f"max({c}) FILTER (id = '{i}') AS {i}_{c}" for i in A.CATEGORY_IDS for c in ("score", "grade", "severity")) + " FROM cat GROUP BY doc_id")
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.category_pivot(scoring.with_severity(A.category_results(spark, sf_dir)), list(A.CATEGORY_IDS))


@query(f"""WITH {A.categories_sql()} SELECT doc_id, ord, id, severity,
 row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'Moderate' THEN 1 ELSE 2 END, ord)::INT AS rank
 FROM cat WHERE severity IN ('Critical', 'Moderate', 'Minor')""")
def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.array_sort(F.transform(F.filter("categories", lambda c: c["severity"].isin("Critical", "Moderate", "Minor")), lambda c: F.struct((3 - numbers.severity_rank(c["severity"])).alias("r"), c["ord"].alias("ord"), c["id"].alias("id"), c["severity"].alias("severity"))))
    rows = scoring.nest(A.category_results(spark, sf_dir)).select("doc_id", F.posexplode(order).alias("p", "c"))
    return rows.select("doc_id", "c.ord", "c.id", "c.severity", (F.col("p") + 1).cast("int").alias("rank"))


@query(f"""WITH {A.categories_sql()} SELECT doc_id, id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score, ord)::INT AS step FROM cat WHERE score < 90""")
def prioritized_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.array_sort(F.transform(F.filter("categories", lambda c: c["score"] < 90), lambda c: F.struct(c["score"].alias("score"), c["ord"].alias("ord"), c["id"].alias("id"))))
    rows = scoring.nest(A.category_results(spark, sf_dir)).select("doc_id", F.posexplode(low).alias("p", "c"))
    return rows.select("doc_id", "c.id", "c.score", (F.col("p") + 1).cast("int").alias("step"))


_ISSUE = "({0}.severity IS NOT NULL AND {0}.severity IN ('Critical', 'Moderate', 'Minor'))"
OUTCOMES = f"""outcomes AS (SELECT * FROM (
  SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.id, a.id) AS id, a.ord, b.ord AS old, b.score AS before, a.score AS after, a.score - b.score AS delta,
   CASE WHEN a.id IS NOT NULL THEN coalesce(a.severity, 'No issues found') ELSE b.severity END AS severity,
   CASE WHEN {_ISSUE.format("a")} THEN CASE WHEN b.score IS NULL THEN 'new' WHEN a.score > b.score THEN 'improved' WHEN a.score < b.score THEN 'declined' ELSE 'unchanged' END
    WHEN {_ISSUE.format("b")} THEN CASE WHEN a.id IS NULL THEN 'unchanged' ELSE 'fixed' END END AS disposition
  FROM b FULL JOIN a ON a.doc_id = b.doc_id AND a.id = b.id) WHERE disposition IS NOT NULL)"""
_LADDER = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


@query(f"""{_REPORT}, k AS (SELECT doc_id, min(CASE severity WHEN 'Critical' THEN 69 WHEN 'Moderate' THEN 79 WHEN 'Minor' THEN 89 ELSE 100 END) AS ceiling FROM cat GROUP BY doc_id),
 u AS (SELECT doc_id, count(*) FILTER (score IS NOT NULL OR NOT not_assessed) AS counted FROM cat GROUP BY doc_id),
 s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 95 WHEN doc_id % 3 = 0 THEN raw_score ELSE overall_score END AS stored, CASE WHEN doc_id % 5 = 0 THEN '?' ELSE grade END AS stored_grade, raw_score, ceiling,
   doc_id % 7 = 0 OR counted = 0 AS broken FROM report JOIN k USING (doc_id) JOIN u USING (doc_id)),
 n AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE least(ceiling, CASE WHEN broken THEN stored ELSE raw_score END) END AS score, least(ceiling, CASE WHEN broken THEN 97 ELSE raw_score END) AS strict FROM s)
 SELECT doc_id, score::INT AS overall_score, CASE WHEN score <> stored THEN {_LADDER.format("score")} ELSE stored_grade END AS grade, score <> stored AS changed,
  'strict:' || strict::INT || ':' || CASE WHEN strict <> 97 THEN {_LADDER.format("strict")} ELSE 'kept' END AS profiles FROM n""")
def stored_reports_regraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the stored reports a third keeps the score it had before the cap, a
    seventh has weights that can't be used, an eleventh was scanned; all have a
    profile that was stored with 97."""
    r = scoring.report(scoring.nest(A.category_results(spark, sf_dir)))
    broken, old = F.col("doc_id") % 7 == 0, F.col("doc_id") % 3 == 0
    score = F.when(broken, 95).when(old, F.col("raw_score")).otherwise(F.col("overall_score"))
    cats = F.transform("categories", lambda c: c.withField("weight", F.when(broken, -1.0).otherwise(c["weight"])))
    profile = F.struct(F.lit(97).alias("overallScore"), F.lit("kept").alias("grade"), cats.alias("categories"))
    grade = F.when(F.col("doc_id") % 5 == 0, "?").otherwise(F.col("grade"))
    whole = F.struct(score.alias("overallScore"), grade.alias("grade"), (F.col("doc_id") % 11 == 0).alias("isScanned"), cats.alias("categories"), F.struct(profile.alias("strict")).alias("scoreProfiles"))
    out = scoring.regrade(r.select("doc_id", F.to_json(whole).alias("report_json")))
    shown = F.transform(F.map_entries("profiles"), lambda e: F.concat_ws(":", e["key"], e["value"]["overall_score"].cast("string"), e["value"]["grade"]))
    return out.withColumn("profiles", F.array_join(shown, ","))


@query(f"""WITH {A.categories_sql("l_linestatus = 'O'", "b")}, {A.categories_sql("l_linestatus = 'F'", "a")}, {OUTCOMES} SELECT doc_id, id, before, after, delta, severity, disposition FROM outcomes""")
def remediation_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.outcome(A.category_results(spark, sf_dir, "O"), A.category_results(spark, sf_dir, "F")).drop("ord", "_old")


_DOCS = "event_type IN ('analyze', 'audit-url', 'bulk-from-inventory')"
_SPANS = {"all": "TRUE", "day": "created_at > now - INTERVAL 24 HOURS", "month": "created_at > now - INTERVAL 30 DAYS"}
_KINDS = {"documents": _DOCS, "pages": "event_type = 'audit-url-page'", "privileged": f"{_DOCS} AND privileged = 1"}


@query(f"WITH {A.AUDIT_LOG} SELECT " + ", ".join(f"count(*) FILTER (({k}) AND ({s})) AS {n}_{m}" for n, k in _KINDS.items() for m, s in _SPANS.items()) + f", max(created_at) FILTER ({_DOCS}) AS last_document FROM audit_log, clock")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir)
    # the clock is one row
    return fleet.window_counts(log.join(F.broadcast(A.clock(log))), F.col("now"))


def _filled(keys: tuple[str, ...], name: str, counts: str) -> str:
    """SQL of counts with a row for every key."""
    every = ", ".join(f"('{k}')" for k in keys)
    return f"n AS ({counts}) SELECT k.{name}, coalesce(n_all, 0) AS n_all, coalesce(n_month, 0) AS n_month FROM (VALUES {every}) k({name}) LEFT JOIN n ON n.{name} = k.{name}"


@query(f"""WITH {A.AUDIT_LOG}, {_filled(fleet.FORMAT_KEYS, "format", f"""SELECT CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' WHEN lower(filename) LIKE '%.docx' THEN 'docx' WHEN lower(filename) LIKE '%.pptx' THEN 'pptx' WHEN lower(filename) LIKE '%.xlsx' THEN 'xlsx' ELSE 'unknown_extension' END AS format,
 count(*) AS n_all, count(*) FILTER (created_at > now - INTERVAL 30 DAYS) AS n_month FROM audit_log, clock WHERE {_DOCS} GROUP BY 1""")}""")
def status_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir)
    counts = fleet.counts_by(log.join(F.broadcast(A.clock(log))), fleet.format_of(F.col("filename")), "format", F.col("now"))
    return fleet.zero_filled(counts, "format", fleet.FORMAT_KEYS)


@query(f"""WITH {A.AUDIT_LOG}, {_filled(fleet.GRADE_KEYS, "grade_bucket", f"SELECT coalesce(upper(grade), 'ungraded') AS grade_bucket, count(*) AS n_all, count(*) FILTER (created_at > now - INTERVAL 30 DAYS) AS n_month FROM audit_log, clock WHERE {_DOCS} GROUP BY 1")}""")
def status_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir)
    counts = fleet.counts_by(log.join(F.broadcast(A.clock(log))), fleet.grade_bucket(F.col("grade")), "grade_bucket", F.col("now"))
    return fleet.zero_filled(counts, "grade_bucket", fleet.GRADE_KEYS)


@query(f"""WITH {A.AUDIT_LOG}, f AS (SELECT *, CASE WHEN lower(filename) LIKE '%.doc' THEN 'doc' WHEN lower(filename) LIKE '%.xls' THEN 'xls' WHEN lower(filename) LIKE '%.ppt' THEN 'ppt' WHEN lower(filename) LIKE '%.rtf' THEN 'rtf' WHEN lower(filename) LIKE '%.csv' OR lower(filename) LIKE '%.tsv' THEN 'csv' ELSE 'other' END AS format FROM audit_log, clock WHERE event_type = 'rejected-upload'),
 n AS (SELECT format, count(*) AS n_all, count(*) FILTER (created_at > now - INTERVAL 24 HOURS) AS n_day, count(*) FILTER (created_at > now - INTERVAL 30 DAYS) AS n_month FROM f GROUP BY format),
 k AS (SELECT k.format, coalesce(n_all, 0)::BIGINT AS n_all, coalesce(n_day, 0)::BIGINT AS n_day, coalesce(n_month, 0)::BIGINT AS n_month FROM (VALUES ('doc'), ('xls'), ('ppt'), ('rtf'), ('csv'), ('other')) k(format) LEFT JOIN n ON n.format = k.format)
 SELECT * FROM k UNION ALL SELECT 'total', sum(n_all)::BIGINT, sum(n_day)::BIGINT, sum(n_month)::BIGINT FROM k""")
def refused_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir)
    return fleet.refused_uploads(log.join(F.broadcast(A.clock(log))), F.col("now"))  # the clock is one row


@query(f"""WITH {A.categories_sql()}, s AS (SELECT doc_id, CASE WHEN severity = 'No issues found' AND ord % 2 = 0 THEN 'Pass' ELSE severity END AS severity FROM cat)
 SELECT doc_id, (count(*) FILTER (severity = 'Critical'))::INTEGER AS critical, (count(*) FILTER (severity = 'Moderate'))::INTEGER AS moderate, (count(*) FILTER (severity = 'Minor'))::INTEGER AS minor, (count(*) FILTER (severity = 'Pass'))::INTEGER AS pass,
  (count(*) FILTER (severity IN ('Critical', 'Moderate', 'Minor', 'Pass')))::INTEGER AS total FROM s GROUP BY doc_id""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities by name; a name that isn't known counts nowhere."""
    named = F.transform("categories", lambda c: F.when((c["severity"] == "No issues found") & (c["ord"] % 2 == 0), "Pass").otherwise(c["severity"]))
    return scoring.nest(A.category_results(spark, sf_dir)).select("doc_id", scoring.severity_counts(named).alias("n")).select("doc_id", "n.*")


@query(f"""WITH {A.AUDIT_LOG} SELECT CASE WHEN regexp_extract(lower(filename), '\\.([a-z]+)$', 1) IN ('doc', 'xls', 'ppt', 'rtf', 'csv') THEN regexp_extract(lower(filename), '\\.([a-z]+)$', 1) WHEN lower(filename) LIKE '%.tsv' THEN 'csv' ELSE 'other' END AS format, count(*) AS n
 FROM audit_log WHERE event_type = 'rejected-upload' GROUP BY 1""")
def rejected_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.regexp_extract(F.lower("filename"), r"\.([a-z]+)$", 1)
    kind = F.when(ext.isin("doc", "xls", "ppt", "rtf", "csv"), ext).when(ext == "tsv", "csv").otherwise("other")
    return A.audit_log(spark, sf_dir).where("event_type = 'rejected-upload'").groupBy(kind.alias("format")).agg(F.count("*").alias("n"))


@query(f"""WITH {A.AUDIT_LOG} SELECT content_hash, id, filename, score, created_at FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY created_at DESC, id DESC) AS rn FROM audit_log) WHERE rn = 1""")
def latest_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir).select("content_hash", "id", "filename", "score", "created_at")
    return lifecycle.latest(log, "content_hash", F.col("created_at"), F.col("id"))


@query(f"""WITH {A.AUDIT_LOG} SELECT DISTINCT r.id FROM audit_log r JOIN audit_log s ON r.content_hash = s.content_hash AND s.created_at < r.created_at AND s.created_at > r.created_at - INTERVAL 1 HOUR""")
def audited_recently(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir)
    asked = log.select("id", "content_hash", F.col("created_at").alias("asked_at"))
    return lifecycle.audited_within(asked, log).select("id")


@query(f"""WITH {A.AUDIT_LOG} SELECT count(*) FILTER (created_at >= now - INTERVAL 14 DAYS) AS kept, count(*) FILTER (created_at < now - INTERVAL 14 DAYS) AS purged FROM audit_log, clock""")
def retention_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = A.audit_log(spark, sf_dir)
    keep = F.col("created_at") >= F.col("now") - F.expr("interval 14 days")
    return log.join(F.broadcast(A.clock(log))).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("purged"))


@query(f"""WITH {A.PUBLICATIONS}, c AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id)
 SELECT pub.doc_id, url FROM pub LEFT JOIN c USING (doc_id) WHERE c.doc_id IS NULL OR (q <> 1 AND pub.doc_id % 2 <> 0)""")
def pending_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.pending(A.publications(spark, sf_dir), A.cache(spark, sf_dir)).select("doc_id", "url")


@query(f"""WITH {A.PUBLICATIONS}, e AS (SELECT coalesce(CASE WHEN publication_date >= '2019-01-01' THEN 'recent' ELSE 'legacy' END, 'legacy') AS era, grade FROM pub),
 g AS (SELECT CASE WHEN grouping(era) = 1 THEN 'all' ELSE era END AS era, count(*) AS total, count(*) FILTER (grade = 'A') AS A, count(*) FILTER (grade = 'B') AS B, count(*) FILTER (grade = 'C') AS C, count(*) FILTER (grade = 'D') AS D, count(*) FILTER (grade = 'F') AS F FROM e GROUP BY GROUPING SETS ((era), ())),
 p AS (SELECT *, floor((A + B) / total::DOUBLE * 100 + 0.5)::INT AS passing_pct, floor((D + F) / total::DOUBLE * 100 + 0.5)::INT AS failing_pct, floor((C + D + F) / total::DOUBLE * 100 + 0.5)::INT AS needs_pct FROM g)
 SELECT *, CASE WHEN passing_pct >= 80 THEN 'good' WHEN passing_pct >= 50 THEN 'mixed' WHEN failing_pct >= 60 THEN 'critical' ELSE 'concern' END AS level FROM p""")
def era_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.eras(A.publications(spark, sf_dir))


@query(f"""WITH {A.PUBLICATIONS} SELECT doc_id, publication_date, row_number() OVER (ORDER BY publication_date DESC NULLS LAST, title ASC NULLS FIRST, doc_id) AS place FROM pub QUALIFY place <= 100""")
def newest_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = fleet.newest_first(A.publications(spark, sf_dir)).limit(100)  # a hundred rows, numbered in one task
    order = Window.orderBy(F.desc_nulls_last("publication_date"), F.asc_nulls_first("title"), "doc_id")
    return top.select("doc_id", "publication_date", F.row_number().over(order).cast("long").alias("place"))


@query(f"""WITH {A.PUBLICATIONS} SELECT doc_id, publication_date, title FROM pub ORDER BY publication_date DESC NULLS LAST, title ASC NULLS FIRST, doc_id""")
def all_publications_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.newest_first(A.publications(spark, sf_dir)).select("doc_id", "publication_date", "title")


_STRIP = "regexp_replace({0}, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g')"
_VAGUE = ", ".join(f"'{v}'" for v in text.VAGUE_LINKS)
_LINKS = f"""link AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a[\\s>][^>]*>?(.*?)</a>', 1)) AS raw FROM pages),
 l AS (SELECT page_id, {_STRIP.format("regexp_replace(raw, '<[^>]*>', '', 'g')")} AS txt FROM link),
 c AS (SELECT page_id, txt, CASE WHEN lower(txt) = '' THEN 'needsFix' WHEN regexp_matches(lower(txt), '^(https?://|www\\.)') THEN 'rawUrl'
  WHEN regexp_replace(lower(txt), '[.!?:;\\s]+$', '') IN ({_VAGUE}) OR length(regexp_replace(lower(txt), '[^a-z0-9]', '', 'g')) <= 2 THEN 'needsFix' ELSE 'descriptive' END AS kind FROM l)"""


@query(f"WITH {_LINKS} SELECT page_id, kind, count(*) AS n FROM c GROUP BY ALL")
def link_text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = web.web_features(table(spark, sf_dir, "pages")).select("page_id", F.explode("links").alias("t"))
    return links.groupBy("page_id", text.classify_link(F.col("t")).alias("kind")).agg(F.count("*").alias("n"))


_WEB = f"""{_LINKS}, ls AS (SELECT page_id, count(*) AS n, count(*) FILTER (kind = 'needsFix') AS bad FROM c GROUP BY page_id),
 f AS (SELECT page_id, nullif(regexp_extract(html, '(?i)<html[^>]*\\slang=["'']?([A-Za-z-]+)', 1), '') AS lang,
   nullif({_STRIP.format("regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')")}, '') AS title,
   list_transform(regexp_extract_all(html, '(?i)<h([1-6])[\\s>]', 1), lambda x: x::INT) AS hs FROM pages),
 s AS (SELECT f.page_id AS doc_id, f.*, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad,
   len(hs) > 1 AND len(list_filter(range(1, len(hs)), lambda i: hs[i + 1] - hs[i] > 1)) > 0 AS jump FROM f LEFT JOIN ls USING (page_id)),
 named AS (SELECT *, title IS NOT NULL AND (regexp_matches(title, '(?i)\\.(pdf|docx?|xlsx?|pptx?|rtf|odt|indd|txt|html?)$') OR regexp_matches(title, '(?i)^(microsoft (word|excel|powerpoint) - |untitled\\b|document\\d+$|scan[ _-]?\\d|img[ _-]?\\d|dsc[ _-]?\\d)')
   OR regexp_matches(title, '(?i)\\d{{6}}t\\d{{6,}}') OR regexp_matches(title, '\\d{{12,}}') OR (NOT regexp_matches(title, '\\s') AND (contains(title, '_') OR length(title) - length(replace(title, '-', '')) >= 2 OR (length(title) >= 20 AND regexp_matches(title, '\\d'))))) AS filey FROM s),
 cat1 AS (SELECT doc_id, 1 AS ord, 'title_language' AS id, 0.15::DOUBLE AS weight, (CASE WHEN title IS NULL THEN 0 WHEN filey THEN 25 ELSE 50 END + CASE WHEN lang IS NULL THEN 0 ELSE 50 END)::INT AS score FROM named
  UNION ALL SELECT doc_id, 2, 'heading_structure', 0.15, CASE WHEN len(hs) = 0 THEN 0 WHEN jump THEN 60 ELSE 100 END FROM named
  UNION ALL SELECT doc_id, 3, 'alt_text', 0.15, NULL FROM named
  UNION ALL SELECT doc_id, 4, 'link_quality', 0.05, CASE WHEN n = 0 THEN NULL ELSE floor(100 * (n - bad) / n::DOUBLE + 0.5)::INT END FROM named),
 cat AS (SELECT *, FALSE AS not_assessed, CASE WHEN score IS NULL THEN NULL WHEN score >= 100 THEN 'No issues found' WHEN score >= 70 THEN 'Minor' WHEN score >= 40 THEN 'Moderate' ELSE 'Critical' END AS severity FROM cat1),
 {A.REPORT}"""


@query(f"WITH {_WEB} SELECT doc_id, raw_score, overall_score, grade, is_capped FROM report")
def web_page_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = web_scoring.web_categories(web.web_features(table(spark, sf_dir, "pages")))
    return scoring.report(scoring.nest(cats)).drop("categories")


@query(f"WITH {_WEB} SELECT count(*) AS total, count(*) FILTER (grade = 'A') AS A, count(*) FILTER (grade = 'B') AS B, count(*) FILTER (grade = 'C') AS C, count(*) FILTER (grade = 'D') AS D, count(*) FILTER (grade = 'F') AS F FROM report")
def web_grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.grade_distribution(web_page_reports(spark, sf_dir))


_HEX = "lpad(to_hex(({0} * 2654435 + 97) % 16777216), 6, '0')"


def _channel(c: str, at: int) -> str:
    s = f"(('0x' || substr({c}, {at}, 2))::INT / 255.0::DOUBLE)"
    return f"(CASE WHEN {s} <= 0.03928::DOUBLE THEN {s} / 12.92::DOUBLE ELSE pow(({s} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def _lum(c: str) -> str:
    return f"(0.2126::DOUBLE * {_channel(c, 1)} + 0.7152::DOUBLE * {_channel(c, 3)} + 0.0722::DOUBLE * {_channel(c, 5)})"


@query(f"""WITH x AS (SELECT p_partkey, upper({_HEX.format("p_partkey")}) AS fore, upper({_HEX.format("(p_partkey * 7 + p_size)")}) AS back, p_size AS points, p_partkey % 2 = 0 AS bold FROM part),
 y AS (SELECT *, {_lum("fore")} AS a, {_lum("back")} AS b FROM x),
 z AS (SELECT *, (greatest(a, b) + 0.05::DOUBLE) / (least(a, b) + 0.05::DOUBLE) AS r FROM y)
 SELECT p_partkey, fore, back, floor(r * 100 + 0.5) / 100 AS ratio, r >= CASE WHEN points >= 18 OR (bold AND points >= 14) THEN 3.0 ELSE 4.5 END AS passes FROM z""")
def color_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = lambda x: F.lpad(F.hex((x * 2654435 + 97) % 16777216), 6, "0")
    x = table(spark, sf_dir, "part").select("p_partkey", color.normal_hex(code(F.col("p_partkey"))).alias("fore"), color.normal_hex(code(F.col("p_partkey") * 7 + F.col("p_size"))).alias("back"), F.col("p_size").alias("points"), (F.col("p_partkey") % 2 == 0).alias("bold"))
    r = x.withColumn("r", color.contrast(F.col("fore"), F.col("back")))
    return r.select("p_partkey", "fore", "back", (F.floor(F.col("r") * 100 + 0.5) / 100).alias("ratio"), color.contrast_passes(F.col("r"), F.col("points"), F.col("bold")).alias("passes"))


@query("""SELECT conv_id, turn, '"' || replace(text, '"', '""') || '"' AS field FROM conversations WHERE regexp_matches(text, '[,"\\n\\r]') AND NOT regexp_matches(text, '^[=+\\-@\\t\\r]')
 UNION ALL SELECT conv_id, turn, '"' || replace('''' || text, '"', '""') || '"' FROM conversations WHERE regexp_matches(text, '[,"\\n\\r]') AND regexp_matches(text, '^[=+\\-@\\t\\r]')
 UNION ALL SELECT conv_id, turn, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE coalesce(text, '') END FROM conversations WHERE text IS NULL OR NOT regexp_matches(text, '[,"\\n\\r]')""")
def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.csv_field(F.col("text")).alias("field"))


@query("""SELECT doc_id, count(*) FILTER (regexp_matches(line, '^\\s*([•‣◦⁃∙*-]|\\d+[.)])\\s+')) AS bullets, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) GROUP BY doc_id""")
def typed_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.filter(lines, text.manual_bullet)).cast("long").alias("bullets"), F.size(lines).cast("long").alias("n_lines"))


@query("""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM pages)
 SELECT page_id, CASE WHEN scheme = '' OR host = '' THEN 'malformed' WHEN scheme NOT IN ('http', 'https') THEN 'scheme'
  WHEN regexp_matches(host, '^(localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0)$|\\.(local|internal)$|^10\\.|^192\\.168\\.|^172\\.(1[6-9]|2[0-9]|3[01])\\.|^169\\.254\\.') THEN 'private'
  WHEN host = 'example.com' OR host LIKE '%.example.com' OR host = 'example.org' OR host LIKE '%.example.org' THEN 'ok' ELSE 'not_listed' END AS decision FROM u""")
def url_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.url_decision(F.col("url"), ("example.com", "example.org")).alias("decision"))


@query("""WITH a AS (SELECT event_id, (user_id * 7 % 256) || '.' || (event_id % 256) || '.' || (event_id % 7) || '.1' AS ip, user_id * 7 % 256 AS a, event_id % 256 AS b FROM events)
 SELECT event_id, ip, a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b BETWEEN 18 AND 19) OR a >= 224 AS private FROM a""")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: c.cast("string")
    ip = F.concat_ws(".", part(F.col("user_id") * 7 % 256), part(F.col("event_id") % 256), part(F.col("event_id") % 7), F.lit("1"))
    return table(spark, sf_dir, "events").select("event_id", ip.alias("ip")).withColumn("private", urls.private_v4(F.col("ip")))


@query("""WITH j AS (SELECT o_custkey AS job_id, o_orderkey AS event_id, o_orderdate AS occurred_at, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'failed' END AS status FROM orders),
 k AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY occurred_at DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY job_id) AS n_events FROM j)
 SELECT job_id, status, n_events, occurred_at AS updated_at FROM k WHERE rn = 1""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return lifecycle.job_states(o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("occurred_at"), status.alias("status")))


@query("""WITH j AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1) SELECT status, n, floor(n / (sum(n) OVER ())::DOUBLE * 100 + 0.5)::INT AS share FROM j""")
def job_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    counts = table(spark, sf_dir, "orders").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("status", "n", numbers.percent(F.col("n"), F.col("total")).alias("share"))


@query("""WITH t AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM t)
 SELECT conv_id, role, min(turn) AS first, count(*) AS length FROM i GROUP BY conv_id, island, role""")
def neighbour_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return lifecycle.islands(turns, "conv_id", "turn", "role").drop("island")


@query("""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS request_id, ts AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 w AS (SELECT key, n, request_id, moment, [moment] AS held, TRUE AS admitted FROM r WHERE n = 1
  UNION ALL SELECT key, n, request_id, moment, CASE WHEN len(k) < 3 THEN list_append(k, moment) ELSE k END, len(k) < 3 FROM (SELECT r.key, r.n, r.request_id, r.moment, list_filter(w.held, lambda x: x > r.moment - INTERVAL 1 DAY) AS k FROM w JOIN r ON r.key = w.key AND r.n = w.n + 1))
 SELECT key, request_id, moment AS at, admitted FROM w""")
def admission_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.col("ts").alias("at"))
    return lifecycle.admissions(e, limit=3, seconds=86_400)


_LCS_ROW = "list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda acc, j: list_append(acc, CASE WHEN b[j[1]] = x[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], acc[j[1]]) END), [0::BIGINT])"


@query(f"""WITH p AS (SELECT l_orderkey AS doc_id, (l_suppkey % 3)::INT AS page, list(l_linenumber::BIGINT ORDER BY l_partkey, l_linenumber) AS s, list(l_linenumber::BIGINT ORDER BY l_shipdate, l_linenumber) AS t FROM lineitem GROUP BY 1, 2),
 c AS (SELECT doc_id, page, list_filter(s, lambda x: list_contains(t, x)) AS a, list_filter(t, lambda x: list_contains(s, x)) AS b, len(list_distinct(list_filter(s, lambda x: list_contains(t, x)))) AS n FROM p),
 l AS (SELECT doc_id, page, n, list_reduce(list_transform(a, lambda x: [x]), lambda prev, x: {_LCS_ROW}, list_transform(range(0, len(b) + 1), lambda i: 0::BIGINT))[-1] / greatest(len(a), len(b))::DOUBLE AS sim FROM c WHERE n >= 2),
 d AS (SELECT doc_id, list(sim * n ORDER BY page) AS parts, sum(n)::DOUBLE AS total, count(*) AS pages, list(page ORDER BY page) FILTER (sim < 0.8) AS drift FROM l GROUP BY doc_id),
 e AS (SELECT *, list_reduce(parts, lambda x, y: x + y) / total AS f FROM d)
 SELECT doc_id, CASE WHEN f >= 0.97 THEN 100 WHEN f >= 0.9 THEN 90 WHEN f >= 0.8 THEN 85 WHEN f >= 0.5 THEN 65 ELSE 30 END AS score, floor(f * 100 + 0.5)::INT AS similarity_pct, pages::INT AS pages_analyzed, coalesce(len(drift), 0)::INT AS pages_with_drift, coalesce(array_to_string(drift, ','), '') AS drift_pages FROM e""")
def reading_order_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).cast("int").alias("page"), F.col("l_linenumber").cast("int").alias("mcid"), "l_shipdate", "l_partkey")
    orders = lambda *by: F.transform(F.array_sort(F.collect_list(F.struct(*by, "mcid"))), lambda x: x["mcid"])
    pages = li.groupBy("doc_id", "page").agg(orders("l_partkey").alias("struct_order"), orders("l_shipdate").alias("stream_order"))
    out = scoring.reading_order(pages.withColumn("figures", F.array().cast("array<int>")))
    return out.withColumn("drift_pages", F.array_join(F.col("drift_pages").cast("array<string>"), ","))


_PDF_SCORES = """SELECT doc_id, 'text_extractability' AS id, CASE WHEN k % 11 = 0 THEN 0 WHEN txt AND tree THEN 100 WHEN txt THEN 50 WHEN tree THEN 25 ELSE 0 END AS score, FALSE AS not_assessed FROM q
 UNION ALL SELECT doc_id, 'title_language', CASE WHEN k % 4 IN (0, 3) THEN 0 WHEN k % 4 = 1 THEN 25 WHEN k % 2 = 0 THEN 50 ELSE 35 END + CASE WHEN lang THEN 50 ELSE 0 END, FALSE FROM q
 UNION ALL SELECT doc_id, 'heading_structure', CASE WHEN len(hs) = 0 THEN CASE WHEN pages >= 4 OR paras >= 20 OR outlines > 0 THEN 0 END WHEN jump THEN 60 ELSE 100 END, FALSE FROM q
 UNION ALL SELECT doc_id, 'alt_text', CASE WHEN figs > 0 THEN CASE WHEN alts = 0 THEN 0 ELSE floor(alts / (figs + coalesce(loose, 0))::DOUBLE * 100)::INT END WHEN loose > 0 THEN 0 END, FALSE FROM q
 UNION ALL SELECT doc_id, 'color_contrast', NULL, TRUE FROM q
 UNION ALL SELECT doc_id, 'bookmarks', CASE WHEN pages >= 10 THEN CASE WHEN outlines > 0 THEN 100 WHEN outline_tree THEN 40 ELSE 45 END END, FALSE FROM q
 UNION ALL SELECT doc_id, 'table_markup', CASE WHEN n > 0 THEN CASE WHEN heads = n THEN 40 WHEN heads > 0 THEN 20 ELSE 0 END + CASE WHEN trs = n THEN 20 WHEN trs > 0 THEN 10 ELSE 0 END + CASE WHEN heads > 0 AND bound = heads THEN 10 WHEN bound > 0 THEN 5 ELSE 0 END
   + CASE WHEN nested = 0 THEN 10 ELSE 0 END + 5 + CASE WHEN even = n THEN 10 ELSE 0 END + CASE WHEN anybound > 0 THEN 5 ELSE 0 END END, FALSE FROM q
 UNION ALL SELECT doc_id, 'link_quality', CASE WHEN n_links > 0 THEN floor((n_links - needs - untagged) / n_links::DOUBLE * 100)::INT END, FALSE FROM q
 UNION ALL SELECT doc_id, 'form_accessibility', CASE WHEN k % 2 = 0 AND n_fields > 0 THEN floor(labelled / n_fields::DOUBLE * 100)::INT END, FALSE FROM q
 UNION ALL SELECT doc_id, 'reading_order', CASE WHEN NOT tree THEN 0 WHEN k % 4 <= 1 THEN 30 END, tree AND k % 4 > 1 FROM q"""


@query(f"WITH {A.PDF_RECORDS} {_PDF_SCORES}")
def pdf_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_scoring.pdf_categories(A.pdf_records(spark, sf_dir)).select("doc_id", "id", "score", "not_assessed")


@query(f"""WITH {A.PDF_RECORDS}, f AS (SELECT doc_id, bad OR k % 100 = 0 AS stop, (CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END) + (CASE WHEN NOT tree THEN 1 ELSE 0 END)
  + (CASE WHEN NOT txt AND k % 2 > 0 THEN 1 ELSE 0 END) + (CASE WHEN alts < figs THEN 1 ELSE 0 END) + (CASE WHEN loose > 0 THEN 1 ELSE 0 END) + (CASE WHEN NOT lang THEN 1 ELSE 0 END) + (CASE WHEN k % 4 IN (0, 3) THEN 1 ELSE 0 END)
  + (CASE WHEN k % 2 > 0 AND k % 5 = 0 THEN 1 ELSE 0 END) + (CASE WHEN heads < n THEN 1 ELSE 0 END) + (CASE WHEN tree AND untagged > 0 THEN 1 ELSE 0 END) + (CASE WHEN k % 2 = 0 AND labelled < n_fields THEN 1 ELSE 0 END) AS c FROM q)
 SELECT doc_id, CASE WHEN stop THEN 'incomplete' WHEN c > 0 THEN 'fail' ELSE 'no-automated-failures' END AS status, CASE WHEN stop THEN 0 ELSE c END AS n_failures FROM f""")
def pdf_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_scoring.pdf_conformance(A.pdf_records(spark, sf_dir))
    return out.select("doc_id", "status", F.size("failures").alias("n_failures"))


@query("""SELECT conv_id, turn, CASE WHEN trim(x) = '' THEN 'unnamed_file' ELSE trim(x) END AS stored FROM (
 SELECT conv_id, turn, regexp_replace(substr(regexp_extract(rtrim(regexp_replace(coalesce(text, ''), '\\s', ' ', 'g'), '/'), '([^/]*)$', 1), 1, 255), '[^a-zA-Z0-9._ -]', '_', 'g') AS x FROM conversations)""")
def stored_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", text.stored_filename(F.coalesce("text", F.lit(""))).alias("stored"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({_STRIP.format("coalesce(text, '')")}, '([.!?]["''”’)\\]]*)[\\s\\x0B]+([A-Z0-9“"‘(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS x FROM documents)
 SELECT doc_id, array_to_string(x[1:2], ' ') AS summary, len(x) > 2 AS truncated FROM s""")
def opening_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(s, 1, 2), " ").alias("summary"), (F.size(s) > 2).alias("truncated"))


@query("""SELECT event_id, CASE WHEN user_id * 997 // 86400 > 0 THEN (user_id * 997 // 86400) || 'd ' || (user_id * 997 % 86400 // 3600) || 'h ' || (user_id * 997 % 3600 // 60) || 'm ' || (user_id * 997 % 60) || 's'
 WHEN user_id * 997 % 86400 // 3600 > 0 THEN (user_id * 997 % 86400 // 3600) || 'h ' || (user_id * 997 % 3600 // 60) || 'm ' || (user_id * 997 % 60) || 's' ELSE (user_id * 997 % 3600 // 60) || 'm ' || (user_id * 997 % 60) || 's' END AS uptime FROM events""")
def uptimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.uptime(F.col("user_id") * 997).alias("uptime"))


@query("""WITH c AS (SELECT l_orderkey AS t, l_linenumber AS o, list({'cols': CAST(l_suppkey % 3 + 1 AS INT), 'span': CAST(l_partkey % 3 + 1 AS INT)} ORDER BY l_partkey, l_suppkey, l_quantity) AS cells FROM lineitem GROUP BY ALL),
 x AS (SELECT t, o, list_sum(list_transform(cells, lambda z: z.cols)) AS own, cells, dense_rank() OVER (PARTITION BY t ORDER BY o) AS r FROM c),
 s AS (SELECT t, r, unnest(cells) AS z FROM x),
 e AS (SELECT x.t, x.r, x.own + coalesce(sum(s.z.cols) FILTER (s.r < x.r AND s.r + s.z.span > x.r), 0) AS n FROM x LEFT JOIN s ON s.t = x.t GROUP BY x.t, x.r, x.own)
 SELECT t AS table_id, string_agg(n::INT::VARCHAR, ',' ORDER BY r) AS counts, min(n) = max(n) AS consistent FROM e GROUP BY t""")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.struct("l_partkey", "l_suppkey", "l_quantity", (F.col("l_suppkey") % 3 + 1).cast("int").alias("cols"), (F.col("l_partkey") % 3 + 1).cast("int").alias("span"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    made = rows.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "cells"))).alias("rows"))
    counts = extraction.column_counts(F.transform("rows", lambda r: r["cells"]))
    return made.withColumn("c", counts).select("table_id", F.concat_ws(",", F.col("c").cast("array<string>")).alias("counts"), extraction.consistent(F.col("c")).alias("consistent"))


@query("""WITH r AS (SELECT p_partkey, chr(CAST(65 + p_partkey % 26 AS INT)) AS a, chr(CAST(65 + p_partkey * 7 % 26 AS INT)) || chr(CAST(65 + p_size % 26 AS INT)) AS b, p_partkey % 50 + 1 AS y0, p_size AS y1 FROM part)
 SELECT p_partkey, a || y0 || ':' || b || y1 AS ref, (abs((ascii(substr(b, 1, 1)) - 64) * 26 + ascii(substr(b, 2, 1)) - 64 - (ascii(a) - 64)) + 1)::INT AS span,
 ((abs((ascii(substr(b, 1, 1)) - 64) * 26 + ascii(substr(b, 2, 1)) - 64 - (ascii(a) - 64)) + 1) * (abs(y1 - y0) + 1))::INT AS cells FROM r""")
def cell_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda x: F.char((65 + x % 26).cast("int"))
    k = F.col("p_partkey")
    ref = F.concat(letter(k), (k % 50 + 1).cast("string"), F.lit(":"), letter(k * 7), letter(F.col("p_size")), F.col("p_size").cast("string"))
    t = table(spark, sf_dir, "part").select("p_partkey", ref.alias("ref"))
    return t.select("p_partkey", "ref", extraction.column_span(F.col("ref")).alias("span"), extraction.cell_count(F.col("ref")).alias("cells"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def dominant_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.dominant(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query(f"""WITH {A.categories_sql()} SELECT doc_id, id, CASE WHEN score = 100 THEN 'check' ELSE 'caution' END AS manual FROM cat WHERE score = 100 OR (score IS NULL AND not_assessed AND id = 'alt_text')""")
def manual_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.manual_checks(A.category_results(spark, sf_dir)).select("doc_id", "id", "manual")


@query(f"""{_REPORT}, n AS (SELECT doc_id, count(*) FILTER (severity = 'Critical') AS bad, count(*) FILTER (severity = 'Moderate') AS mid FROM cat GROUP BY doc_id)
 SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'scanned' WHEN doc_id % 10 = 1 THEN 'confirmed_failures' WHEN doc_id % 10 = 2 THEN 'incomplete' WHEN grade = 'A' AND bad = 0 AND mid = 0 THEN 'clear' WHEN grade = 'B' AND bad = 0 THEN 'minor_issues'
  WHEN bad > 0 AND mid > 0 THEN 'critical_and_moderate' WHEN bad > 0 THEN 'critical' WHEN mid > 0 THEN 'moderate' ELSE 'improvable' END AS situation FROM report JOIN n USING (doc_id)""")
def report_situations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scoring.report(scoring.nest(A.category_results(spark, sf_dir)))
    k = F.col("doc_id") % 10
    status = F.when(k == 1, "fail").when(k == 2, "incomplete").otherwise("no-automated-failures")
    return r.select("doc_id", reports.situation(k == 0, status, F.col("grade"), F.col("categories")).alias("situation"))


@query(f"""{_REPORT}, j AS (SELECT doc_id, string_agg('{{"id":"' || id || '"' || coalesce(',"score":' || score, '') || coalesce(',"grade":"' || grade || '"', '') || coalesce(',"severity":"' || severity || '"', '') || ',"status":"'
  || CASE WHEN score IS NULL THEN 'not-applicable' WHEN score >= 90 THEN 'pass' WHEN score >= 70 THEN 'minor' WHEN score >= 40 THEN 'moderate' ELSE 'fail' END || '"}}', ',' ORDER BY ord) AS cats,
  coalesce(string_agg('"' || id || '"', ',' ORDER BY score, ord) FILTER (score < 90), '') AS steps FROM cat GROUP BY doc_id)
 SELECT doc_id, '{{"score":{{"overall":' || overall_score || ',"grade":"' || grade || '"}},"categories":[' || cats || '],"prioritizedSteps":[' || steps || ']}}' AS json FROM report JOIN j USING (doc_id)""")
def json_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.export_json(scoring.report(scoring.nest(A.category_results(spark, sf_dir))))
