"""Category scores of office documents: analysis records of conversations, a turn a
heading, slide or sheet, scored by format, with the rules as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import format_scoring
from .adapters import table
from .queries import query

_TURNS = "t AS (SELECT conv_id AS doc_id, turn, CAST(length(text) AS INT) AS n, role FROM conversations)"


def _listed(value: str, test: str = "TRUE") -> str:
    """SQL of a document's list of what its turns give, in their order."""
    return f"list({value} ORDER BY turn) FILTER ({test})"


_HALF_UP = "CAST(floor({0} + 0.5) AS INT)"
# meaningful images, those with a text, links that need a fix, list items, contrast
_SHARED = """count(*) FILTER (turn % 2 = 1 AND n % 5 > 0) AS images, count(*) FILTER (turn % 2 = 1 AND n % 5 > 0 AND n % 3 > 0) AS alts,
  count(*) FILTER (n % 4 > 0) AS links, count(*) FILTER (n % 4 = 1) AS vague, count(*) FILTER (n % 3 = 0) AS manual, count(*) FILTER (n % 2 = 0) AS real,
  CAST(sum(n) % 40 AS INT) AS checked, least(CAST(sum(n) % 40 AS INT), count(*) FILTER (n % 8 = 0)) AS failing, bool_or(n % 9 = 0) AS unresolved"""
_ALT = f"CASE WHEN images > 0 THEN CASE WHEN alts < images THEN least(85, {_HALF_UP.format('100.0::DOUBLE * alts / images')}) ELSE 100 END END"
_LINK = f"CASE WHEN links > 0 THEN {_HALF_UP.format('100.0::DOUBLE * (links - vague) / links')} END"
_LIST = f"CASE WHEN real + manual > 0 THEN CASE WHEN manual > 0 THEN least(85, {_HALF_UP.format('100.0::DOUBLE * real / (real + manual)')}) ELSE 100 END END"
_COLOR = f"CASE WHEN checked > 0 THEN CASE WHEN failing > 0 THEN least(85, {_HALF_UP.format('100.0::DOUBLE * (checked - failing) / checked')}) ELSE 100 END END"
_TITLE = "CASE WHEN doc_id % 4 > 0 THEN 50 ELSE 0 END + CASE WHEN doc_id % 5 > 0 THEN 50 ELSE 0 END"


def _rows(source: str, *categories: tuple[str, float, str, str]) -> str:
    """SQL of one row for each category: (id, weight, score, whether it is unknown)."""
    each = " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, '{n}' AS id, {w}::DOUBLE AS weight, ({s})::INTEGER AS score, ({s}) IS NULL AND ({u}) AS not_assessed FROM {source}" for i, (n, w, s, u) in enumerate(categories, 1))
    return f"SELECT * FROM ({each})"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with its turns in order: doc_id, t (turn, n)."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.struct("turn", F.length("text").alias("n")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("t"))


def _record(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    shared = [
        "CASE WHEN doc_id % 4 > 0 THEN concat('Minutes ', doc_id) ELSE ' ' END AS title", "CASE WHEN doc_id % 5 > 0 THEN 'en' END AS language",
        "transform(filter(t, x -> x.turn % 2 = 1), x -> named_struct('altText', CASE WHEN x.n % 3 > 0 THEN 'a map' ELSE ' ' END, 'decorative', x.n % 5 = 0)) AS images",
        "transform(filter(t, x -> x.n % 4 > 0), x -> named_struct('text', CASE x.n % 4 WHEN 1 THEN 'click here' WHEN 2 THEN 'Annual report' ELSE 'https://a.b/c' END, 'resolved', true)) AS links",
        "size(filter(t, x -> x.n % 3 = 0)) AS manualItems", "size(filter(t, x -> x.n % 2 = 0)) AS realItems",
        "named_struct('checked', aggregate(t, 0, (a, x) -> a + x.n) % 40, 'unresolved', CAST(exists(t, x -> x.n % 9 = 0) AS INT), 'failing', slice(transform(filter(t, x -> x.n % 8 = 0), x -> named_struct('ratio', 2.0D)), 1, aggregate(t, 0, (a, x) -> a + x.n) % 40)) AS contrast",
    ]
    return _nested(spark, sf_dir).selectExpr("doc_id", *shared, *fields)


@query(f"""WITH {_TURNS}, h AS (SELECT doc_id, {_SHARED}, {_listed('1 + n % 3', 'n % 2 = 0')} AS levels, count(*) FILTER (n % 11 = 0) AS fakes,
  {_listed('least(CASE WHEN n % 2 = 1 AND 1 + n % 3 >= 2 AND 1 + n % 4 >= 2 THEN 30 ELSE 100 END, CASE WHEN n % 7 = 0 THEN 60 ELSE 100 END)', 'turn % 3 = 0')} AS tables FROM t GROUP BY doc_id),
 s AS (SELECT *, coalesce(len(levels), 0) AS heads, len(list_filter(range(1, coalesce(len(levels), 0)), lambda i: levels[i + 1] - levels[i] > 1)) AS skips FROM h)
 {_rows("s", ("text_extractability", 0.05, "100", "FALSE"), ("title_language", 0.18, _TITLE, "FALSE"),
  ("heading_structure", 0.18, "CASE WHEN heads + fakes > 0 THEN greatest(0, 100 - CASE WHEN heads > 0 AND levels[1] <> 1 THEN 15 ELSE 0 END - least(30, 15 * skips) - CASE WHEN fakes = 0 THEN 0 WHEN heads = 0 THEN 70 ELSE least(40, 15 * fakes) END) END", "FALSE"),
  ("alt_text", 0.18, _ALT, "FALSE"), ("table_markup", 0.12, f"CASE WHEN len(tables) > 0 THEN {_HALF_UP.format('list_sum(tables) / len(tables)::DOUBLE')} END", "FALSE"), ("link_quality", 0.08, _LINK, "FALSE"),
  ("color_contrast", 0.12, _COLOR, "unresolved"), ("list_structure", 0.09, _LIST, "FALSE"), ("reading_order", 0, "NULL", "TRUE"), ("form_accessibility", 0, "NULL", "TRUE"))}""")
def docx_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _record(
        spark, sf_dir, "transform(filter(t, x -> x.n % 2 = 0), x -> 1 + x.n % 3) AS headings", "size(filter(t, x -> x.n % 11 = 0)) AS fakeHeadings",
        "transform(filter(t, x -> x.turn % 3 = 0), x -> named_struct('hasHeaderRow', x.n % 2 = 0, 'rowCount', 1 + x.n % 3, 'colCount', 1 + x.n % 4, 'nested', x.n % 7 = 0, 'layout', false)) AS tables",
    )
    return format_scoring.docx_categories(records)


@query(f"""WITH {_TURNS}, h AS (SELECT doc_id, {_SHARED}, count(*) FILTER (n % 6 > 0) AS shown, count(*) FILTER (n % 6 > 0 AND n % 4 > 0) AS named, count(*) FILTER (n % 6 > 0 AND n % 4 > 0 AND n % 3 = 0) AS late,
  {_listed("CASE WHEN n % 5 = 1 THEN 'intro' ELSE concat('Intro', n % 5) END", "n % 6 > 0 AND n % 4 > 0")} AS titles,
  {_listed('CASE WHEN n % 2 = 1 AND 1 + n % 3 >= 2 AND 1 + n % 4 >= 2 THEN 30 ELSE 100 END', 'turn % 3 = 0')} AS tables FROM t GROUP BY doc_id),
 s AS (SELECT *, len(list_filter(list_distinct(titles), lambda x: len(list_filter(titles, lambda y: x = y)) > 1)) AS twice FROM h)
 {_rows("s", ("text_extractability", 0.05, "100", "FALSE"), ("title_language", 0.14, _TITLE, "FALSE"),
  ("slide_titles", 0.18, f"greatest(0, CASE WHEN named < shown THEN greatest(40, least(85, {_HALF_UP.format('100.0::DOUBLE * named / shown')})) ELSE 100 END - least(30, 10 * coalesce(twice, 0)))", "FALSE"),
  ("alt_text", 0.18, _ALT, "FALSE"), ("reading_order", 0.1, "CASE WHEN named > 0 THEN greatest(0, 100 - 15 * late) END", "TRUE"),
  ("table_markup", 0.1, f"CASE WHEN len(tables) > 0 THEN {_HALF_UP.format('list_sum(tables) / len(tables)::DOUBLE')} END", "FALSE"), ("color_contrast", 0.1, _COLOR, "unresolved"),
  ("list_structure", 0.07, _LIST, "FALSE"), ("link_quality", 0.08, _LINK, "FALSE"), ("form_accessibility", 0, "NULL", "TRUE"))}""")
def pptx_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that differ in case only are different titles; hidden slides don't count."""
    records = _record(
        spark, sf_dir, "transform(t, x -> named_struct('title', CASE WHEN x.n % 4 > 0 THEN CASE WHEN x.n % 5 = 1 THEN 'intro' ELSE concat('Intro', x.n % 5) END END, 'hidden', x.n % 6 = 0, 'titleFirst', x.n % 3 > 0)) AS slides",
        "transform(filter(t, x -> x.turn % 3 = 0), x -> named_struct('hasHeaderRow', x.n % 2 = 0, 'rowCount', 1 + x.n % 3, 'colCount', 1 + x.n % 4)) AS tables", "false AS hasMedia",
    )
    return format_scoring.pptx_categories(records)


@query(f"""WITH {_TURNS}, s AS (SELECT doc_id, {_SHARED}, CAST(sum(n) % 7 AS INT) AS valued, count(*) FILTER (n % 5 > 0) AS shown, count(*) FILTER (n % 5 > 0 AND n % 3 = 0) AS plain,
  count(*) FILTER (turn % 4 = 0 AND n % 3 = 0) AS tables, count(*) FILTER (turn % 4 = 0 AND n % 3 = 0 AND n % 2 = 1) AS headless, bool_or(n % 30 >= 12) AS sizable,
  bool_or(n % 5 > 0 AND n % 30 >= 12 AND n % 7 > 0 AND n % 9 > 0) AS loose FROM t GROUP BY doc_id)
 {_rows("s", ("text_extractability", 0.05, "CASE WHEN valued > 0 THEN 100 END", "TRUE"), ("title_language", 0.12, "CASE WHEN doc_id % 4 > 0 THEN 100 ELSE 50 END", "FALSE"),
  ("sheet_names", 0.18, f"CASE WHEN shown > 0 THEN CASE WHEN plain > 0 THEN greatest(40, least(85, {_HALF_UP.format('100.0::DOUBLE * (shown - plain) / shown')})) ELSE 100 END END", "FALSE"),
  ("table_markup", 0.25, "CASE WHEN tables > 0 OR sizable THEN least(greatest(0, 100 - 30 * headless), CASE WHEN loose AND tables = 0 THEN 60 ELSE 100 END) END", "FALSE"),
  ("alt_text", 0.18, _ALT, "FALSE"), ("color_contrast", 0.12, _COLOR, "unresolved"), ("link_quality", 0.1, _LINK, "links > 0"), ("form_accessibility", 0, "NULL", "TRUE"))}""")
def xlsx_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden sheets and pivots make tables a question, but ask for none."""
    records = _record(
        spark, sf_dir, "aggregate(t, 0, (a, x) -> a + x.n) % 7 AS valuedCells",
        "transform(t, x -> named_struct('name', CASE WHEN x.n % 3 = 0 THEN concat('Sheet', x.turn) ELSE concat('Budget ', x.turn, ' of all') END, 'hidden', x.n % 5 = 0, 'cells', x.n % 30, 'hasTable', x.n % 7 = 0, 'hasPivot', x.n % 9 = 0)) AS sheets",
        "transform(filter(t, x -> x.turn % 4 = 0 AND x.n % 3 = 0), x -> named_struct('hasHeaderRow', x.n % 2 = 0, 'columnCount', 2)) AS tables",
    )
    return format_scoring.xlsx_categories(records)
