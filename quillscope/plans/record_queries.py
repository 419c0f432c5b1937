"""Queries over the parts of analysis records: predicates, joins and counts of
what an extractor lists, and reports made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, text, urls
from ..operators import checklist, extraction, fleet, format_scoring, plan, records, reports, scoring, web_scoring
from . import adapters as A
from ..sources import files
from .adapters import table
from .queries import query

c = F.col

_LINE = "lineitem WHERE l_linenumber <= 7"


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 = 0 AS styled, CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN repeat(p_name, 9) ELSE p_name END AS t, p_partkey % 3 <> 0 AS bold, CAST(20 + p_size % 15 AS INT) AS size, p_partkey % 2 = 0 AS bold2, CAST(p_partkey % 7 * 6 AS INT) AS size2 FROM part)
 SELECT p_partkey, NOT styled AND trim(t) <> '' AND length(trim(t)) <= 120 AND ((bold AND size >= 28) OR (bold2 AND size2 >= 28)) AS fake_heading,
  NOT (p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0) AS layout_table,
  NOT (p_partkey % 3 < 2 AND trim(t) <> '' AND NOT p_partkey % 4 = 3) AS counts_as_image,
  nullif(trim(t), '') AS alt, trim(t) = '' AND p_partkey % 8 = 0 AS title_only,
  CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 = 0 END AS allowed, coalesce(nullif(trim(t), ''), CASE WHEN p_partkey % 8 = 4 THEN p_brand END) AS figure_alt FROM p JOIN part USING (p_partkey)""")
def part_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "p_brand", "p_partkey % 5 = 0 AS styled", "CASE p_partkey % 4 WHEN 0 THEN '  ' WHEN 1 THEN repeat(p_name, 9) ELSE p_name END AS t",
        "array(named_struct('bold', p_partkey % 3 <> 0, 'half_points', CAST(20 + p_size % 15 AS INT)), named_struct('bold', p_partkey % 2 = 0, 'half_points', CAST(p_partkey % 7 * 6 AS INT))) AS runs",
    )
    divides = lambda n: c("p_partkey") % n == 0
    alt, title_only = records.alt_of(c("t"), F.when(divides(8), c("p_brand")))
    kind = F.when(c("p_partkey") % 3 == 0, "shape").when(c("p_partkey") % 3 == 1, "group").otherwise("picture")
    return p.select(
        "p_partkey", records.fake_heading(c("styled"), c("t"), c("runs")).alias("fake_heading"), records.layout_table(divides(2), divides(3), divides(5), divides(7)).alias("layout_table"),
        records.counts_as_image(kind, c("t"), c("p_partkey") % 4 == 3).alias("counts_as_image"), alt.alias("alt"), title_only.alias("title_only"),
        records.accessibility_allowed(divides(3), divides(2)).alias("allowed"), records.figure_alt(c("t"), F.when(c("p_partkey") % 8 == 4, c("p_brand"))).alias("figure_alt"),
    )


_SHAPES = f"SELECT l_orderkey AS doc_id, l_linenumber AS ord, l_partkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM {_LINE}"


@query(f"""WITH s AS ({_SHAPES}), u AS (SELECT doc_id, n, k % 3 AS kind, k % 5 = 0 AS title, k % 4 <> 0 AS filled, k % 2 = 0 AS deco FROM s),
 f AS (SELECT doc_id, arg_min(kind = 0 AND title, n) FILTER (kind = 2 OR (kind = 1 AND NOT deco) OR (kind = 0 AND filled)) AS first FROM u GROUP BY doc_id) SELECT doc_id, coalesce(first, FALSE) AS title_first FROM f""")
def titles_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    shape = F.struct(F.get(F.array(*map(F.lit, ("shape", "picture", "frame"))), (c("l_partkey") % 3).cast("int")).alias("kind"), ((c("l_partkey") % 3 == 0) & (c("l_partkey") % 5 == 0)).alias("is_title"), F.when(c("l_partkey") % 4 != 0, "x").otherwise(" ").alias("text"), (c("l_partkey") % 2 == 0).alias("decorative"))
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 7").select(c("l_orderkey").alias("doc_id"), F.struct(order.alias("o"), shape.alias("s")).alias("x"))
    shapes = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]).alias("shapes"))
    return shapes.select("doc_id", records.title_first(c("shapes")).alias("title_first"))


_REF = "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'B' || p_size WHEN 2 THEN 'c3:' || chr(CAST(65 + p_size % 26 AS INT)) || p_partkey % 90 WHEN 3 THEN 'A1:AB' || p_size WHEN 4 THEN 'nothing' ELSE 'AA' || p_size || ':B2' END"


@query(f"""WITH r AS (SELECT p_partkey, p_size, {_REF} AS ref FROM part), m AS (SELECT *, upper(trim(coalesce(ref, ''))) AS u FROM r),
 g AS (SELECT *, regexp_extract(u, '^([A-Z]+)(\\d+)(?::([A-Z]+)(\\d+))?$', ['a', 'b', 'c', 'd']) AS x FROM m),
 n AS (SELECT *, CASE WHEN length(x.a) = 2 THEN (ascii(x.a) - 64) * 26 + ascii(substr(x.a, 2)) - 64 ELSE ascii(x.a) - 64 END AS c1, CASE WHEN length(x.c) = 2 THEN (ascii(x.c) - 64) * 26 + ascii(substr(x.c, 2)) - 64 ELSE ascii(x.c) - 64 END AS c2 FROM g)
 SELECT p_partkey, CASE WHEN x.a = '' THEN 0 WHEN x.c = '' THEN 1 ELSE (abs(c2 - c1) + 1) * (abs(try_cast(x.d AS BIGINT) - try_cast(x.b AS BIGINT)) + 1) END::BIGINT AS declared,
  greatest(CASE WHEN x.a = '' THEN 0 WHEN x.c = '' THEN 1 ELSE (abs(c2 - c1) + 1) * (abs(try_cast(x.d AS BIGINT) - try_cast(x.b AS BIGINT)) + 1) END, p_size)::BIGINT AS used FROM n""")
def sheet_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("ref", F.expr(_REF))
    return p.select("p_partkey", extraction.cell_count(F.coalesce("ref", F.lit(""))).cast("long").alias("declared"), records.used_cells(c("ref"), c("p_size")).cast("long").alias("used"))


_CELLS = "SELECT DISTINCT l_orderkey AS doc_id, 'C' || l_linenumber AS ref, first_value(CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' v' || l_partkey END) OVER w AS text, first_value(CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 END) OVER w AS style FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = "struct(CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat(' v', l_partkey) END AS text, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 END AS style)"
    cells = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("doc_id"), F.concat(F.lit("C"), "l_linenumber").alias("ref")).agg(F.min_by(F.expr(cell), F.struct("l_partkey", "l_suppkey")).alias("x"))
    return cells.select("doc_id", "ref", "x.text", "x.style")


@query(f"""WITH c AS ({_CELLS}), l AS (SELECT o_orderkey AS doc_id, 'C' || (o_orderkey % 8 + 1) || ':D9' AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'shown' END AS display FROM orders)
 SELECT l.doc_id, l.ref, trim(coalesce(nullif(trim(c.text), ''), display, trim(c.text), '')) AS text, c.text IS NOT NULL OR display IS NOT NULL AS resolved FROM l LEFT JOIN c ON c.doc_id = l.doc_id AND c.ref = split_part(l.ref, ':', 1)""")
def cell_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "concat('C', o_orderkey % 8 + 1, ':D9') AS ref", "CASE WHEN o_orderkey % 3 = 0 THEN 'shown' END AS display")
    return records.link_texts(links, _cells(spark, sf_dir))


@query(f"WITH c AS ({_CELLS}) SELECT DISTINCT doc_id, coalesce(style, 0) AS style FROM c WHERE text IS NOT NULL")
def applied_cell_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.applied_styles(_cells(spark, sf_dir))


@query("""WITH f AS (SELECT user_id AS doc_id, event_id % 6 AS page, event_id % 40 AS name, arg_min(struct_pack(w := CASE WHEN event_id % 5 > 0 THEN event_id % 120 END, a := event_id % 3 = 0), event_id) AS p FROM events GROUP BY ALL)
 SELECT doc_id, count(*) FILTER (NOT coalesce(p.w < 50, FALSE)) AS images, count(*) FILTER (NOT coalesce(p.w < 50, FALSE) AND NOT p.a) AS content_images FROM f GROUP BY doc_id""")
def image_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    paints = table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "event_id % 6 AS page", "event_id AS ord", "event_id % 40 AS name", "CASE WHEN event_id % 5 > 0 THEN event_id % 120 END AS width", "60 AS height", "event_id % 3 = 0 AS artifact")
    return records.image_census(paints)


@query("""WITH t AS (SELECT conv_id AS doc_id, turn AS page, CASE WHEN turn % 3 = 0 THEN '  ' || substr(text, 1, 7) || ' ' ELSE substr(text, 1, 30) END AS s FROM conversations)
 SELECT doc_id, coalesce(array_to_string(list(page ORDER BY page) FILTER (length(regexp_replace(coalesce(s, ''), '^\\s+|\\s+$', '', 'g')) < 10), ','), '') AS empty_pages, sum(length(coalesce(s, ''))) > 50 AS has_text FROM t GROUP BY doc_id""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").selectExpr("conv_id AS doc_id", "turn AS page", "CASE WHEN turn % 3 = 0 THEN concat('  ', substr(text, 1, 7), ' ') ELSE substr(text, 1, 30) END AS text")
    return records.page_texts(pages).withColumn("empty_pages", F.array_join(c("empty_pages").cast("array<string>"), ","))


_OBJECTS = "SELECT DISTINCT l_orderkey AS doc_id, l_partkey % 20 AS ref FROM lineitem"


@query(f"""WITH o AS ({_OBJECTS}), s AS (SELECT DISTINCT l_orderkey AS doc_id, l_suppkey % 20 AS ref FROM lineitem), n AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS ref FROM lineitem)
 SELECT doc_id, ref FROM o SEMI JOIN s USING (doc_id, ref) ANTI JOIN n USING (doc_id, ref)""")
def structure_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that the structure reaches and that stand in no other."""
    li = table(spark, sf_dir, "lineitem")
    refs = lambda x: li.selectExpr("l_orderkey AS doc_id", f"{x} AS ref").distinct()
    return records.outermost(records.reachable(refs("l_partkey % 20"), refs("l_suppkey % 20")), refs("l_linenumber"))


_WIDGETS = "SELECT 1 AS doc_id, p_partkey AS ref, CASE WHEN p_partkey % 4 = 0 THEN p_partkey // 2 WHEN p_partkey % 4 = 1 THEN p_partkey // 3 ELSE p_partkey - 1 END AS parent, CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN '' END AS label, p_partkey % 7 = 0 AS hidden, p_partkey % 2 = 0 AS is_field FROM part"


@query(f"""WITH RECURSIVE w AS ({_WIDGETS}), u AS (SELECT ref AS field, nullif(label, '') AS label, parent, 0 AS d FROM w WHERE is_field AND NOT hidden
  UNION ALL SELECT field, nullif(w.label, ''), w.parent, d + 1 FROM u JOIN w ON w.ref = u.parent WHERE u.label IS NULL AND d < 5)
 SELECT 1 AS doc_id, field, any_value(label) AS label FROM u GROUP BY field""")
def form_field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    widgets = table(spark, sf_dir, "part").selectExpr("1 AS doc_id", "p_partkey AS ref", "CASE WHEN p_partkey % 4 = 0 THEN p_partkey div 2 WHEN p_partkey % 4 = 1 THEN p_partkey div 3 ELSE p_partkey - 1 END AS parent", "CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN '' END AS label", "p_partkey % 7 = 0 AS hidden", "p_partkey % 2 = 0 AS is_field")
    return records.form_fields(widgets)


@query("""SELECT user_id AS doc_id, count(*) FILTER (event_id % 4 = 0) AS paragraphs, count(*) FILTER (event_id % 9 = 0) AS artifacts, count(*) FILTER (event_id % 5 = 0) AS actual_texts, count(*) FILTER (event_id % 6 = 0) AS expansions,
 count(*) FILTER (event_id % 3 = 0 AND event_id % 4 <> 1) AS lang_spans FROM events GROUP BY user_id""")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("user_id AS doc_id", "element_at(array('P', 'Document', 'Span', 'Figure'), CAST(event_id % 4 AS INT) + 1) AS tag", "CASE event_id % 3 WHEN 0 THEN 'fr' WHEN 1 THEN '' END AS lang", "CASE WHEN event_id % 5 = 0 THEN 'x' END AS actual_text", "CASE WHEN event_id % 6 = 0 THEN 'y' ELSE '' END AS expansion", "event_id % 9 = 0 AS artifact")
    return records.element_counts(e)


_IMPACT = "element_at(array('Critical', 'serious', 'MODERATE', 'minor', 'odd', NULL), CAST({0} % 6 AS INT) + 1)"


@query("""WITH v AS (SELECT l_orderkey AS page, CASE l_partkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'serious' WHEN 2 THEN 'moderate' ELSE 'minor' END AS impact, greatest(1, l_suppkey % 4)::INT AS n FROM lineitem)
 SELECT page, greatest(0, 100 - sum(CASE impact WHEN 'critical' THEN 10 WHEN 'serious' THEN 5 WHEN 'moderate' THEN 2 ELSE 1 END * n))::INT AS score,
 coalesce(sum(n) FILTER (impact = 'critical'), 0)::INT AS critical, coalesce(sum(n) FILTER (impact = 'serious'), 0)::INT AS serious, coalesce(sum(n) FILTER (impact = 'moderate'), 0)::INT AS moderate, coalesce(sum(n) FILTER (impact = 'minor'), 0)::INT AS minor FROM v GROUP BY page""")
def page_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("page"), F.struct(F.expr(_IMPACT.format("l_partkey")).alias("impact"), (c("l_suppkey") % 4).cast("int").alias("nodes")).alias("v"))
    pages = v.groupBy("page").agg(F.collect_list("v").alias("v"))
    return pages.select("page", web_scoring.page_score(c("v")).alias("score"), web_scoring.page_tally(c("v")).alias("t")).select("page", "score", "t.*")


_SPANS = "CASE p_partkey % 4 WHEN 0 THEN ['en-US', 'de', 'DE', 'fr-CA', ''] WHEN 1 THEN ['en'] WHEN 2 THEN ['es', 'en', 'es-MX', 'it'] ELSE [] END"


@query(f"""WITH p AS (SELECT p_partkey, {_SPANS} AS spans, CASE WHEN p_partkey % 3 > 0 THEN 'en-US' END AS lang FROM part),
 m AS (SELECT p_partkey, list_transform(spans, lambda x: split_part(lower(x), '-', 1)) AS a, split_part(lower(coalesce(lang, '')), '-', 1) AS main, list_transform(spans, lambda x: lower(x)) AS full_, lower(coalesce(lang, '')) AS whole FROM p)
 SELECT p_partkey, array_to_string(list_filter(a, lambda x, i: x <> '' AND x <> main AND list_position(a, x) = i), ',') AS foreign_languages,
  array_to_string(list_transform(list_sort(list_distinct(list_filter(full_, lambda x: x <> '' AND x <> whole))), lambda x: x || ':' || len(list_filter(full_, lambda y: y = x))), ',') AS tally FROM m""")
def language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = "CASE p_partkey % 4 WHEN 0 THEN array('en-US', 'de', 'DE', 'fr-CA', '') WHEN 1 THEN array('en') WHEN 2 THEN array('es', 'en', 'es-MX', 'it') ELSE CAST(array() AS array<string>) END"
    p = table(spark, sf_dir, "part").withColumns({"spans": F.expr(spans), "lang": F.when(c("p_partkey") % 3 > 0, "en-US")})
    tally = F.array_join(F.transform(records.language_tally(c("spans"), c("lang")), lambda t: F.concat(t["lang"], F.lit(":"), t["n"].cast("string"))), ",")
    return p.select("p_partkey", F.array_join(records.foreign_languages(c("spans"), c("lang")), ",").alias("foreign_languages"), tally.alias("tally"))


@query("""WITH f AS (SELECT o_orderkey AS doc_id, unnest(range(0, (o_orderkey % 5)::INT)) AS i FROM orders), r AS (SELECT doc_id, i, 1 + (doc_id * 7 + i * 3) % 4 / 2.0::DOUBLE AS ratio, 't' || i AS text FROM f)
 SELECT o_orderkey AS doc_id, any_value(w.ratio) AS ratio, any_value(w.text) AS text FROM orders LEFT JOIN (SELECT doc_id, arg_min(ratio, struct_pack(a := ratio, b := i)) AS ratio, arg_min(text, struct_pack(a := ratio, b := i)) AS text FROM r GROUP BY doc_id) w ON w.doc_id = o_orderkey GROUP BY o_orderkey""")
def worst_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    failing = F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < c("o_orderkey") % 5), lambda i: F.struct((F.lit(1.0) + (c("o_orderkey") * 7 + i * 3) % 4 / F.lit(2.0)).alias("ratio"), F.concat(F.lit("t"), i.cast("string")).alias("text")))
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("doc_id"), records.worst_contrast(failing).alias("w")).select("doc_id", "w.ratio", "w.text")


_GATE = f"""WITH {A.PDF_RECORDS}, r AS (SELECT doc_id, list_filter([CASE WHEN k % 11 = 0 THEN '1.1.1' END, CASE WHEN NOT tree THEN '1.3.1' END, CASE WHEN NOT lang THEN '3.1.1' END, CASE WHEN k % 4 = 0 THEN '1.4.3' END, CASE WHEN k % 6 = 0 THEN '2.4.6' END], lambda x: x IS NOT NULL) AS fs, k FROM q),
 n AS (SELECT doc_id, k, len(list_filter(fs, lambda x: x IN ('1.4.3', '2.4.6')))::INT AS aa, len(fs)::INT - len(list_filter(fs, lambda x: x IN ('1.4.3', '2.4.6')))::INT AS a, fs FROM r)"""


@query(f"""{_GATE} SELECT doc_id, a AS level_a, aa AS level_aa,
 CASE WHEN aa = 0 THEN a || ' Level A failure' || CASE WHEN a = 1 THEN '' ELSE 's' END WHEN a = 0 THEN aa || ' Level AA failure' || CASE WHEN aa = 1 THEN '' ELSE 's' END ELSE a || ' Level A and ' || aa || ' Level AA failures' END AS breakdown,
 CASE WHEN k % 3 = 0 THEN '1.4.3,' ELSE '' END || CASE WHEN k % 5 = 0 THEN '1.3.2,' ELSE '' END || CASE WHEN k % 2 = 0 THEN '2.5.8,3.3.7,3.3.8,' ELSE '' END || CASE WHEN k % 7 = 0 THEN '1.2.2,' ELSE '' END || '3.1.2,1.4.1,1.4.5,1.4.11,1.3.3' AS not_assessed,
 CASE fs[1] WHEN '1.1.1' THEN 'https://www.w3.org/WAI/WCAG22/Understanding/non-text-content.html' WHEN '1.3.1' THEN 'https://www.w3.org/WAI/WCAG22/Understanding/info-and-relationships.html' WHEN '3.1.1' THEN 'https://www.w3.org/WAI/WCAG22/Understanding/language-of-page.html'
  WHEN '1.4.3' THEN 'https://www.w3.org/WAI/WCAG22/Understanding/contrast-minimum.html' WHEN '2.4.6' THEN 'https://www.w3.org/WAI/WCAG22/Understanding/headings-and-labels.html' ELSE 'https://www.w3.org/WAI/WCAG22/quickref/' END AS first_page FROM n""")
def gate_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by level, what isn't assessed, and where the first is explained."""
    k = c("doc_id")
    fails = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(sc).alias("criterion"))) for sc, test in (("1.1.1", k % 11 == 0), ("1.3.1", k % 3 == 0), ("3.1.1", k % 7 == 0), ("1.4.3", k % 4 == 0), ("2.4.6", k % 6 == 0)))))
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("doc_id")).withColumn("f", fails)
    a, aa = format_scoring.levels_of(c("f"))
    blank = format_scoring.not_assessed("pptx", forms=k % 2 == 0, media=k % 7 == 0, contrast=k % 3 == 0, order=k % 5 == 0)
    return p.select("doc_id", a.alias("level_a"), aa.alias("level_aa"), format_scoring.breakdown(c("f")).alias("breakdown"), F.array_join(F.transform(blank, lambda x: x["criterion"]), ",").alias("not_assessed"), format_scoring.explanation(F.get("f", F.lit(0))["criterion"]).alias("first_page"))


_IPS = ("10.1.2.3", "8.8.8.8", "::1", "[::]", "fc00::1", "fe80::1", "ff02::1", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:7f00:1", "::ffff:808:808", "1::2::3", "fd12:3456", "f:c", "198.19.0.1", "300.1.1.1", "2001:0:0:0:0:0:0:1", "fe80:1:2:3:4:5:6:7:8")
_PRIVATE = ("10.1.2.3", "::1", "[::]", "fc00::1", "fe80::1", "ff02::1", "::ffff:10.0.0.1", "::ffff:7f00:1", "198.19.0.1")
_ASKED = ("data:text/plain,x", "blob:y", "ftp://a.gov/x", "https://www.a.gov/x", "https://b.org/x", "http://", "nothing", "about:blank", "https://10.0.0.1/")


@query(f"""WITH p AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in _IPS)}][p_partkey % {len(_IPS)} + 1] AS ip, p_partkey % {len(_ASKED)} AS u, p_partkey % 2 = 0 AS doc, ['malformed_url', 'private_ip', 'oversized', 'timeout', 'redirect_loop', 'dns_failed', 'else'][p_partkey % 7 + 1] AS code FROM part),
 r AS (SELECT *, CASE u WHEN 2 THEN 'scheme ftp' WHEN 3 THEN NULL WHEN 4 THEN CASE WHEN doc THEN 'off_allowlist' END WHEN 8 THEN CASE WHEN doc THEN 'off_allowlist' END WHEN 5 THEN 'malformed' WHEN 6 THEN 'malformed' END AS reason FROM p)
 SELECT p_partkey, ip IN ({", ".join(f"'{x}'" for x in _PRIVATE)}) AS private, reason IS NULL AS allow, u IN (3, 4, 8) AND reason IS NULL AS needs_ip_check, reason,
 CASE code WHEN 'malformed_url' THEN 400 WHEN 'private_ip' THEN 400 WHEN 'oversized' THEN 413 WHEN 'timeout' THEN 504 ELSE 502 END AS status, CASE code WHEN 'malformed_url' THEN 'bad_address' WHEN 'else' THEN 'not_fetched' ELSE code END AS kind FROM r""")
def addresses_and_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (c("p_partkey") % len(xs)).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", pick(_IPS).alias("ip"), pick(_ASKED).alias("url"), pick(("malformed_url", "private_ip", "oversized", "timeout", "redirect_loop", "dns_failed", "else")).alias("code"))
    r = urls.page_request(c("url"), c("p_partkey") % 2 == 0, ["a.gov"])
    return p.select("p_partkey", urls.private_ip(c("ip")).alias("private"), r.alias("r"), urls.fetch_error_status(c("code")).alias("status"), urls.fetch_error_kind(c("code")).alias("kind")).select("p_partkey", "private", "r.*", "status", "kind")


@query("""WITH p AS (SELECT p_partkey AS k, p_name, ['pdf', 'docx', 'pptx', 'xlsx', NULL, 'odd'][p_partkey % 6 + 1] AS ft, ['Adobe InDesign 18', 'Microsoft Word for x', 'WordPerfect', NULL][p_partkey % 4 + 1] AS cr, CASE p_partkey % 3 WHEN 0 THEN 'annualReport' WHEN 1 THEN 'X' END AS pt,
  ['reading_order', 'alt_text', 'table_markup', 'title_language', 'bookmarks'][p_partkey % 5 + 1] AS cat, p_partkey % 2 = 0 AS na FROM part)
 SELECT k AS p_partkey, k % 3 || ' ' || CASE ft WHEN 'pptx' THEN 'slide' WHEN 'xlsx' THEN 'sheet' ELSE 'page' END || CASE WHEN k % 3 = 1 THEN '' ELSE 's' END || ' · ' || CASE ft WHEN 'docx' THEN 'Word' WHEN 'pptx' THEN 'PowerPoint' WHEN 'xlsx' THEN 'Excel' ELSE 'PDF' END AS banner,
 CASE WHEN ft = 'docx' THEN 'word' WHEN ft = 'pptx' THEN 'powerpoint' WHEN ft = 'xlsx' THEN 'excel' WHEN k % 4 = 0 THEN 'indesign' WHEN k % 4 = 1 THEN 'word_recorded' ELSE 'word_assumed' END AS program,
 CASE k % 3 WHEN 0 THEN 'Annual Report' WHEN 1 THEN 'X' ELSE '' END AS kind_of_publication,
 CASE cat WHEN 'reading_order' THEN 'reading_order:check_yourself' WHEN 'bookmarks' THEN 'bookmarks:check_yourself' WHEN 'alt_text' THEN CASE WHEN na THEN 'alt_text:untagged_images' ELSE 'alt_text:none_found' END WHEN 'table_markup' THEN 'table_markup:none_found' ELSE CASE WHEN na THEN 'not_assessed' ELSE 'does_not_apply' END END AS why_blank,
 CASE WHEN k % 2 = 0 THEN '[' || p_name || '](https://a.b/' || k || ')' ELSE p_name END AS link, CASE k % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' END AS ua_part, p_name || '-accessibility-report-2026-07-03' AS export_name, substr(p_name, 1, 5) AS clamped FROM p""")
def labels_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *xs: F.get(F.array(*(F.lit(x).cast("string") for x in xs)), (c("p_partkey") % len(xs)).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", pick("pdf", "docx", "pptx", "xlsx", None, "odd").alias("ft"), pick("Adobe InDesign 18", "Microsoft Word for x", "WordPerfect", None).alias("cr"), pick("annualReport", "X", None).alias("pt"), pick("reading_order", "alt_text", "table_markup", "title_language", "bookmarks").alias("cat"), pick("<x pdfuaid:part = '1' />", "<pdfuaid:part>2</pdfuaid:part>", "none", None).alias("xmp"))
    k = c("p_partkey")
    return p.select(
        "p_partkey", text.banner(k % 3, c("ft")).alias("banner"), text.source_program(c("ft"), c("cr")).alias("program"), text.camel_words(c("pt")).alias("kind_of_publication"), text.why_blank(c("cat"), k % 2 == 0).alias("why_blank"),
        text.markdown_link(c("p_name"), F.concat(F.when(k % 2 == 0, "https://a.b/").otherwise("javascript:"), k.cast("string"))).alias("link"), text.ua_part(c("xmp")).alias("ua_part"), text.report_filename(F.concat("p_name", F.lit(".PDF")), F.lit("2026-07-03").cast("date")).alias("export_name"), text.clamped(c("p_name"), 5).alias("clamped"),
    )


@query("""WITH p AS (SELECT p_partkey AS k, (p_partkey % 140)::INT - 20 AS pct FROM part)
 SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 'red' ELSE '#22c55e' || lpad(printf('%x', floor(greatest(0, least(100, pct)) / 100.0::DOUBLE * 255 + 0.5)::INT), 2, '0') END AS tint,
 CASE k % 7 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN '#15803d' ELSE '#22c55e' END WHEN 1 THEN CASE WHEN k % 2 = 0 THEN '#0f766e' ELSE '#14b8a6' END WHEN 2 THEN CASE WHEN k % 2 = 0 THEN '#946005' ELSE '#eab308' END WHEN 3 THEN CASE WHEN k % 2 = 0 THEN '#c2410c' ELSE '#f97316' END WHEN 4 THEN CASE WHEN k % 2 = 0 THEN '#b91c1c' ELSE '#ef4444' END ELSE '#666' END AS grade_color,
 CASE k % 5 WHEN 0 THEN CASE WHEN k % 2 = 0 THEN '#b91c1c' ELSE '#ef4444' END WHEN 1 THEN CASE WHEN k % 2 = 0 THEN '#946005' ELSE '#eab308' END WHEN 2 THEN CASE WHEN k % 2 = 0 THEN '#1d4ed8' ELSE '#3b82f6' END WHEN 3 THEN CASE WHEN k % 2 = 0 THEN '#15803d' ELSE '#22c55e' END ELSE '#999' END AS severity_color,
 CASE WHEN k % 4 = 0 THEN 'AABBCC' WHEN k % 4 = 1 THEN '112233' WHEN k % 3 = 0 THEN NULL WHEN k % 4 = 2 THEN 'FFFFFF' ELSE '445566' END AS ground, CASE k % 3 WHEN 0 THEN '000001' WHEN 1 THEN 'FFFFFE' END AS theme,
 k % 4 = 0 AND 2.5 + k % 9 / 4.0::DOUBLE >= 3 AND 2.5 + k % 9 / 4.0::DOUBLE < 4.5 AS undecided FROM p""")
def colors_of_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    pick = lambda *xs: F.get(F.array(*(F.lit(x).cast("string") for x in xs)), (k % len(xs)).cast("int"))
    theme = F.create_map(F.lit("dk1"), F.lit("000001"), F.lit("lt1"), F.lit("fffffe"))
    light = k % 2 == 0
    ground = color.background(F.when(k % 4 == 0, "#aabbcc"), F.lit(None).cast("string"), F.when(k % 4 == 1, "112233"), F.lit("auto"), F.when(k % 4 == 3, "445566"), k % 3 == 0)
    return table(spark, sf_dir, "part").select(
        "p_partkey", color.with_alpha(F.when(k % 3 == 0, "red").otherwise("#22c55e"), (k % 140).cast("int") - 20).alias("tint"), color.grade_color(pick("A", "B", "C", "D", "F", None, "X"), light).alias("grade_color"),
        color.severity_color(pick("Critical", "Moderate", "Minor", "Pass", None), light).alias("severity_color"), ground.alias("ground"), color.theme_color(pick("tx1", "bg1", "accent9"), theme).alias("theme"),
        color.undecided(F.lit(2.5) + k % 9 / F.lit(4.0), F.when(k % 4 != 0, 12.0)).alias("undecided"),
    )


_FINDINGS = "[CASE WHEN {k} % 3 = 0 THEN 'How to fix: it' ELSE 'a fact ' || {k} END, '--- First ---', '  one', CASE WHEN {k} % 2 = 0 THEN '  two' ELSE 'plain' END, '---Second', '   three', NULL, '', CASE WHEN {k} % 5 = 0 THEN '--- Fix in Adobe Acrobat ---' ELSE 'more' END, 'step']"


@query(f"""WITH p AS (SELECT p_partkey AS k FROM part)
 SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 'How to fix: it' ELSE 'a fact ' || k END || CASE WHEN k % 2 = 0 THEN '' ELSE '|plain' END || CASE WHEN k % 5 = 0 THEN '' ELSE '|more|step' END AS main,
 'First:one' || CASE WHEN k % 2 = 0 THEN ',two' ELSE '' END || '|Second:three' AS signals, CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END AS signal_count, CASE WHEN k % 5 = 0 THEN 'step' ELSE '' END AS fix,
 CASE WHEN k % 3 <> 0 THEN 'a fact ' || k WHEN k % 2 <> 0 THEN 'plain' WHEN k % 5 <> 0 THEN 'more' ELSE 'step' END AS first_actionable FROM p""")
def findings_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a category in three groups: facts, signals by heading, steps."""
    found = _FINDINGS.format(k="p_partkey").replace("[", "array(").replace("]", ")")
    p = table(spark, sf_dir, "part").withColumn("findings", F.expr(found))
    card = plan.card(c("findings"))
    groups = F.array_join(F.transform(c("card.signals"), lambda g: F.concat(g["heading"], F.lit(":"), F.array_join(g["items"], ","))), "|")
    return p.withColumn("card", card).select("p_partkey", F.array_join("card.main", "|").alias("main"), groups.alias("signals"), c("card.signal_count").alias("signal_count"), F.array_join("card.fix", "|").alias("fix"), text.first_actionable(c("findings")).alias("first_actionable"))


@query(f"""WITH {A.categories_sql()}, f AS (SELECT *, CASE id WHEN 'link_quality' THEN ['--- Links Not Tagged ---'] WHEN 'alt_text' THEN CASE WHEN doc_id % 2 = 0 THEN ['--- Figures That Contain Text ---', 'x'] ELSE ['x'] END ELSE ['tip: none', 'a fact'] END AS fs FROM cat)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'Moderate' THEN 1 ELSE 2 END, ord)::INT AS rank, id, severity,
 CASE WHEN id = 'link_quality' THEN 'link_quality:untagged' WHEN id = 'alt_text' AND doc_id % 2 = 0 THEN 'alt_text:text_in_figures' ELSE id END AS advice,
 CASE WHEN doc_id % 4 = 1 THEN 'source' WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 'source_indesign,acrobat' ELSE 'source,acrobat' END AS routes, CASE WHEN id IN ('link_quality', 'alt_text') THEN CASE WHEN id = 'alt_text' THEN 'x' ELSE '--- Links Not Tagged ---' END ELSE 'a fact' END AS why
 FROM f WHERE severity IN ('Critical', 'Moderate', 'Minor')""")
def action_plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked steps with the kind of advice and the programs it is for."""
    found = F.when(c("id") == "link_quality", F.array(F.lit("--- Links Not Tagged ---"))).when(c("id") == "alt_text", F.when(c("doc_id") % 2 == 0, F.array(F.lit("--- Figures That Contain Text ---"), F.lit("x"))).otherwise(F.array(F.lit("x")))).otherwise(F.array(F.lit("tip: none"), F.lit("a fact")))
    cats = scoring.with_severity(A.category_results(spark, sf_dir)).withColumns({"findings": found, "file_type": F.when(c("doc_id") % 4 == 1, "docx").otherwise("pdf"), "creator": F.when((c("doc_id") % 4 == 0) & (c("doc_id") % 3 == 0), "Adobe InDesign 19")})
    return plan.steps(cats).select("doc_id", "rank", "id", "severity", "advice", F.array_join("routes", ",").alias("routes"), "why")


@query(f"""WITH {A.categories_sql()}, t AS (SELECT doc_id, count(*) FILTER (severity = 'Critical') AS bad, count(*) FILTER (severity = 'Moderate') AS mid, count(*) AS n FROM cat GROUP BY doc_id)
 SELECT o_orderkey AS doc_id, CASE WHEN n IS NULL OR n = 0 THEN 'not_rechecked' WHEN bad > 0 THEN 'not_ready' WHEN mid > 0 THEN 'fix_first' ELSE 'ready' END AS readiness FROM orders LEFT JOIN t ON t.doc_id = o_orderkey""")
def publish_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = scoring.nest(A.category_results(spark, sf_dir))
    docs = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("doc_id"))
    return docs.join(nested, "doc_id", "left").select("doc_id", plan.readiness(c("categories")).alias("readiness"))


@query(f"""WITH {A.categories_sql()}, t AS (SELECT doc_id, count(*) FILTER (severity = 'Critical' AND (doc_id % 3 > 0 OR ord <= 2)) AS bad, count(*) FILTER (severity = 'Moderate' AND (doc_id % 3 > 0 OR ord <= 2)) AS mid, count(*) FILTER (doc_id % 3 > 0 OR ord <= 2) AS n FROM cat GROUP BY doc_id)
 SELECT doc_id, CASE WHEN n = 0 OR doc_id % 3 = 1 THEN 'not_rechecked' WHEN bad > 0 THEN 'not_ready' WHEN mid > 0 THEN 'fix_first' ELSE 'ready' END AS readiness FROM t""")
def readiness_by_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third has a strict profile of two categories, a third one without any."""
    d = scoring.nest(A.category_results(spark, sf_dir))
    strict = F.when(c("doc_id") % 3 == 0, F.filter("categories", lambda x: x["ord"] <= 2)).when(c("doc_id") % 3 == 1, F.filter("categories", lambda x: F.lit(False)))
    return d.select("doc_id", plan.readiness(c("categories"), strict).alias("readiness"))


@query(f"""WITH {A.categories_sql()} SELECT doc_id, id, CASE WHEN ord <= 3 THEN CASE WHEN doc_id % 2 = 0 THEN 95 END ELSE score END AS score,
 CASE WHEN ord > 3 THEN grade WHEN doc_id % 2 = 0 THEN 'A' END AS grade, CASE WHEN ord > 3 THEN severity WHEN doc_id % 2 = 0 THEN 'Minor' END AS severity FROM cat""")
def profile_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with the scores of a scoring profile over their own."""
    ids = A.CATEGORY_IDS[:3]
    held = F.create_map(*(x for i in ids for x in (F.lit(i), F.when(c("doc_id") % 2 == 0, 95))))
    cats = scoring.with_severity(A.category_results(spark, sf_dir)).withColumn("profile", held)
    return plan.with_profile(cats, c("profile")).select("doc_id", "id", "score", "grade", "severity")


@query("""SELECT p_partkey, unnest(['Source Application', 'Page Count', 'Encrypted']) AS label, unnest([CASE WHEN p_partkey % 3 > 0 THEN p_brand END, (p_size)::VARCHAR, CASE WHEN p_partkey % 5 = 0 THEN 'Yes' ELSE 'No' END]) AS value FROM part""")
def metadata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.when(c("p_partkey") % 3 > 0, c("p_brand")).alias("creator"), c("p_size").alias("pageCount"), (c("p_partkey") % 5 == 0).alias("isEncrypted")).alias("m"))
    rows = plan.metadata_rows({"Source Application": c("m.creator"), "Page Count": c("m.pageCount"), "Encrypted": F.when(c("m.isEncrypted"), "Yes").otherwise("No")})
    return p.select("p_partkey", F.inline(rows))


@query("""WITH p AS (SELECT p_partkey AS k, (p_partkey % 41)::INT AS n FROM part) SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 'https://a.b' ELSE '' END AS safe_urls, CASE WHEN k % 2 = 0 THEN 'https://x.y' ELSE '' END AS failure_url, (1 + k % 40)::INT AS issue_nodes, least(25, n) AS kept_nodes,
 CASE WHEN n % 2 = 0 THEN 'https://help/' || n ELSE '' END AS help_url, CASE n % 3 WHEN 0 THEN '' WHEN 1 THEN 'wcag2a,cat.x' ELSE 'wcag2a' END AS tags FROM p""")
def sanitized_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored reports without links that could run anything, and slim issues."""
    k = c("p_partkey")
    link = lambda u: F.struct(u.alias("url"))
    helps = F.array(link(F.when(k % 3 == 0, "https://a.b").otherwise("javascript:1")), link(F.lit("data:x")))
    fails = F.array(F.struct(F.lit("1.1.1").alias("criterion"), F.when(k % 2 == 0, "https://x.y").otherwise("javascript:2").alias("url")))
    nodes = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.array(i.cast("string")).alias("target")))).otherwise(F.array().cast("array<struct<target:array<string>>>"))
    issue = lambda n: records.slim_issue(F.struct(F.lit("i").alias("id"), F.lit(None).cast("string").alias("impact"), F.lit("d").alias("description"), F.when(n % 2 == 0, F.concat(F.lit("https://help/"), n.cast("string"))).alias("helpUrl"), F.when(n % 3 > 0, F.array(F.lit("wcag2a"), F.when(n % 3 == 1, "cat.x"))).alias("tags"), nodes(n).alias("nodes")))
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(F.transform(plan.safe_links(helps), lambda x: x["url"]), ",").alias("safe_urls"), F.get(plan.safe_findings(fails), F.lit(0))["url"].alias("failure_url"), issue((1 + k % 40).cast("int"))["nodeCount"].alias("issue_nodes"), F.size(issue((k % 41).cast("int"))["nodes"]).alias("kept_nodes"), issue((k % 41).cast("int"))["helpUrl"].alias("help_url"), F.array_join(issue((k % 41).cast("int"))["tags"], ",").alias("tags"))


@query(f"""WITH {A.categories_sql()}, {A.REPORT}, r AS (SELECT report.*, 'Doc <' || doc_id || '>' AS title FROM report),
 l AS (SELECT doc_id, list(struct_pack(id := id, score := coalesce(score::VARCHAR, 'n/a'), grade := coalesce(grade, '-')) ORDER BY coalesce(score, 101), ord) AS x FROM cat GROUP BY doc_id)
 SELECT doc_id, title || ': ' || overall_score || '/100 (' || grade || ')' || chr(10) || array_to_string(list_transform(x, lambda c: '- ' || c.id || ': ' || c.score || ' ' || c.grade), chr(10)) AS text,
 '# ' || title || chr(10) || chr(10) || '**Score** ' || overall_score || '/100 (' || grade || ')' || chr(10) || chr(10) || '| Category | Score |' || chr(10) || '|---|---|' || chr(10) || array_to_string(list_transform(x, lambda c: '| ' || c.id || ' | ' || c.score || ' ' || c.grade || ' |'), chr(10)) AS markdown,
 '<h1>Doc &lt;' || doc_id || '&gt;</h1><p>' || overall_score || '/100 (' || grade || ')</p><table>' || array_to_string(list_transform(x, lambda c: '<tr><td>' || c.id || '</td><td>' || c.score || ' ' || c.grade || '</td></tr>'), '') || '</table>' AS html FROM r JOIN l USING (doc_id)""")
def text_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = scoring.report(scoring.nest(A.category_results(spark, sf_dir)))
    return reports.export_text(nested, F.concat(F.lit("Doc <"), c("doc_id").cast("string"), F.lit(">")))


@query(f"""WITH {A.PUBLICATIONS}, g AS (SELECT count(*) AS total, count(*) FILTER (grade = 'A') AS a, count(*) FILTER (grade = 'B') AS b, count(*) FILTER (grade = 'C') AS c, count(*) FILTER (grade = 'D') AS d, count(*) FILTER (grade = 'F') AS f FROM pub)
 SELECT total || ' documents (A: ' || a || ', B: ' || b || ', C: ' || c || ', D: ' || d || ', F: ' || f || ') ' || floor((a + b) / total::DOUBLE * 100 + 0.5)::INT || '% pass, ' || floor((c + d + f) / total::DOUBLE * 100 + 0.5)::INT || '% need remediation' AS line FROM g""")
def export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary_lines(fleet.assess(fleet.grade_distribution(A.publications(spark, sf_dir))))


@query(f"WITH {A.PUBLICATIONS} SELECT doc_id, grade FROM pub ORDER BY ascii(grade) DESC, doc_id LIMIT 25 OFFSET 50")
def third_table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 25 rows of the table of publications, worst grade first."""
    return reports.table_page(A.publications(spark, sf_dir), "grade", 2, 25, descending=True).select("doc_id", "grade")


_RUNS = "user_id AS shape, event_id AS ord, CASE WHEN event_id % 4 > 0 THEN 'r' || event_id % 2 END AS link, 't' || event_id % 10 AS text"


@query(f"""WITH e AS (SELECT {_RUNS} FROM events), m AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM link AND n > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY shape ORDER BY ord) AS run FROM (SELECT *, lag(link) OVER w AS prev, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY shape ORDER BY ord)))
 SELECT shape, link, string_agg(text, '' ORDER BY ord) AS text, min(ord) AS first FROM m WHERE link IS NOT NULL GROUP BY shape, run, link""")
def merged_link_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.merged_runs(table(spark, sf_dir, "events").selectExpr(*(x.strip() for x in _RUNS.split(", "))), "shape", "ord", "link", "text")


_BOX = "l_orderkey AS doc_id, l_linenumber AS page, l_partkey AS link_id, CAST(l_suppkey % 50 * 10 AS DOUBLE) AS x0, CAST(l_suppkey % 50 * 10 + l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 7 * 10 AS DOUBLE) AS y0, CAST(l_suppkey % 7 * 10 + 12 AS DOUBLE) AS y1"
_ANCHOR = "l_orderkey AS doc_id, l_linenumber AS page, l_suppkey AS pos, 's' || l_suppkey AS str, CAST(l_partkey % 500 AS DOUBLE) AS x, CAST(l_partkey % 70 AS DOUBLE) AS y"


@query(f"""WITH b AS (SELECT DISTINCT {_BOX} FROM lineitem), a AS (SELECT DISTINCT {_ANCHOR} FROM lineitem)
 SELECT b.doc_id, b.page, link_id, coalesce(string_agg(str, ' ' ORDER BY pos, str) FILTER (x BETWEEN x0 - 5 AND x1 + 5 AND y BETWEEN y0 - 5 AND y1 + 5), '') AS text FROM b LEFT JOIN a ON a.doc_id = b.doc_id AND a.page = b.page GROUP BY b.doc_id, b.page, link_id""")
def link_box_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return extraction.link_texts(li.selectExpr(*_BOX.split(", ")).distinct(), li.selectExpr(*_ANCHOR.split(", ")).distinct())


@query("""SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS annotation FROM lineitem WHERE l_linenumber <> 3 AND (l_orderkey, l_partkey) NOT IN (SELECT (l_orderkey, l_partkey) FROM lineitem WHERE l_suppkey % 2 = 0)""")
def unclaimed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    notes = li.select(c("l_orderkey").alias("doc_id"), c("l_partkey").alias("annotation"), (c("l_linenumber") == 3).alias("hidden"))
    return extraction.unclaimed(notes, li.where("l_suppkey % 2 = 0").select(c("l_orderkey").alias("doc_id"), c("l_partkey").alias("annotation"))).select("doc_id", "annotation").distinct()


@query("""WITH r AS (SELECT p_partkey AS k, unnest(range(1, (p_partkey % 30)::INT + 1)) AS i FROM part), v AS (SELECT k, i, (k * i) % 9 AS n FROM r WHERE (k * i) % 9 > 0),
 w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, i) AS place FROM v),
 t AS (SELECT k, count(*) AS rules, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (place <= 3), 0)::BIGINT AS three, string_agg('c' || i || ':' || n, ',' ORDER BY place) FILTER (place <= 20) AS top FROM w GROUP BY k)
 SELECT p_partkey, p_partkey % 2 = 0 AS passed, coalesce(rules, 0)::INT AS distinct_rules, CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE coalesce(total, 0) END::BIGINT AS total_failures, coalesce(top, '') AS failures,
 CASE WHEN p_partkey % 3 = 0 THEN coalesce(three, 0) / 100.0::DOUBLE WHEN total > 0 THEN three / total::DOUBLE END AS top3_share FROM part LEFT JOIN t ON t.k = p_partkey""")
def validator_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    rules = F.transform(F.filter(F.sequence(F.lit(1), F.lit(30)), lambda i: i <= k % 30), lambda i: F.struct(F.concat(F.lit("c"), i.cast("string")).alias("clause"), (k * i % 9).cast("long").alias("count")))
    report = F.struct((k % 2 == 0).alias("compliant"), F.when(k % 3 == 0, F.lit(100).cast("long")).alias("failedChecks"), rules.alias("rules"))
    p = table(spark, sf_dir, "part").select("p_partkey", report.alias("r"))
    v = extraction.validator_verdict(c("r"))
    v["failures"] = F.array_join(F.transform(v["failures"], lambda x: F.concat(x["clause"], F.lit(":"), x["count"].cast("string"))), ",")
    return p.select("p_partkey", *(x.alias(n) for n, x in v.items()))


@query(f"""WITH {A.categories_sql()}, m(id, shown, principle) AS (VALUES ('text_extractability', '1.3.1 Info and Relationships (Level A), 1.4.5 Images of Text (Level AA)', 'Perceivable'), ('title_language', '2.4.2 Page Titled (Level A), 3.1.1 Language of Page (Level A)', 'Operable / Understandable'),
 ('heading_structure', '1.3.1 Info and Relationships (Level A), 2.4.6 Headings and Labels (Level AA)', 'Perceivable / Operable'), ('alt_text', '1.1.1 Non-text Content (Level A)', 'Perceivable'), ('bookmarks', '2.4.5 Multiple Ways (Level AA)', 'Operable'),
 ('table_markup', '1.3.1 Info and Relationships (Level A)', 'Perceivable'), ('link_quality', '2.4.4 Link Purpose (In Context) (Level A)', 'Operable'))
 SELECT doc_id, CASE WHEN ord = 5 THEN 'other' ELSE cat.id END AS id, CASE WHEN ord = 5 THEN '' ELSE shown END AS shown, CASE WHEN ord <> 5 THEN principle END AS principle FROM cat JOIN m ON m.id = cat.id""")
def criteria_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria and principle of each category; one in seven isn't known."""
    cats = A.category_results(spark, sf_dir).withColumn("id", F.when(c("ord") == 5, "other").otherwise(c("id")))
    return reports.shown_criteria(cats).select("doc_id", "id", F.array_join("shown", ", ").alias("shown"), "principle")


@query(f"""WITH {A.categories_sql()} SELECT doc_id, id, CASE id WHEN 'text_extractability' THEN '1.1.1,1.3.1' WHEN 'title_language' THEN '2.4.2,3.1.1' WHEN 'heading_structure' THEN '1.3.1,2.4.6' WHEN 'alt_text' THEN '1.1.1' WHEN 'bookmarks' THEN '2.4.5' WHEN 'table_markup' THEN '1.3.1' WHEN 'link_quality' THEN '2.4.4' END AS criteria FROM cat""")
def criteria_of_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_criteria(A.category_results(spark, sf_dir)).select("doc_id", "id", F.array_join("criteria", ",").alias("criteria"))


@query("""SELECT '"' || replace(p_name || ', "' || p_partkey || '"', '"', '""') || '",' || CASE WHEN p_partkey % 3 = 0 THEN chr(39) || '=1+1' WHEN p_partkey % 3 = 1 THEN '' ELSE chr(39) || '@x' END || ',' || p_size AS line FROM part""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(', "'), c("p_partkey").cast("string"), F.lit('"')).alias("a"), F.when(c("p_partkey") % 3 == 0, "=1+1").when(c("p_partkey") % 3 == 2, "@x").alias("b"), "p_size")
    return reports.export_csv(p, ["a", "b", "p_size"])


@query(f"""WITH {A.categories_sql()} SELECT doc_id, id FROM cat WHERE (score IS NOT NULL AND score + doc_id % 9 * 20 - 60 NOT BETWEEN 0 AND 100) OR (score IS NOT NULL AND doc_id % 4 = 0)""")
def broken_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = A.category_results(spark, sf_dir).withColumns({"score": (c("score") + c("doc_id") % 9 * 20 - 60).cast("int"), "not_assessed": c("doc_id") % 4 == 0})
    return reports.profile_invariants(cats).select("doc_id", "id")


@query("""WITH p AS (SELECT p_partkey AS k, p_name || CASE p_partkey % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tsv' WHEN 2 THEN '.Doc' WHEN 3 THEN '.x.xlsx' WHEN 4 THEN '.zip' ELSE '' END AS f, (p_partkey * 7919 % 100003) * (p_partkey % 5 * 900 + 1) AS n FROM part)
 SELECT k AS p_partkey, k % 6 IN (0, 3) AS supported, CASE k % 6 WHEN 1 THEN 'csv' WHEN 2 THEN 'doc' END AS unsupported, CASE WHEN length(repeat(f, 6)) > 80 THEN substr(repeat(f, 6), 1, 79) || '…' ELSE repeat(f, 6) END AS short, '&lt;a href=&quot;' || k || '&quot;&gt;&amp;&#39;' AS escaped,
 CASE k % 3 WHEN 0 THEN '1.' || k WHEN 1 THEN '2.0.' || k END AS version, upper(lpad(printf('%x', (k % 256)::INT), 6, '0')) AS rgb,
 CASE WHEN n >= 1073741824 THEN printf('%.1f', floor(n / 1073741824.0::DOUBLE * 10 + 0.5) / 10) || ' GB' WHEN n >= 1048576 THEN printf('%.1f', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' WHEN n >= 1024 THEN printf('%.1f', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' ELSE n || ' B' END AS size,
 k % 4 IN (0, 1) AS safe FROM p""")
def names_and_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("p_partkey")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (k % len(xs)).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", pick(".PDF", ".tsv", ".Doc", ".x.xlsx", ".zip", "")).alias("f"), (k * 7919 % 100003 * (k % 5 * 900 + 1)).alias("n"))
    version = F.when(k % 3 == 0, F.concat(F.lit("tool 1."), k.cast("string"), F.lit(" beta"))).when(k % 3 == 1, F.concat(F.lit("v2.0."), k.cast("string"))).otherwise("none")
    return p.select(
        "p_partkey", files.supported(c("f")).alias("supported"), files.unsupported_format(c("f")).alias("unsupported"), text.shorten(F.repeat("f", F.lit(6))).alias("short"), text.html_escape(F.concat(F.lit('<a href="'), k.cast("string"), F.lit("\">&'"))).alias("escaped"),
        text.first_version(version).alias("version"), color.argb_hex(F.concat(F.lit("ff"), F.lpad(F.lower(F.hex(k % 256)), 6, "0"))).alias("rgb"), text.file_size(c("n")).alias("size"), urls.safe_http(F.concat(pick("https://a.b/", "HTTP://c/", "javascript:", "/"), k.cast("string"))).alias("safe"),
    )


_OF = "CASE WHEN {n} = 0 THEN 'passed' WHEN {bad} THEN 'failed' ELSE 'passed' END"
_BAD = lambda n, m: f"len(list_filter(range(1, k % {n} + 1), lambda i: (k + i) % {m} = 0)) > 0"
_NC = lambda n: f"CASE WHEN k % {n} = 0 THEN 'passed' ELSE 'not_computed' END"
_RULES = [
    ("CASE WHEN k % 11 = 0 THEN 'failed' ELSE 'passed' END", "FALSE"), ("CASE WHEN txt OR tree THEN 'passed' ELSE 'failed' END", "FALSE"), ("CASE WHEN tree THEN 'passed' ELSE 'failed' END", "tree AND k % 4 = 0"), ("'manual'", "FALSE"),
    ("CASE WHEN lang THEN 'passed' ELSE 'failed' END", "FALSE"), ("CASE WHEN k % 4 = 2 THEN 'passed' ELSE 'failed' END", "FALSE"), ("CASE WHEN pages < 21 OR outline_tree THEN 'passed' ELSE 'failed' END", "pages < 21"), ("'manual'", "FALSE"), ("'failed'", "FALSE"),
    (f"CASE WHEN k % 4 = 0 THEN 'passed' WHEN NOT tree OR {_BAD(4, 4)} THEN 'failed' ELSE 'passed' END", "k % 4 = 0"), ("'failed'", "FALSE"), ("'passed'", "TRUE"), *[("'passed'", "TRUE")] * 4, ("CASE WHEN k % 4 < 3 THEN 'passed' ELSE 'failed' END", "k % 4 = 0"),
    (_NC(3), "k % 3 = 0"), (_OF.format(n="k % 3", bad="labelled < k % 3"), "k % 3 = 0"), (_OF.format(n="k % 4", bad="alts < figs"), "k % 4 = 0"), (_NC(4), "k % 4 = 0"), (_NC(4), "k % 4 = 0"), (_NC(4), "k % 4 = 0"), ("'not_computed'", "FALSE"),
    (_OF.format(n="k % 3", bad=_BAD(3, 6)), "k % 3 = 0"), (_NC(3), "k % 3 = 0"), (_OF.format(n="k % 3", bad=_BAD(3, 4)), "k % 3 = 0"), (_OF.format(n="k % 3", bad=_BAD(3, 8)), "k % 3 = 0"), ("'skipped'", "FALSE"),
    (_NC(2), "k % 2 = 0"), (_OF.format(n="k % 2", bad="k % 5 = 0"), "k % 2 = 0"), (_OF.format(n="k % 5", bad="jump"), "k % 5 = 0"),
]


@query(f"""WITH {A.PDF_RECORDS}, s AS (SELECT doc_id, [{", ".join(a for a, _ in _RULES)}] AS st, [{", ".join(b for _, b in _RULES)}] AS va FROM q)
 SELECT doc_id, {", ".join(f"len(list_filter(st, lambda x: x = '{n}'))::BIGINT AS {n}" for n in ("passed", "failed", "manual", "skipped", "not_computed"))}, len(list_filter(range(1, 33), lambda i: st[i] = 'passed' AND va[i]))::BIGINT AS vacuous_passes, len(st)::BIGINT AS total FROM s""")
def pdf_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checklist.checklist_summary(A.pdf_records(spark, sf_dir))


@query(f"""WITH {A.PDF_RECORDS}, s AS (SELECT doc_id, [{", ".join(a for a, _ in _RULES)}] AS st, [{", ".join(b for _, b in _RULES)}] AS va FROM q)
 SELECT doc_id, i::INTEGER AS ord, st[i] AS status, va[i] AS vacuous FROM (SELECT *, unnest(range(1, 33)) AS i FROM s)""")
def pdf_checklist_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the checklist for every document, in the order of the rules."""
    return checklist.checklist(A.pdf_records(spark, sf_dir)).drop("rule")
