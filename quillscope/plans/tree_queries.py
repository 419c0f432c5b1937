"""Queries over trees, linked lists and nested marks, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import objects, trees
from ..written import cut, release
from .adapters import table
from .queries import query

c = F.col

# A deep tree of events: four documents, each event below one of the three before
# it; a few point forward, which makes circles and cuts off what is below them.
_DEEP = """SELECT event_id % 4 AS doc_id, event_id AS node, event_type,
  CASE WHEN event_id < 4 THEN NULL WHEN event_id % 1999 = 15 THEN event_id + 4
       ELSE event_id - 4 * least(1 + (event_id // 4) % 3, event_id // 4) END AS parent FROM events"""
_PATHS = """t AS (
  SELECT doc_id, node, parent, node AS root, [node] AS path FROM n WHERE parent IS NULL OR parent NOT IN (SELECT node FROM n)
  UNION ALL SELECT n.doc_id, n.node, n.parent, t.root, list_append(t.path, n.node) FROM t JOIN n ON n.parent = t.node AND n.doc_id = t.doc_id),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, root ORDER BY path) - 1 AS place, len(path) - 1 AS depth FROM t)"""


def _spark_sql(text: str) -> str:
    return text.replace("//", "div")


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(_spark_sql(_DEEP))


def _places(rows: DataFrame) -> DataFrame:
    return trees.tree_places(rows.select("doc_id", "node", "parent", c("node").alias("place")))


@query(f"""WITH RECURSIVE n AS ({_DEEP}), {_PATHS},
 s AS (SELECT doc_id, root, above AS node, count(*) AS size FROM (SELECT doc_id, root, unnest(path) AS above FROM t) GROUP BY ALL)
 SELECT n.doc_id, n.node, p.depth::BIGINT AS depth, p.place::BIGINT AS place, (p.place + s.size - 1)::BIGINT AS last
 FROM n LEFT JOIN p ON p.doc_id = n.doc_id AND p.node = n.node LEFT JOIN s ON s.doc_id = n.doc_id AND s.node = n.node""")
def structure_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, place in the document and last place below each element of a deep
    structure tree; elements on circles have none."""
    return _places(_deep(spark, sf_dir)).select("doc_id", "node", "depth", "place", "last")


@query(f"""WITH RECURSIVE n AS ({_DEEP}), {_PATHS},
 h AS (SELECT doc_id, place, CASE event_type WHEN 'click' THEN 'H1' WHEN 'view' THEN 'H2' WHEN 'error' THEN 'H' WHEN 'purchase' THEN CASE WHEN doc_id % 2 = 0 THEN 'H3' END END AS level FROM p JOIN n USING (doc_id, node) WHERE depth <= 200)
 SELECT doc_id, least(max(depth), 50)::INTEGER AS depth, (SELECT count(level) FROM h WHERE h.doc_id = p.doc_id) AS headings,
  (SELECT string_agg(level, ',' ORDER BY place) FROM h WHERE h.doc_id = p.doc_id) AS levels FROM p GROUP BY doc_id""")
def structure_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each document's tree, and its headings in document order."""
    rows = _deep(spark, sf_dir)
    places = _places(rows)
    tag = F.expr("CASE event_type WHEN 'click' THEN 'H1' WHEN 'view' THEN 'H2' WHEN 'error' THEN 'H' WHEN 'purchase' THEN 'Kop' ELSE 'P' END")
    roles = rows.select("doc_id").distinct().where("doc_id % 2 = 0").select("doc_id", F.lit("Kop").alias("tag"), F.lit("H3").alias("role"))
    found = trees.headings_in_order(places, rows.select("doc_id", "node", tag.alias("tag")), roles)
    levels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "level"))), lambda x: x["level"]), ",")
    listed = found.groupBy("doc_id").agg(F.count("*").alias("headings"), levels.alias("levels"))
    return trees.document_depth(places).join(listed, "doc_id", "left").select("doc_id", "depth", F.coalesce("headings", F.lit(0)).alias("headings"), "levels")


_BROAD = "SELECT p_partkey % 8 AS doc_id, p_partkey AS node, p_name, p_size, CASE WHEN p_partkey > 8 * (1 + (p_partkey // 8) % 4) THEN p_partkey - 8 * (1 + (p_partkey // 8) % 4) END AS parent FROM part"


def _broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(_spark_sql(_BROAD))


@query(f"""WITH RECURSIVE n AS ({_BROAD}), r AS (SELECT doc_id, node, CASE WHEN parent IS NULL THEN [] ELSE [parent] END AS above, parent FROM n
  UNION ALL SELECT r.doc_id, r.node, list_append(r.above, n.parent), n.parent FROM r JOIN n ON n.node = r.parent WHERE n.parent IS NOT NULL),
 a AS (SELECT doc_id, node, arg_max(above, len(above)) AS above FROM r GROUP BY ALL)
 SELECT a.doc_id, a.node, EXISTS (SELECT 1 FROM n g WHERE g.p_size < 6 AND list_contains(a.above, g.node)) AS covered FROM a JOIN n USING (node) WHERE p_size % 2 = 1""")
def covered_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the alternative text of a group above covers a picture."""
    rows = _broad(spark, sf_dir)
    places = _places(rows).join(rows.select("doc_id", "node", "p_size"), ["doc_id", "node"])
    return trees.covered(places, c("p_size") < 6).where("p_size % 2 = 1").select("doc_id", "node", "covered")


_ENTRIES = f"""SELECT doc_id, node, CASE WHEN node % 6 = 0 THEN '' ELSE p_name END AS title, parent,
  coalesce(lead(node) OVER (PARTITION BY doc_id, parent ORDER BY node), CASE WHEN parent % 11 = 0 THEN first_value(node) OVER (PARTITION BY doc_id, parent ORDER BY node) END) AS next FROM ({_BROAD})"""


@query(f"""WITH RECURSIVE n AS ({_BROAD}), {_PATHS.replace("node AS root", "-1 AS root")},
 f AS (SELECT doc_id, place, repeat('  ', depth) || p_name AS title FROM p JOIN n USING (doc_id, node) WHERE node % 6 <> 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) <= 50)
 SELECT doc_id, (SELECT count(*) FROM p WHERE p.doc_id = f.doc_id) AS entries, string_agg(title, '|' ORDER BY place) AS titles FROM f GROUP BY doc_id""")
def outline_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of outlines that are linked by first child and next sibling; the
    last of some lists leads back to the first."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(_spark_sql(_ENTRIES))
    first = rows.groupBy("doc_id", c("parent").alias("node")).agg(F.min("node").alias("first"))
    entries = rows.join(first.where("node is not null"), ["doc_id", "node"], "left").select("doc_id", "node", "first", "next")
    places = trees.outline_places(entries, first.where("node is null").select("doc_id", "first"))
    return trees.outline_titles(places, rows).withColumn("titles", F.array_join("titles", "|"))


_TOKENS = r"(?s)<[^>]*>|[^<]+"


@query(rf"""WITH RECURSIVE k AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{_TOKENS}')) AS t, generate_subscripts(regexp_extract_all(html, '{_TOKENS}'), 1) AS ord FROM pages),
 m AS (SELECT doc_id, ord, t, lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1)) AS tag, CASE WHEN t NOT LIKE '<%' THEN 'text' WHEN t LIKE '</%' THEN 'end' WHEN regexp_matches(t, '^<[A-Za-z]') THEN 'begin' END AS kind FROM k),
 e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM m WHERE kind = 'text' OR (kind IS NOT NULL AND tag NOT IN ('br', 'meta', 'link', 'img', 'input', 'hr'))),
 s AS (SELECT doc_id, 0::BIGINT AS n, []::VARCHAR[] AS open, NULL::VARCHAR AS id, NULL::VARCHAR AS t FROM (SELECT DISTINCT doc_id FROM e)
  UNION ALL SELECT s.doc_id, e.n, CASE e.kind WHEN 'begin' THEN list_append(s.open, CASE WHEN e.tag NOT IN ('a', 'b') THEN e.tag || e.ord END) WHEN 'end' THEN s.open[:-2] ELSE s.open END,
   CASE WHEN e.kind = 'text' THEN list_filter(s.open, lambda x: x IS NOT NULL)[-1] END, CASE WHEN e.kind = 'text' THEN e.t END FROM s JOIN e ON e.doc_id = s.doc_id AND e.n = s.n + 1)
 SELECT doc_id, id, string_agg(t, '' ORDER BY n) AS text FROM s WHERE id IS NOT NULL GROUP BY doc_id, id""")
def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every element of the pages, to the innermost one that isn't a
    link or in bold."""
    tokens = table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit(_TOKENS), F.lit(0))).alias("pos", "t"))
    kind = F.when(~c("t").startswith("<"), "text").when(c("t").startswith("</"), "end").when(c("t").rlike("^<[A-Za-z]"), "begin")
    tag = F.lower(F.regexp_extract("t", "^</?([A-Za-z0-9]+)", 1))
    marks = tokens.withColumns({"kind": kind, "tag": tag, "ord": c("pos") + 1}).where("kind = 'text' or (kind is not null and tag not in ('br', 'meta', 'link', 'img', 'input', 'hr'))")
    name = F.when((c("kind") == "begin") & ~c("tag").isin("a", "b"), F.concat("tag", "ord"))
    items = marks.select("doc_id", "ord", "kind", name.alias("id"), F.when(c("kind") == "text", c("t")).alias("text"), F.lit(False).alias("line_end"))
    return trees.marked_texts(items)


_OPERATIONS = """SELECT user_id AS doc_id, CAST(event_id % 2 AS INT) AS page, event_id AS ord,
  CASE event_id // 2 % 7 WHEN 0 THEN 'save' WHEN 1 THEN 'restore' WHEN 2 THEN 'font' WHEN 3 THEN 'mode' ELSE 'show' END AS op,
  CASE WHEN event_id // 2 % 5 > 0 THEN concat('F', event_id // 2 % 5) END AS font,
  CAST(CASE event_id // 2 % 3 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS INT) AS mode, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS text FROM events"""


@query(f"""WITH RECURSIVE o AS ({_OPERATIONS}), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS n FROM o),
 s AS (SELECT doc_id, page, 0::BIGINT AS n, []::STRUCT(f VARCHAR, m INTEGER)[] AS saved, struct_pack(f := NULL::VARCHAR, m := 0) AS now, FALSE AS seen FROM (SELECT DISTINCT doc_id, page FROM e)
  UNION ALL SELECT s.doc_id, s.page, e.n, CASE e.op WHEN 'save' THEN list_append(s.saved, s.now) WHEN 'restore' THEN s.saved[:-2] ELSE s.saved END,
   CASE WHEN e.op = 'font' THEN struct_pack(f := e.font, m := s.now.m) WHEN e.op = 'mode' AND e.mode IS NOT NULL THEN struct_pack(f := s.now.f, m := e.mode) WHEN e.op = 'restore' AND len(s.saved) > 0 THEN s.saved[-1] ELSE s.now END,
   e.op = 'show' AND s.now.m <> 3 AND trim(e.text) <> '' FROM s JOIN e ON e.doc_id = s.doc_id AND e.page = s.page AND e.n = s.n + 1)
 SELECT doc_id, coalesce(string_agg(DISTINCT now.f, ',' ORDER BY now.f), '') AS fonts, bool_or(now.f IS NULL) AS unresolved FROM s WHERE seen GROUP BY doc_id""")
def visible_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts of visible text under saved and restored text states."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return trees.visible_fonts(spark.sql(_spark_sql(_OPERATIONS))).withColumn("fonts", F.array_join("fonts", ","))


_VALUES = """SELECT DISTINCT l_orderkey % 50 AS doc_id, CAST(l_partkey % 400 AS VARCHAR(9)) AS source, CAST(l_suppkey * 7 % 400 AS VARCHAR(9)) AS target,
  CASE l_linenumber WHEN 1 THEN 'Font' WHEN 2 THEN 'entry' WHEN 3 THEN 'DescendantFonts' WHEN 4 THEN 'FontDescriptor' WHEN 5 THEN 'BaseFont' ELSE 'inside' END AS key FROM lineitem"""


@query(f"""WITH RECURSIVE v AS ({_VALUES}), r AS (SELECT DISTINCT doc_id, source AS node, 0 AS steps FROM v WHERE source LIKE '%9'
  UNION SELECT r.doc_id, v.target, steps + 1 FROM r JOIN v ON v.doc_id = r.doc_id AND v.source = r.node AND v.key = 'inside' WHERE steps < 12),
 d AS (SELECT DISTINCT r.doc_id, v.target AS node FROM r JOIN v ON v.doc_id = r.doc_id AND v.source = r.node AND v.key = 'Font'),
 f AS (SELECT DISTINCT d.doc_id, v.target AS font FROM d JOIN v ON v.doc_id = d.doc_id AND v.source = d.node AND v.key = 'entry'),
 u AS (SELECT doc_id, font, font AS part FROM f UNION SELECT f.doc_id, font, v.target FROM f JOIN v ON v.doc_id = f.doc_id AND v.source = font AND v.key = 'DescendantFonts'),
 x AS (SELECT u.doc_id, font, part, v.target AS descriptor FROM u JOIN v ON v.doc_id = u.doc_id AND v.source = part AND v.key = 'FontDescriptor'),
 o AS (SELECT doc_id, descriptor, font AS name_of FROM x UNION SELECT doc_id, descriptor, part FROM x)
 SELECT o.doc_id, descriptor, coalesce(string_agg(DISTINCT v.target, ',' ORDER BY v.target), '') AS names FROM o LEFT JOIN v ON v.doc_id = o.doc_id AND v.source = name_of AND v.key = 'BaseFont' GROUP BY o.doc_id, descriptor""")
def reachable_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Font descriptors that some resource dictionary leads to."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    values = cut(spark.sql(_VALUES))
    objects = values.where("source like '%9'").select("doc_id", c("source").alias("node")).distinct()
    return trees.live_fonts(objects, values).withColumn("names", F.array_join("names", ","))


# Tables of orders: rows are lines, some in a section, cells the items of a line;
# a seventh of the tables stand in another one.
_ORDER_LINES = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i, l_orderkey * 10000 AS base FROM lineitem"
_TABLES = f"""SELECT DISTINCT l_orderkey % 100 AS doc_id, base AS node, CASE WHEN l_orderkey % 7 = 0 THEN base - 1000000 + 101 END AS parent, 'Table' AS tag, FALSE AS scope, FALSE AS headers, 1 AS col_span, 1 AS row_span FROM lines
 UNION ALL SELECT DISTINCT l_orderkey % 100, base + 9000, base, 'Caption', FALSE, FALSE, 1, 1 FROM lines WHERE l_orderkey % 5 = 0
 UNION ALL SELECT DISTINCT l_orderkey % 100, base + 350, base, 'TBody', FALSE, FALSE, 1, 1 FROM lines WHERE l_linenumber > 3
 UNION ALL SELECT DISTINCT l_orderkey % 100, base + 100 * l_linenumber, CASE WHEN l_linenumber > 3 THEN base + 350 ELSE base END, 'TR', FALSE, FALSE, 1, 1 FROM lines
 UNION ALL SELECT l_orderkey % 100, base + 100 * l_linenumber + i, base + 100 * l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN 'TH' ELSE 'TD' END, l_partkey % 8 = 0, l_suppkey % 5 = 0, CAST(1 + l_suppkey % 2 AS INT), CAST(1 + l_partkey % 3 AS INT) FROM lines"""


def _of_lines(spark: SparkSession, kinds: list[tuple], more: list[str]) -> DataFrame:
    """The elements of ``_TABLES`` or ``_LISTS`` in one pass over the lines: kinds are
    (whether a line makes one, node, parent, tag, further columns ``more``)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    line = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = spark.table("lineitem").withColumns({"_of_order": F.row_number().over(order), "_before": F.lag("l_linenumber").over(order), "i": F.row_number().over(line)})
    made = lines.withColumn("_kind", F.explode(F.array(*(F.lit(k) for k in range(len(kinds))))))

    def of(at: int) -> Column:
        value = F.lit(None)
        for k in reversed(range(len(kinds))):
            value = F.when(c("_kind") == k, kinds[k][at]).otherwise(value)
        return value

    names = ["node", "parent", "tag", *more]
    return cut(made.where(of(0)).select((c("l_orderkey") % 100).alias("doc_id"), *(of(k + 1).alias(n) for k, n in enumerate(names)), of(1).alias("place")))


@query(f"""WITH RECURSIVE lines AS ({_ORDER_LINES}), e AS ({_TABLES}),
 u AS (SELECT doc_id, node, node AS top FROM e WHERE tag = 'Table' UNION ALL SELECT e.doc_id, e.node, u.top FROM u JOIN e ON e.parent = u.node AND e.doc_id = u.doc_id),
 f AS (SELECT u.doc_id, u.top, count(*) FILTER (tag = 'TH') AS heads, count(*) FILTER (tag = 'TH' AND scope) AS scoped, count(*) FILTER (tag = 'TD') AS data, count(*) FILTER (tag = 'TD' AND headers) AS associated,
   count(*) FILTER (tag = 'Caption') AS captions, count(*) FILTER (tag = 'Table') AS tables FROM u JOIN e USING (doc_id, node) GROUP BY ALL),
 r AS (SELECT doc_id, node, node // 10000 * 10000 AS top, row_number() OVER (PARTITION BY doc_id, node // 10000 ORDER BY node) AS row FROM e WHERE tag = 'TR'),
 w AS (SELECT r.doc_id, r.top, r.row, coalesce(sum(e.col_span) FILTER (r.row < s.row + e.row_span), 0) AS width FROM r LEFT JOIN r s ON s.doc_id = r.doc_id AND s.top = r.top AND s.row <= r.row LEFT JOIN e ON e.doc_id = s.doc_id AND e.parent = s.node AND e.tag IN ('TH', 'TD') GROUP BY ALL),
 g AS (SELECT doc_id, top, count(*) AS rows, string_agg(width::INTEGER::VARCHAR, ',' ORDER BY row) AS widths, min(width) = max(width) AS same FROM w GROUP BY ALL)
 SELECT f.doc_id, f.top AS node, heads > 0 AS hasHeaders, heads::INTEGER AS headerCount, data::INTEGER AS dataCellCount, heads > 0 AND heads = scoped AS hasScope, (heads - scoped)::INTEGER AS scopeMissingCount,
  rows IS NOT NULL AS hasRowStructure, coalesce(rows, 0)::INTEGER AS rowCount, tables > 1 AS hasNestedTable, captions > 0 AS hasCaption, same AS hasConsistentColumns, coalesce(widths, '') AS columnCounts, associated > 0 AS hasHeaderAssociation
 FROM f LEFT JOIN g ON g.doc_id = f.doc_id AND g.top = f.top""")
def table_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tagged tables hold, from their rows up."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    yes, no, one = F.lit(True), F.lit(False), F.lit(1)
    base, at = c("l_orderkey") * 10000, c("l_linenumber")
    row = base + 100 * at
    elements = _of_lines(spark, [
        (c("_of_order") == 1, base, F.when(c("l_orderkey") % 7 == 0, base - 1000000 + 101), F.lit("Table"), no, no, one, one),
        ((c("_of_order") == 1) & (c("l_orderkey") % 5 == 0), base + 9000, base, F.lit("Caption"), no, no, one, one),
        ((at > 3) & (F.coalesce("_before", F.lit(0)) <= 3), base + 350, base, F.lit("TBody"), no, no, one, one),
        (c("i") == 1, row, F.when(at > 3, base + 350).otherwise(base), F.lit("TR"), no, no, one, one),
        (yes, row + c("i"), row, F.when(c("l_partkey") % 4 == 0, "TH").otherwise("TD"), c("l_partkey") % 8 == 0, c("l_suppkey") % 5 == 0, (1 + c("l_suppkey") % 2).cast("int"), (1 + c("l_partkey") % 3).cast("int")),
    ], ["scope", "headers", "col_span", "row_span"])
    found = trees.table_facts(elements)
    release(elements)
    return found.withColumn("columnCounts", F.array_join(c("columnCounts").cast("array<string>"), ","))


_LISTS = """SELECT DISTINCT l_orderkey % 100 AS doc_id, base AS node, CASE WHEN l_orderkey % 3 = 0 THEN base - 1000000 + 100 END AS parent, 'L' AS tag FROM lines
 UNION ALL SELECT DISTINCT l_orderkey % 100, base + 100 * l_linenumber, base, 'LI' FROM lines
 UNION ALL SELECT l_orderkey % 100, base + 100 * l_linenumber + i, base + 100 * l_linenumber, CASE WHEN i = 1 AND l_suppkey % 4 > 0 THEN 'LBody' WHEN l_partkey % 2 = 0 THEN 'Lbl' ELSE 'Span' END FROM lines"""


@query(f"""WITH RECURSIVE lines AS ({_ORDER_LINES}), e AS ({_LISTS}),
 u AS (SELECT doc_id, node, node AS top, 0 AS steps FROM e WHERE tag = 'L' UNION ALL SELECT e.doc_id, e.node, u.top, steps + 1 FROM u JOIN e ON e.parent = u.node AND e.doc_id = u.doc_id),
 k AS (SELECT doc_id, parent AS node, bool_or(tag = 'Lbl') AS label, bool_or(tag = 'LBody') AS body FROM e GROUP BY ALL)
 SELECT u.doc_id, top AS node, (count(*) FILTER (tag = 'LI'))::INTEGER AS itemCount, bool_or(tag = 'LI' AND coalesce(label, FALSE)) AS hasLabels, bool_or(tag = 'LI' AND coalesce(body, FALSE)) AS hasBodies,
  count(*) FILTER (tag = 'LI') > 0 AND count(*) FILTER (tag = 'LI') = count(*) FILTER (tag = 'LI' AND body) AS isWellFormed, coalesce(max(steps) FILTER (tag = 'L' AND steps <= 15), 0)::INTEGER AS nestingDepth
 FROM u JOIN e USING (doc_id, node) LEFT JOIN k ON k.doc_id = u.doc_id AND k.node = u.node GROUP BY u.doc_id, top""")
def list_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tagged lists hold, from their items up."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    base = c("l_orderkey") * 10000
    row = base + 100 * c("l_linenumber")
    elements = _of_lines(spark, [
        (c("_of_order") == 1, base, F.when(c("l_orderkey") % 3 == 0, base - 1000000 + 100), F.lit("L")),
        (c("i") == 1, row, base, F.lit("LI")),
        (F.lit(True), row + c("i"), row, F.when((c("i") == 1) & (c("l_suppkey") % 4 > 0), "LBody").when(c("l_partkey") % 2 == 0, "Lbl").otherwise("Span")),
    ], [])
    found = trees.list_facts(elements)
    release(elements)
    return found


# Content of the broad tree: every third element holds marked content, some elements
# name the page they are on, and some of those pages aren't there.
_CONTENT = f"""SELECT doc_id, node, parent, p_size, CASE WHEN node % 4 = 1 THEN 'Figure' ELSE 'P' END AS tag, node % 5 = 0 OR parent IS NULL AS has_page,
  CASE WHEN (node % 5 = 0 OR parent IS NULL) AND node % 35 <> 0 THEN CAST(node % 6 AS INT) END AS page, CASE WHEN node % 3 = 0 THEN CAST(p_size AS INT) END AS mark FROM ({_BROAD})"""


@query(f"""WITH RECURSIVE n AS ({_CONTENT}), {_PATHS},
 r AS (SELECT doc_id, node, node AS at FROM n WHERE mark IS NOT NULL UNION ALL SELECT r.doc_id, r.node, n.parent FROM r JOIN n ON n.node = r.at WHERE NOT n.has_page),
 e AS (SELECT r.doc_id, r.node, n.page FROM r JOIN n ON n.node = r.at WHERE n.has_page)
 SELECT e.doc_id, e.page, string_agg(n.mark::VARCHAR, ',' ORDER BY p.root, p.place) AS marks, coalesce(string_agg(n.mark::VARCHAR, ',' ORDER BY p.root, p.place) FILTER (f.tag = 'Figure'), '') AS figure_marks
 FROM e JOIN n ON n.node = e.node JOIN p ON p.node = e.node LEFT JOIN n f ON f.node = n.parent WHERE e.page IS NOT NULL GROUP BY e.doc_id, e.page""")
def content_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked content of each page in the order of the structure tree."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(_spark_sql(_CONTENT))
    places = _places(rows)
    # trees of a document stand one after the other
    placed = places.withColumn("place", F.struct("root", "place"))
    found = objects.content_by_page(placed, rows.select("doc_id", "node", "tag", "has_page", "page", "mark"))
    return found.withColumns({name: F.array_join(c(name).cast("array<string>"), ",") for name in ("marks", "figure_marks")})


_OBJECTS = """SELECT user_id AS doc_id, event_id AS object, kind, key, value FROM (SELECT user_id, event_id, CASE event_id % 8 WHEN 0 THEN 'Catalog' WHEN 1 THEN 'Catalog' WHEN 2 THEN 'AcroForm' WHEN 3 THEN 'ViewerPreferences' WHEN 4 THEN 'MarkInfo' WHEN 5 THEN 'StructTreeRoot' ELSE 'Page' END AS kind,
  CASE event_id % 8 WHEN 0 THEN CASE event_id // 8 % 5 WHEN 0 THEN 'Lang' WHEN 1 THEN 'Outlines' WHEN 2 THEN 'AcroForm' WHEN 3 THEN 'MarkInfo' ELSE 'Pages' END WHEN 1 THEN CASE event_id // 8 % 9 WHEN 0 THEN 'NeedsRendering' WHEN 1 THEN 'StructTreeRoot' ELSE 'Metadata' END
   WHEN 2 THEN CASE event_id // 8 % 11 WHEN 0 THEN 'XFA' ELSE 'Fields' END WHEN 3 THEN CASE event_id // 8 % 3 WHEN 0 THEN 'DisplayDocTitle' ELSE 'Other' END WHEN 4 THEN CASE event_id // 8 % 4 WHEN 0 THEN 'Marked' WHEN 1 THEN 'Suspects' ELSE 'UserProperties' END
   WHEN 5 THEN CASE event_id // 8 % 13 WHEN 0 THEN 'Type' ELSE 'K' END WHEN 6 THEN 'Type' ELSE 'Tabs' END AS key,
  CASE event_id // 8 % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'u:fr' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'S' END AS value FROM events)"""


def _any(kind: str, key: str, more: str = "value IS NOT NULL") -> str:
    return f"coalesce(bool_or(kind = '{kind}' AND key = '{key}' AND {more}), FALSE)"


@query(f"""WITH o AS ({_OBJECTS}) SELECT doc_id, {_any("Catalog", "StructTreeRoot")} OR {_any("StructTreeRoot", "Type")} AS hasStructTree, {_any("Catalog", "Lang")} AS hasLang,
  max(regexp_replace(value, '^u:', '')) FILTER (kind = 'Catalog' AND key = 'Lang') AS lang, {_any("Catalog", "Outlines")} AS hasOutlines, {_any("Catalog", "AcroForm")} AS hasAcroForm, {_any("AcroForm", "XFA")} AS hasXfa,
  bool_or(value = 'true') FILTER (kind = 'ViewerPreferences' AND key = 'DisplayDocTitle' AND value IN ('true', 'false')) AS displayDocTitle, {_any("Catalog", "NeedsRendering", "value = 'true'")} AS needsRendering,
  {_any("Catalog", "MarkInfo")} AS hasMarkInfo, {_any("MarkInfo", "Marked", "value = 'true'")} AS isMarkedContent, {_any("MarkInfo", "Suspects", "value = 'true'")} AS suspectsFlag,
  (count(*) FILTER (kind = 'Page' AND key = 'Type'))::INTEGER AS totalPageCount, (count(*) FILTER (kind = 'Page' AND key = 'Tabs' AND value <> ''))::INTEGER AS tabOrderPages FROM o GROUP BY doc_id""")
def catalog_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of a document's catalog, and its pages."""
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return objects.catalog_facts(spark.sql(_spark_sql(_OBJECTS)))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, 'ppt/slides/slide' || l_partkey % 40 || '.xml' AS part, l_partkey % 40 AS n FROM lineitem),
 r AS (SELECT l_orderkey AS doc_id, min(l_linenumber * 1000 + l_suppkey % 1000) AS ord, 'ppt/slides/slide' || l_suppkey % 40 || '.xml' AS part FROM lineitem GROUP BY ALL)
 SELECT s.doc_id, s.part, row_number() OVER (PARTITION BY s.doc_id ORDER BY r.ord IS NULL, r.ord, s.n, s.part)::INTEGER AS place FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND r.part = s.part""")
def slides_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides by the presentation's relationships, others by their number."""
    li = table(spark, sf_dir, "lineitem")
    slides = li.selectExpr("l_orderkey AS doc_id", "concat('ppt/slides/slide', l_partkey % 40, '.xml') AS part").distinct()
    rel = "concat('rId', l_linenumber * 1000 + l_suppkey % 1000)"
    listed = li.selectExpr("l_orderkey AS doc_id", "l_linenumber * 1000 + l_suppkey % 1000 AS ord", f"{rel} AS rel").distinct()
    links = li.selectExpr("l_orderkey AS doc_id", f"{rel} AS rel", "concat(CASE l_linenumber % 3 WHEN 0 THEN './' WHEN 1 THEN '/' ELSE '' END, 'slides/slide', l_suppkey % 40, '.xml') AS target").distinct()
    return objects.slide_order(slides, listed, links)


@query(f"""WITH RECURSIVE n AS ({_BROAD}), {_PATHS},
 o AS (SELECT doc_id, root * 100000 + place AS place, 'H' || (1 + node % 6) AS level FROM p WHERE doc_id % 2 = 0 AND node % 5 = 0),
 l AS (SELECT doc_id, node AS place, 'H' || (1 + node % 6) AS level FROM n WHERE node % 5 = 0)
 SELECT * FROM o UNION ALL SELECT * FROM l WHERE doc_id NOT IN (SELECT doc_id FROM o)""")
def headings_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in document order, or as objects list them where no tree has any."""
    rows = _broad(spark, sf_dir)
    level = F.concat(F.lit("H"), (1 + c("node") % 6).cast("string")).alias("level")
    heads = rows.where("node % 5 = 0")
    placed = _places(rows).where("doc_id % 2 = 0 AND node % 5 = 0").select("doc_id", (c("root") * 100000 + c("place")).alias("place"), level)
    return objects.headings_of(placed, heads.select("doc_id", c("node").alias("place"), level))
