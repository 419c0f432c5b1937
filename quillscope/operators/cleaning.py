"""Stored reports of any shape, cleaned of links that must not be shown.

A report is a VARIANT that is opened inside its row, down to ``SHALLOW`` levels, and
written again with the rules applied. Deeper ones are opened level by level into rows
(path, key, value), as many levels as the deepest one has; rules act on rows, and the
levels are put together again from the deepest one up. No shape has to be known, and
a value that no rule names comes back as it was (objects with their keys in order of
names, as VARIANT keeps them)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import safe_http
from ..written import cut, release

#: Lists of links, and the lists of findings of a conformance verdict.
LINKS, VERDICT, FINDINGS = "helpLinks", "conformance", ("failures", "notAssessed")
#: Levels that are opened inside a row, and what stands for others meanwhile: no
#: JSON text holds that character as it is.
SHALLOW, DEEPER = 8, "\x01"


def _kind(value: Column) -> Column:
    shape = F.schema_of_variant(value)
    return F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("leaf")


def _url(value: Column) -> Column:
    """The text under ``url`` of an object, if it is a text."""
    url = F.try_variant_get(value, "$.url", "variant")
    return F.when(F.schema_of_variant(url) == "STRING", F.try_variant_get(value, "$.url", "string"))


def _roles(above: Column, held: Column, key: Column, kind: Column) -> tuple[Column, Column]:
    """links (1 a list of links, 2 a link, 3 below one) and verdict (1 a verdict, 2 a
    list of its findings, 3 a finding, 4 its url, 9 others below one) of a value,
    by those of what it stands in."""
    is_ = lambda name: F.coalesce(key == name, F.lit(False))
    links = F.when(above == 1, 2).when(above >= 2, 3).when(is_(LINKS), F.when(kind == "array", 1).otherwise(3)).otherwise(0)
    listed = F.coalesce(key.isin(*FINDINGS), F.lit(False)) & (kind == "array")
    inner = F.when(held == 1, F.when(listed, 2).otherwise(9)).when(held == 2, F.when(kind == "object", 3).otherwise(9)).when(held == 3, F.when(is_("url"), 4).otherwise(9))
    top = F.when(is_(VERDICT), F.when(kind == "object", 1).otherwise(9)).otherwise(0)
    return links, F.when(held == 0, top).when(held >= 4, 9).otherwise(inner)


def _stays(links: Column, kind: Column, value: Column) -> Column:
    return (links != 2) | ((kind == "object") & F.coalesce(safe_http(_url(value)), F.lit(False)))


def _own(verdict: Column, value: Column) -> Column:
    """A value's text; a finding's address is empty unless it leads somewhere."""
    leads = F.coalesce(safe_http(F.try_variant_get(value, "$", "string")) & (F.schema_of_variant(value) == "STRING"), F.lit(False))
    return F.when((verdict == 4) & ~leads, F.lit('""')).otherwise(F.coalesce(F.to_json(value), F.lit("null")))


def _named(key: Column, text: Column) -> Column:
    return F.concat(F.regexp_replace(F.substring(F.to_json(F.array(key)), 2, 1 << 30), r"\]$", ""), F.lit(":"), text)


def _written(node: Column, levels: int) -> Column:
    """The text of a value (key, value, kind, links, verdict), cleaned; ``DEEPER``
    for what stands more than so many levels below it."""
    value, kind = node["value"], node["kind"]
    own = F.when(kind == "leaf", _own(node["verdict"], value))
    if not levels:
        return own.otherwise(F.lit(DEEPER))
    entry = lambda key, x: F.struct(key.alias("key"), x.alias("value"), _kind(x).alias("kind"))
    fields = F.transform(F.map_entries(F.try_variant_get(value, "$", "map<string,variant>")), lambda e: entry(e["key"], e["value"]))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: entry(F.lit(None).cast("string"), v))
    kids = F.when(kind == "object", fields).otherwise(items)

    def role(e: Column) -> Column:
        links, verdict = _roles(node["links"], node["verdict"], e["key"], e["kind"])
        return F.struct(e["key"].alias("key"), e["value"].alias("value"), e["kind"].alias("kind"), links.alias("links"), verdict.alias("verdict"))

    texts = F.transform(F.transform(kids, role), lambda e: F.struct(e["key"].alias("key"), _written(e, levels - 1).alias("text"), _stays(e["links"], e["kind"], e["value"]).alias("stays")))

    def put_together(every: Column) -> Column:
        parts = F.filter(every, lambda p: p["stays"])
        missing = (node["verdict"] == 3) & ~F.exists(parts, lambda p: F.coalesce(p["key"] == "url", F.lit(False)))
        pairs = F.transform(parts, lambda p: _named(p["key"], p["text"]))
        pairs = F.concat(pairs, F.when(missing, F.array(F.lit('"url":""'))).otherwise(F.array().cast("array<string>")))
        listed = F.array_join(F.transform(parts, lambda p: p["text"]), ",")
        return F.when(kind == "object", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.concat(F.lit("["), listed, F.lit("]")))

    # an array of one binds the parts, so that they are written once
    return own.otherwise(F.transform(F.array(texts), put_together)[0])


def _opened(level: DataFrame) -> DataFrame:
    """The rows one level below: doc_id, parent, path, pos, key, value, kind, links, verdict."""
    kids = level.sparkSession.sql("SELECT l.doc_id, l.path AS parent, l.kind AS of, l.links AS above, l.verdict AS held, x.pos, x.key, x.value FROM {level} l, LATERAL variant_explode(l.value) x WHERE l.kind <> 'leaf'", level=level)
    kids = kids.withColumns({"kind": _kind(F.col("value")), "key": F.when(F.col("of") == "object", F.col("key")), "path": F.concat_ws(".", "parent", F.col("pos").cast("string"))})
    links, verdict = _roles(F.col("above"), F.col("held"), F.col("key"), F.col("kind"))
    return kids.withColumns({"links": links, "verdict": verdict}).drop("of", "above", "held")


def _by_levels(root: DataFrame) -> DataFrame:
    """(doc_id, report_json) of opened reports, level by level."""
    made: list[DataFrame] = []
    levels = [root.select("doc_id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("key"), "value", "kind", F.lit("0").alias("path"), "links", "verdict")]
    while not (below := cut(_opened(levels[-1]).select(levels[0].columns), made)).isEmpty():
        levels.append(below.where(_stays(F.col("links"), F.col("kind"), F.col("value"))))
    text = None
    for level in reversed(levels):
        rows = level.withColumn("own", _own(F.col("verdict"), F.col("value")))
        if text is None:
            body = rows.withColumn("parts", F.lit(None).cast("array<struct<pos:int,key:string,text:string>>"))
        else:
            parts = text.groupBy("doc_id", F.col("parent").alias("path")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "key", "text"))).alias("parts"))
            body = rows.join(parts, ["doc_id", "path"], "left")
        parts = F.coalesce("parts", F.array().cast("array<struct<pos:int,key:string,text:string>>"))
        missing = (F.col("verdict") == 3) & ~F.exists(parts, lambda p: p["key"] == "url")
        pairs = F.transform(parts, lambda p: _named(p["key"], p["text"]))
        pairs = F.when(missing, F.concat(pairs, F.array(F.lit('"url":""')))).otherwise(pairs)
        joined = F.when(F.col("kind") == "object", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")))
        joined = joined.when(F.col("kind") == "array", F.concat(F.lit("["), F.array_join(F.transform(parts, lambda p: p["text"]), ","), F.lit("]")))
        text = cut(body.select("doc_id", "parent", "pos", "key", joined.otherwise(F.col("own")).alias("text")), made)
    release(*made[:-1])
    return text.select("doc_id", F.col("text").alias("report_json"))


def cleaned_reports(stored: DataFrame) -> DataFrame:
    """(doc_id, report_json, error) of stored reports (doc_id, report_json), one row
    each: links of a list of links stay only if they lead to a web address, and
    findings of a verdict have an empty url unless theirs does. Lists of links
    inside a link, and verdicts inside a verdict, aren't looked into.

    error says not_an_object or categories_not_a_list, without a report; a null
    report or one that can't be read isn't an object."""
    # a report takes far longer than its bytes would tell, so few files are dealt anew
    dealt = stored.select("doc_id", "report_json").repartition("doc_id", "report_json")
    root = dealt.select("doc_id", F.try_parse_json("report_json").alias("value"))
    held = F.try_variant_get("value", "$.categories", "variant")
    error = F.when(F.col("value").isNull() | (_kind(F.col("value")) == "leaf"), "not_an_object").when(held.isNotNull() & ~F.is_variant_null(held) & (_kind(held) != "array"), "categories_not_a_list")
    node = F.struct(F.lit(None).cast("string").alias("key"), F.col("value").alias("value"), _kind(F.col("value")).alias("kind"), F.lit(0).alias("links"), F.lit(0).alias("verdict"))
    written = F.when(F.col("error").isNull(), F.transform(F.array(node), lambda n: _written(n, SHALLOW))[0])
    root = cut(root.withColumn("error", error).select("doc_id", "error", written.alias("report_json"), F.monotonically_increasing_id().alias("row"), "value"))
    shallow = root.where("report_json is null or not contains(report_json, '\x01')").select("doc_id", "report_json", "error")
    deep = root.where("contains(report_json, '\x01')")
    if deep.isEmpty():
        return shallow
    opened = deep.select(F.col("row").alias("doc_id"), "value", _kind(F.col("value")).alias("kind"), F.lit(0).alias("links"), F.lit(0).alias("verdict"))
    own = _by_levels(cut(opened)).withColumnRenamed("doc_id", "row")
    return shallow.unionByName(deep.select("row", "doc_id", "error").join(own, "row").select("doc_id", "report_json", "error"))
