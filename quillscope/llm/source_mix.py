"""Operator 8, mixing sources to target weights: hash-threshold histograms.

Tokens are summed by source and hash bucket, the bucket in which a source's
budget ends is found with a running sum, and only that bucket is split by the
next bits of the hash, level by level, until it holds one hash value. A document
is then taken by comparing its hash with its source's threshold: no sort over
documents, and thresholds of growing budgets are nested. Sources are ranked in
ranges, and their common level is found by a few sums, so there may be many.

Defined results: a null text has size 0, and a document of size 0 is taken no
oftener than all of its source are; null sources form one source, last in order;
a null doc_id hashes as the empty string; repeated rows and documents of one
doc_id are taken or left together; an empty table gives an empty result; texts
of any length are counted in one pass. Other columns pass through, but for one
that has the name of the column of copies, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import free_name, release, stash

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 10, 6


def hash60(col: Column) -> Column:
    """60 bits of the md5 of a column's text: the same on every run and engine."""
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Targets of a table (skey, source_size) of one row per source.

    With sources in order, the weights repeat; targets share the sum of all
    sizes by weight, none above ``cap`` times its source's size. In order of
    size per weight, the capped sources are a prefix: a level of the sum over the
    weights caps those below it, which raises the level, until no more are.
    """
    ranged = stash(sizes.repartitionByRange("skey").withColumn("part", F.spark_partition_id()))
    ahead = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    ahead = ahead.select("part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("ahead"))  # a row per partition
    place = F.row_number().over(Window.partitionBy("part").orderBy("skey")) + F.col("ahead")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = stash(ranged.join(ahead, "part").select("skey", "source_size", weight.alias("weight")))
    release(ranged)
    limit = cap * F.col("source_size")
    every = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level, used, gone = 0.0, 0, 0
    while every["weight"] and every["weight"] > gone:
        level = (every["size"] - cap * used) / (every["weight"] - gone)
        over = ranked.where(limit / F.col("weight") < F.lit(level)).agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
        if (over["weight"] or 0) == gone:
            break
        used, gone = over["size"], over["weight"]
    share = F.lit(level) * F.col("weight")
    return ranked.select("skey", "source_size", "weight", F.when(share > limit, limit).otherwise(share).alias("target"))


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, skey, size, h) of each document, written out: all that follows reads no texts."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stash(docs.select("doc_id", _source_key().alias("skey"), size.alias("size"), hash60(F.col("doc_id")).alias("h")))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per source: skey, source_size, target, whole (copies of every
    document) and below (hashes under it get one copy more)."""
    part = lambda level: F.shiftright("h", BITS * (LEVELS - 1 - level)).bitwiseAND((1 << BITS) - 1)
    counted = lambda rows, level: rows.groupBy("skey", part(level).alias("bucket")).agg(F.sum("size").alias("tokens"), F.min("h").alias("low"), F.max("h").alias("high"))
    histogram = stash(counted(sized, 0))
    targets = source_targets(histogram.groupBy("skey").agg(F.sum("tokens").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # below: every hash under it is taken; base: the tokens of those; split: whether the bucket that starts there is to be split
    edge = stash(goals.withColumns({"below": F.lit(0).cast("long"), "base": F.lit(0).cast("long"), "split": F.lit(True)}))
    running = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(LEVELS):
        width = BITS * (LEVELS - 1 - level)
        if level:
            todo = edge.where("split").select("skey", "below")
            if todo.isEmpty():
                break
            histogram = counted(sized.join(todo, "skey").where(F.shiftright("h", width + BITS) == F.shiftright("below", width + BITS)), level)
        summed = histogram.withColumn("upto", F.sum("tokens").over(running)).join(edge.select("skey", "rest", "base"), "skey")
        # a bucket of one hash is taken if that brings the sum nearer
        one = F.col("low") == F.col("high")
        done = F.col("base") + F.col("upto") - F.when(one, F.col("tokens") / 2).otherwise(F.lit(0)) <= F.col("rest")
        open_ = F.struct("bucket", (~one).alias("more"))
        taken = summed.withColumn("done", done).groupBy("skey").agg(F.min(F.when(~F.col("done"), open_)).alias("open"), F.max(F.when(F.col("done"), F.col("upto"))).alias("upto"))
        seen = F.col("open").isNotNull() | F.col("upto").isNotNull()
        step = F.when(seen, F.coalesce(F.col("open.bucket"), F.lit(1 << BITS)) * (1 << width)).otherwise(0).cast("long")
        old, edge = edge, stash(edge.join(taken, "skey", "left").select(*goals.columns, (F.col("below") + step).alias("below"), (F.col("base") + F.coalesce(F.col("upto"), F.lit(0))).alias("base"), F.coalesce("open.more", F.lit(False)).alias("split")))
        release(old)
    return edge.select("skey", "source_size", "target", "whole", "below")


def _copies(some: Column, h: Column, whole: Column, below: Column) -> Column:
    """Copies of a document; ``some``: it has words."""
    return whole + (some & (h < below)).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sized = sizes(docs)
    out = sized.join(thresholds(sized, weights, cap), "skey")
    copies = _copies(F.col("size") > 0, F.col("h"), F.col("whole"), F.col("below"))
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, copies: str = "copies") -> DataFrame:
    """The rows of ``docs`` that the mix takes, with how often it takes them.
    The thresholds, a row per source, meet the texts where they are read."""
    docs = docs.drop(copies)
    source, edge, n = (free_name(docs.columns, x) for x in ("_mix_source", "_mix_edge", copies))
    edges = thresholds(sizes(docs), weights, cap).select(F.col("skey").alias(source), F.struct("whole", "below").alias(edge))
    some = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    out = docs.withColumn(source, _source_key()).join(edges, source)
    return out.withColumn(n, _copies(some, hash60(F.col("doc_id")), F.col(edge).whole, F.col(edge).below)).where(F.col(n) > 0).select(*docs.columns, n)
