"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL = 256 << 10
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where the session
    names none (tests, local mode), a new temporary folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stash(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and
    a lost executor costs only a reread. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillscope-{uuid.uuid4().hex}"
    out = df if partitions is None else df.coalesce(partitions)
    # what is written needs its shuffle files no longer; else they fill the
    # executors' disks until the whole query ends
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        out.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _WRITTEN.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._stashed_at = path
    return back


@contextmanager
def unsized(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark broadcasts what a hint names, and tables that it takes to have
    ``SMALL`` bytes at most: files of copies are far smaller than their rows, and
    estimates don't see what an explode makes."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    most = min(SMALL, spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    for n in names:
        spark.conf.set(n, str(most))
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def among(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` of which the id may be among ``ids``: a bitmap of 2**24 hashed
    ids, two megabytes whatever their number, is broadcast, so that only texts
    that are asked for are shuffled. What it lets through too much, joins drop."""
    spot = lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 24)) + 1
    mine, name = spot(ids.columns[0]), free_name(rows.columns, "_bucket")
    bits = ids.groupBy(F.bitmap_bucket_number(mine).alias(name)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(mine)).alias(name + "_bits"))
    at = F.bitmap_bit_position(spot(key))
    byte = F.conv(F.hex(F.substr(name + "_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn(name, F.bitmap_bucket_number(spot(key))).join(F.broadcast(bits), name)
    return marked.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(rows.columns)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as no column has."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def release(*tables: DataFrame) -> None:
    """Delete tables that ``stash`` wrote and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._stashed_at)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if (spark, path) in _WRITTEN:
        _WRITTEN.remove((spark, path))


@atexit.register
def _remove() -> None:
    for spark, path in list(_WRITTEN):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            continue
