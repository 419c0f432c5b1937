"""The cache of audited publications as the sink of a stream of results.

Each micro-batch is a partition of its own, named by its id and written with
dynamic partition overwrite: a batch that is run again after a crash replaces
what it left behind, whole or in part, so it counts once. Readers take the last
row of each URL by batch and time; compaction puts batches together in a folder
that counts only when it is complete, and readers that began before it still find
what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

_ROW = "url string, status string, error_message string, audited_at timestamp"


def cache_rows(results: DataFrame) -> DataFrame:
    """Results (url, error_message, permanent, audited_at) as rows of the cache."""
    failed = F.col("error_message").isNotNull()
    status = F.when(~failed, "success").when(F.coalesce("permanent", F.lit(False)), "permanent_error").otherwise("error")
    return results.select("url", status.alias("status"), "error_message", "audited_at")


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    last = cache_rows(batch).groupBy("url").agg(F.max_by(F.struct("status", "error_message", "audited_at"), F.struct("audited_at", "status")).alias("r")).select("url", "r.*")
    rows = last.withColumn("batch", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/batches")


def cache_upserts(results: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream's results into the cache at ``path``; start it with a trigger."""
    return results.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: write_batch(batch, batch_id, path))


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete folders name=number below a path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    found = [s.getPath() for s in system.listStatus(target)]
    whole = [p for p in found if p.getName().startswith(f"{name}=") and (name == "batch" or system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def current_cache(spark: SparkSession, path: str) -> DataFrame:
    """(url, status, error_message, audited_at): the last result of each URL."""
    bases, batches = _folders(spark, f"{path}/compacted", "upto"), _folders(spark, f"{path}/batches", "batch")
    base = bases[-1] if bases else -1
    rows = spark.createDataFrame([], f"{_ROW}, batch long")
    if bases:
        rows = rows.unionByName(spark.read.schema(_ROW).parquet(f"{path}/compacted/upto={base}").withColumn("batch", F.lit(base).cast("long")))
    later = [f"{path}/batches/batch={n}" for n in batches if n > base]
    if later:
        rows = rows.unionByName(spark.read.schema(f"{_ROW}, batch long").option("basePath", f"{path}/batches").parquet(*later))
    last = F.max_by(F.struct("status", "error_message", "audited_at"), F.struct("batch", "audited_at"))
    return rows.groupBy("url").agg(last.alias("r")).select("url", "r.*")


def compact_cache(spark: SparkSession, path: str) -> int | None:
    """Put all batches together; returns the last one that is in it. Its folder
    is written anew if an earlier attempt left it incomplete."""
    batches = _folders(spark, f"{path}/batches", "batch")
    bases = _folders(spark, f"{path}/compacted", "upto")
    if not batches or (bases and bases[-1] >= batches[-1]):
        return bases[-1] if bases else None
    current_cache(spark, path).write.mode("overwrite").parquet(f"{path}/compacted/upto={batches[-1]}")
    return batches[-1]
