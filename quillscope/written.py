"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it names none, a temporary
    folder is set, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillscope-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """``df`` written and read again: its lineage ends here, and what a lost
    executor held is read once more. Removed when the driver ends, or by
    ``release``; ``made`` takes note of it. Its shuffle files, which nothing reads
    any more, are dropped."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _WRITTEN.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    if made is not None:
        made.append(back)
    return back


def release(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._written_at)


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
