"""Formats of files by content, inventories, and publication lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dims import EXTENSIONS, MEDIA_TYPES
from ..functions.text import strip


def starts_with(content: Column, prefix: bytes) -> Column:
    return F.substring(content, 1, len(prefix)) == F.lit(prefix)


def legacy_format(content: Column) -> Column:
    """doc, xls, ppt, rtf or ole-unknown by content; null for anything else.
    Names of an old container's streams stand near its start in UTF-16."""
    head = F.hex(F.substring(content, 1, 8192))
    names = (("WordDocument", "doc"), ("Workbook", "xls"), ("Book", "xls"), ("PowerPoint Document", "ppt"))
    kind = F.lit("ole-unknown")
    for name, fmt in reversed(names):
        kind = F.when(head.contains(name.encode("utf-16-le").hex().upper()), fmt).otherwise(kind)
    return F.when(starts_with(content, b"{\\rtf"), "rtf").when(starts_with(content, bytes.fromhex("D0CF11E0A1B11AE1")), kind)


def is_pdf(content: Column) -> Column:
    return starts_with(content, b"%PDF-")


def is_zip(content: Column) -> Column:
    return starts_with(content, b"PK\x03\x04")


def supported(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(r"\.(" + "|".join(EXTENSIONS) + ")$"), F.lit(False))


def accepted(name: Column, media_type: Column, enabled: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether an upload passes the first test: the media type or the extension
    of a format that is enabled."""
    out = F.lit(False)
    for fmt in enabled:
        out = out | F.coalesce(F.lower(media_type) == MEDIA_TYPES[fmt], F.lit(False)) | F.coalesce(F.lower(name).endswith("." + fmt), F.lit(False))
    return out


def unsupported_format(name: Column) -> Column:
    """doc, xls, ppt, rtf or csv by the last extension; null otherwise."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(ext == "tsv", "csv").when(ext.isin("doc", "xls", "ppt", "rtf", "csv"), ext)


def inventory(lines: DataFrame, category: str | None = None, most: int | None = 100) -> DataFrame:
    """Entries of newline-delimited JSON inventories (file, line_no, value): a
    header names the base that entries without an URL are found under, bad and
    blank lines are skipped, and each file gives its first ``most`` entries."""
    schema = "kind string, path string, filename string, category string, publicUrl string, sha256 string, metadata struct<publicUrlBase:string>"
    rows = lines.withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    w = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("base", F.last("j.metadata.publicUrlBase", ignorenulls=True).over(w))
    rows = rows.where(F.col("j").isNotNull() & F.coalesce(F.col("j.kind"), F.lit("entry")).isin("entry") & F.col("j.path").isNotNull())
    if category:
        rows = rows.where(F.col("j.category") == category)
    joined = F.concat(F.regexp_replace("base", "/+$", ""), F.lit("/"), F.regexp_replace(F.col("j.path"), "^/+", ""))
    out = rows.select("file", "line_no", "j.path", "j.filename", "j.category", F.coalesce("j.publicUrl", joined).alias("url"), "j.sha256")
    if most is not None:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("line_no"))).where(F.col("_n") <= most).drop("_n")
    return out


_PUBLICATIONS = "array<struct<id:string,title:string,slug:string,fileURL:string,publicationDate:string,pubType:string,summary:string,tags:array<string>>>"


def publication_file(spark: SparkSession, path: str, page_size: int | None = None) -> DataFrame:
    """Publications of JSON files: a list, or one under ``publications`` or
    ``data.publications``. A folder holds the pages of a paged source by name; with
    ``page_size`` the first page that is shorter is the last, and of rows with one id
    the last stays; a plain file keeps its rows. Then only files that can be audited
    count."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("page"))
    j = lambda schema: F.from_json("value", schema)
    found = F.coalesce(F.when(F.ltrim(strip(F.col("value"))).startswith("["), j(_PUBLICATIONS)), j(f"publications {_PUBLICATIONS}")["publications"], j(f"data struct<publications:{_PUBLICATIONS}>")["data"]["publications"])
    pages = text.select("page", found.alias("found"))
    if page_size is not None:
        short = pages.where(F.coalesce(F.size("found"), F.lit(0)) < page_size).agg(F.min("page").alias("last"))  # one row
        pages = pages.join(F.broadcast(short)).where(F.col("last").isNull() | (F.col("page") <= F.col("last"))).drop("last")
    rows = pages.select("page", F.posexplode("found").alias("pos", "p")).select("page", "pos", "p.*")
    if page_size is None:
        return rows.where(supported(F.col("fileURL"))).select("id", *(c for c in rows.columns if c not in ("id", "page", "pos")))
    kept = [c for c in rows.columns if c not in ("id", "page", "pos")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*kept), F.struct("page", "pos")).alias("r")).select("id", "r.*").where(supported(F.col("fileURL")))
