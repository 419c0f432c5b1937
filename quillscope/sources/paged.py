"""A paged listing of publications as a data source, for tables and streams.

``url`` names a page, with {start} and {limit} in it. As a table, ``partitions``
readers each take every so-many-th page, until one is shorter than ``page_size``:
no page is read on the driver and no total has to be known. As a stream, each
trigger takes up to ``pages_per_batch`` pages from the last offset on (a stream of
this kind passes through the driver); an offset counts rows, and a range of
offsets is read again as it was."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.error import HTTPError, URLError
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from .files import supported

SCHEMA = "place long, id string, title string, slug string, fileURL string, publicationDate string, pubType string, summary string, tags array<string>"
_FIELDS = ("id", "title", "slug", "fileURL", "publicationDate", "pubType", "summary", "tags")


def _page(options: dict, start: int) -> list[tuple]:
    """Rows of the page that starts there; none behind the last page."""
    limit = int(options.get("page_size", 100))
    try:
        with urlopen(options["url"].format(start=start, limit=limit), timeout=30) as response:
            body = json.loads(response.read())
    except HTTPError as error:
        if error.code == 404:
            return []
        raise
    except URLError as error:  # a page of a folder that isn't there
        if options["url"].startswith("file:"):
            return []
        raise error
    if isinstance(body, dict) and body.get("errors"):
        raise ValueError(f"the listing reports an error: {body['errors'][0].get('message')}")
    found = body if isinstance(body, list) else (body.get("data") or body).get("publications") or []
    text = lambda x: None if x is None else str(x)
    return [(start + i, *(text(p.get(f)) for f in _FIELDS[:-1]), p.get("tags")) for i, p in enumerate(found)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("partitions", 8)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        size, step = int(self.options.get("page_size", 100)), int(self.options.get("partitions", 8))
        page = partition.value
        while True:
            rows = _page(self.options, page * size)
            yield from rows
            if len(rows) < size:
                return
            page += step


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def _rows(self, start: int, stop: int) -> Iterator[tuple]:
        size = int(self.options.get("page_size", 100))
        at = start // size * size
        while at < stop:
            rows = _page(self.options, at)
            yield from (r for r in rows if start <= r[0] < stop)
            if len(rows) < size:
                return
            at += size

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        most = int(self.options.get("page_size", 100)) * int(self.options.get("pages_per_batch", 10))
        rows = list(self._rows(start["rows"], start["rows"] + most))
        return iter(rows), {"rows": rows[-1][0] + 1 if rows else start["rows"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return self._rows(start["rows"], end["rows"])


class PublicationListing(DataSource):
    """``spark.read.format("publication_listing")`` and ``readStream`` alike."""

    @classmethod
    def name(cls) -> str:
        return "publication_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(dict(self.options))


def listing(spark: SparkSession, url: str, page_size: int = 100, partitions: int = 8) -> DataFrame:
    """Publications of a paged listing: of rows with one id the last counts, and of
    those the ones whose file can be audited."""
    spark.dataSource.register(PublicationListing)
    rows = spark.read.format("publication_listing").options(url=url, page_size=page_size, partitions=partitions).load()
    kept = [c for c in rows.columns if c not in ("id", "place")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*kept), "place").alias("r")).select("id", "r.*").where(supported(F.col("fileURL")))


def listing_stream(spark: SparkSession, url: str, page_size: int = 100) -> DataFrame:
    """New rows of a paged listing as a stream, as they are listed."""
    spark.dataSource.register(PublicationListing)
    return spark.readStream.format("publication_listing").options(url=url, page_size=page_size).load()
