"""Operator 5, token counts: delta-maintained rollups.

A change to the corpus is a signed row: an insert counts a document's tokens
once up, a delete once down, a revised count is both. A batch of changes is
summed by source, language and tokenizer version and written as a new attempt
in that batch's own folder; the last attempt that was written whole counts, so
committing a batch again replaces it, counts nothing twice, and takes nothing
away while it is being written. Totals are the sum over committed batches.
Compaction folds the batches of one listing into a base, together with the list
of batches that it holds, which stays a table; folders that an earlier
compaction has folded in are deleted with all their attempts, so listings stay as
short as the time between compactions. One writer at a time; readers may run
beside it, since what a reader has planned to read stays until the compaction
after the next.

Defined results: a null text has 0 tokens; null sources and languages are
groups of their own; groups whose documents and tokens are back at 0 vanish;
rows that repeat count each; a null doc_id counts like any other; a table
without rows gives no group; only doc_id, source, lang and text are read, so
further columns don't matter. Texts are counted whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import batch

KEYS = ("source", "lang", "tokenizer")
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


def _encoder(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, version: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) of whole texts. ``vocabulary``
    is a file of ranks that every executor can read (tokenizers are installed
    with the environment); ``pattern`` splits text before merging."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("tokenizer", pa.string()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or _encoder(vocabulary, pattern)
            counts = [len(encoder.encode_ordinary(t)) if t else 0 for t in (x.as_py() for x in b.column("text"))]
            yield batch(schema, b.column("doc_id").cast(pa.int64()), b.column("source"), b.column("lang"), [version] * b.num_rows, counts)

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def count_words(docs: DataFrame, version: str = "words", text: Column | None = None) -> DataFrame:
    """The same columns, with words ``[^\\x20\\x09-\\x0D]+`` for tokens; ``text``
    is what to count, the text itself unless given."""
    tokens = F.regexp_count(F.col("text") if text is None else text, F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Changes that insert (1) or delete (-1) counted documents."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.col("tokens") * sign).cast("long").alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that replace counts by others, of any source, language or version."""
    return signed(before, -1).unionAll(signed(after, 1))


class TokenRollup:
    """Additive totals under ``path``, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, *names: str):
        """(file system, path) of a folder below."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, *names: str, complete: bool = True) -> list[str]:
        """Folders below; of complete ones only: Spark marks what a job has written whole."""
        fs, top = self._fs(*names)
        found = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(n for n in found if not complete or fs.exists(self._fs(*names, n, "_SUCCESS")[1]))

    def _delete(self, *names: str) -> None:
        fs, path = self._fs(*names)
        fs.delete(path, True)

    def _base(self) -> str | None:
        return next(reversed(self._names("held")), None)

    def _held(self, base: str | None, names: list[str]) -> set[str]:
        """Which of these batches the base holds."""
        if not base or not names:
            return set()
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/held/{base}")
        return {r["batch"] for r in held.join(F.broadcast(self.spark.createDataFrame([(n,) for n in names], "batch string")), "batch").collect()}

    def _open(self, base: str | None) -> dict[str, str]:
        """Batches that the base doesn't hold, with their last complete attempt."""
        names = self._names("deltas", complete=False)
        attempts = {n: self._names("deltas", n) for n in names}
        held = self._held(base, names)
        return {n: a[-1] for n, a in attempts.items() if a and n not in held}

    def commit(self, name: str, changes: DataFrame) -> None:
        """Commit the batch ``name``; the same name replaces what it counted.
        A batch that compaction has folded in is final and is left as it is."""
        name = quote(name, safe="")
        if self._held(self._base(), [name]):
            return
        before = self._names("deltas", name, complete=False)
        delta = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        delta.write.parquet(f"{self.path}/deltas/{name}/{int(before[-1]) + 1 if before else 1:09d}")

    def _sum(self, base: str | None, batches: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/deltas/{n}/{a}" for n, a in batches.items()]
        if base:
            paths.append(f"{self.path}/base/{base}")
        if not paths:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens)."""
        base = self._base()
        return self._sum(base, self._open(base))

    def compact(self) -> None:
        """Fold the committed batches of one listing into a new base; its list
        of batches is written last, and a base without that list is never read."""
        base = self._base()
        batches = self._open(base)
        for done in set(self._names("deltas", complete=False)) - set(batches):  # folded in before
            if self._held(base, [done]):
                self._delete("deltas", done)
        version = f"{int(base or 0) + 1:09d}"
        self._sum(base, batches).write.mode("overwrite").parquet(f"{self.path}/base/{version}")
        held = self.spark.createDataFrame([(n,) for n in batches], "batch string")
        if base:
            held = held.unionAll(self.spark.read.schema("batch string").parquet(f"{self.path}/held/{base}"))
        held.write.mode("overwrite").parquet(f"{self.path}/held/{version}")
        for old in self._names("base", complete=False):
            if base and old < base:
                self._delete("base", old)
                self._delete("held", old)

    def drop(self) -> None:
        """Delete all totals and batches."""
        self._delete()
