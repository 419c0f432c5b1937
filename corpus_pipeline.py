"""A corpus pipeline of five operators: each stage reads what the one before
it wrote, and its decisions take effect in the rows that it returns.

1. toxicity: documents scored 0.7 or more go (fitted on labels outside the held-out fold).
2. line dedup: lines that an equal or nearly equal earlier line makes redundant go;
   a document goes if it had text and none is left.
3. n-gram join: one document, the smallest doc_id, of each near-duplicate group stays.
4. decontamination: documents that contain a benchmark item go.
5. source mix: what the target weights take stays, with its number of copies.

Defined results: rows with a null doc_id can be rejected by stages 1, 4 and 5
only; a null or empty text is scored like any other, has no lines, links and
items, and size 0 (it stays where all documents of its source are taken); rows
that repeat a doc_id go through every stage, judged by their own text in stages
1 and 4 and as one document in the others; empty tables give an empty result;
further columns of the documents pass through, but for ``copies``, which the last
stage sets; texts are whole in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscope.llm import free_name, release, stash
from quillscope.llm.decontaminate import drop_contaminated
from quillscope.llm.line_dedup import dedup_lines
from quillscope.llm.ngram_join import keep_one_of_each
from quillscope.llm.source_mix import take_mix
from quillscope.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs.columns, "_toxicity")
    return score_toxicity(docs, model, score).where(F.col(score) < 0.7).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("source_mix", source_mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
        release(*written)
        written = [docs]
    return docs
