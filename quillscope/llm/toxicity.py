"""Operator 3, toxicity: a linear classifier on character n-grams that are
scaled by naive Bayes log-count ratios.

N-grams of Unicode characters of the lower-cased text are hashed to a fixed
number of buckets. On the training rows, log-count ratios of the two classes
give each bucket its scale; the buckets whose ratio differs from none by the
most standard errors are kept, and an L2-penalised logistic regression is fitted
on the scaled presence of those. Scores read whole texts and nothing but texts,
a quarter of a megabyte at a time: a longer text is cut into pieces that overlap
by the longest n-gram, and its features are the union over its pieces.

Fitting uses the ``max_rows`` labelled training rows of smallest hash (a
documented bound; of each, the driver gets at most ``features`` indices of two
bytes, 131 MB at the defaults if every text held every feature). Defined
results: a null or empty text scores as a text without any feature; rows with a
null doc_id or label are not learnt from; of documents that repeat a doc_id the
least text is learnt from, and where labels of one doc_id disagree, label 1
wins; without training rows of both classes every score is the training rate (0
without rows); an empty table gives an empty table; a column that has the
score's name is replaced by the score, all other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._store import release, stash
from ._text import batch, text_slices

BUCKETS = 1 << 20
SIZES = (4, 5, 6)
TOTAL = len(SIZES) * BUCKETS
MAX_ROWS, FEATURES = 16_000, 4096
SLICE = 256 << 10
_LOWER = np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32)


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, lower-cased code point) of each character of UTF-8 bytes."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[start].astype(np.uint32)
    if len(start) < len(data):
        size = np.diff(np.append(start, len(data)))
        code &= np.array([0, 0x7F, 0x1F, 0x0F, 0x07], np.uint32)[np.minimum(size, 4)]
        for j in (1, 2, 3):
            more = np.flatnonzero(size > j)
            code[more] = code[more] << 6 | data[start[more] + j] & 63
    small = code < len(_LOWER)
    code[small] = _LOWER[code[small]]
    return start, code


def _grams(code: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each size n, (n, bucket of the n characters that start at each position)."""
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(SIZES) + 1):
        h = h[: max(0, len(code) - n + 1)] * np.uint32(0x9E3779B1) + code[n - 1 :]
        if n in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE3D)
            yield n, (mixed >> np.uint32(33 - BUCKETS.bit_length())).astype(np.int64) + SIZES.index(n) * BUCKETS


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A slice as it is, or a long text's overlapping pieces."""
    if len(data) <= 2 * SLICE:
        yield data, offsets
        return
    overlap = 4 * max(SIZES) + 4
    for a in range(0, len(data), SLICE):
        piece = data[a : a + SLICE + overlap]
        first = np.flatnonzero((piece & 0xC0) != 0x80)  # where characters start
        if a + len(piece) < len(data) and len(first):
            piece = piece[: first[-1]]  # the last may be cut
        piece = piece[first[0] if len(first) else 0 :]
        yield piece, np.array([0, len(piece)])


def _present(texts: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row within, feature) of slices: the distinct feature
    buckets of each text, in order; only those in ``wanted``."""
    for base, data, offsets in text_slices(texts, SLICE):
        keys = [np.zeros(0, np.int64)]
        for part, cuts in _pieces(data, offsets):
            start, code = _characters(part)
            row = np.repeat(np.arange(len(cuts) - 1), np.diff(np.searchsorted(start, cuts)))
            for n, bucket in _grams(code):
                use = row[: len(bucket)] == row[n - 1 :]
                if wanted is not None:
                    use &= wanted[bucket]
                at = np.flatnonzero(use)
                keys.append(np.unique(row[at] * TOTAL + bucket[at]))
        found = np.unique(np.concatenate(keys))
        yield base, len(offsets) - 1, found // TOTAL, found % TOTAL


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # bucket ids, sorted
    weights: np.ndarray  # regression weight times log-count ratio
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(TOTAL)
        out[self.features] = self.weights
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, TOTAL), np.int32)
    for b in batches:
        label = b.column("label").to_numpy(zero_copy_only=False)
        for base, _, row, feature in _present(b.column("text")):
            np.add.at(counts, (label[base + row], feature), 1)
    used = np.flatnonzero(counts.any(0))
    schema = pa.schema([("feature", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64())])
    for a in range(0, len(used), 100_000):
        part = used[a : a + 100_000]
        yield batch(schema, part.astype(np.int32), counts[0, part], counts[1, part])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _row_blocks(rows: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, row within, feature) of stretches of rows of about ``most`` entries."""
    a = held = 0
    for i, r in enumerate(rows):
        held += len(r) // 2
        if held >= most or i == len(rows) - 1:
            part = rows[a : i + 1]
            yield a, i + 1, np.repeat(np.arange(len(part), dtype=np.int32), [len(x) // 2 for x in part]), np.frombuffer(b"".join(part), np.uint16)
            a, held = i + 1, 0


def _fit_logistic(rows: list[bytes], scale: np.ndarray, y: np.ndarray, l2: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Adam on the full penalised log loss of sparse presence times scale; a
    row is its features as two-byte numbers."""
    w, b = np.zeros(len(scale)), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gb, ws = np.zeros(len(scale)), 0.0, w * scale
        for a, e, of, index in _row_blocks(rows):
            error = sigmoid(np.bincount(of, ws[index], e - a) + b) - y[a:e]
            g += np.bincount(index, error[of], len(scale))
            gb += error.sum()
        g, gb = g * scale / len(rows) + l2 * w, gb / len(rows)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * (1 - t / (steps + 1))
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, label, text) of labelled documents outside the held-out fold:
    the ``max_rows`` of smallest hash, a bounded table that can be broadcast;
    documents that repeat a doc_id count once."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold != 1))
    known = known.groupBy("doc_id").agg(F.max((F.col(label) == 1).cast("int")).alias("label"))
    bounded = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, features: int = FEATURES, l2: float = 1e-4) -> ToxicityModel:
    if features > 1 << 16:
        raise ValueError("features are numbered in two bytes")
    rows = stash(training_rows(docs, labels, "toxic", max_rows))
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        rate = n1 / max(1, n0 + n1)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 60.0 if rate == 1 else -60.0)
    counts = rows.select("label", "text").mapInArrow(_count, "feature int, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p1, p0 = (F.col("n1") + 1) / (n1 + 2), (F.col("n0") + 1) / (n0 + 2)
    ratio = F.log(p1 / p0)
    error = F.sqrt((1 - p1) / (F.col("n1") + 1) + (1 - p0) / (F.col("n0") + 1))
    best = counts.where(F.col("n0") + F.col("n1") >= 4).select("feature", ratio.alias("ratio"), F.abs(ratio / error).alias("z")).orderBy(F.desc("z"), "feature").limit(features).toPandas().sort_values("feature")
    kept, scale = best["feature"].to_numpy().astype(np.int64), best["ratio"].to_numpy()
    wanted = np.zeros(TOTAL, bool)
    wanted[kept] = True

    def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("found", pa.binary())])
        for b in batches:
            for base, n, row, feature in _present(b.column("text"), wanted):
                place = np.searchsorted(kept, feature).astype(np.uint16)
                found = np.split(place, np.searchsorted(row, np.arange(1, n)))
                yield batch(schema, b.column("doc_id").slice(base, n).cast(pa.int64()), b.column("label").slice(base, n).cast(pa.int32()), pa.array([f.tobytes() for f in found], pa.binary()))

    table = rows.mapInArrow(indices, "doc_id long, label int, found binary").toPandas().sort_values("doc_id", kind="stable")
    release(rows)
    w, b = _fit_logistic(list(table["found"]), scale, table["label"].to_numpy().astype(float), l2)
    return ToxicityModel(kept, w * scale, b)


def score_toxicity(docs: DataFrame, model: ToxicityModel, score: str = "toxicity_score") -> DataFrame:
    """``docs`` with a column ``score``, a probability from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights
    docs = docs.drop(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.table()
        wanted = weights != 0
        for b in batches:
            total = np.zeros(b.num_rows)
            for base, n, row, feature in _present(b.column("text"), wanted):
                total[base : base + n] = np.bincount(row, weights[feature], n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sigmoid(total + model.bias))], names=[*b.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))
