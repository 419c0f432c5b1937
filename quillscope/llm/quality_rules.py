"""Operator 6, quality classifier: a sparse rule ensemble.

Statistics of whole texts feed small boosted trees on a bounded sample of
labelled training rows (``max_rows``, those of smallest hash). Every path from a
root is a conjunctive rule; a lasso logistic regression weighs the rules and
drops most; what is left is compiled into one Spark column expression.

Defined results: a null or empty text has all statistics 0; rows with a null
doc_id or label are not learnt from, documents that repeat a doc_id are learnt
from once, and where labels of one doc_id disagree label 1 wins; without
training rows of both classes the score is their rate (1/2 without rows); an
empty table gives an empty table; a column that has the score's name is replaced
by the score, all others pass through. A text is held whole in memory, some 100
bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._text import distinct, mix, text_slices, words
from .toxicity import sigmoid, training_rows

MAX_ROWS = 16_000
_KINDS = ("other", "lower", "upper", "digit", "punctuation", "blank", "newline", "high")
_KIND = np.zeros(256, np.int64)
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[9, 11, 12, 13, 32]], _KIND[10], _KIND[128:] = 5, 6, 7
STATS = ("words", "lines", "word_bytes", "longest_word", "short_words", "distinct_words", "top_word", "words_per_line", "distinct_lines", "ends_in_mark", "without_letter", "marks_per_word", *(f"share_{k}" for k in _KINDS[1:]))


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    w = words(data, offsets)
    n, doc = w.counts, w.doc
    size, some = np.maximum(np.diff(offsets), 1), np.maximum(n, 1)
    kind = _KIND[data]
    kinds = np.bincount(np.repeat(np.arange(rows), np.diff(offsets)) * 8 + kind, minlength=rows * 8).reshape(rows, 8)
    length = w.ends - w.starts
    per_doc = lambda x: np.bincount(doc, x, rows) / some
    longest = np.zeros(rows)
    np.maximum.at(longest, doc, length)
    order = np.lexsort((w.hashes, doc))
    d, h = doc[order], w.hashes[order]
    head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]) if len(d) else np.zeros(0, np.int64)
    times = np.diff(np.r_[head, len(d)])
    top = np.zeros(rows)
    np.maximum.at(top, d[head], times)
    kinds_of_word = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(np.stack([(kind == 1) | (kind == 2) | (kind == 7), kind == 4], 1), axis=0)])
    inside = kinds_of_word[w.ends] - kinds_of_word[w.starts]
    last = kind[w.ends - 1] == 4 if len(doc) else np.zeros(0, bool)
    # a line is known by the sum of its words' hashes by place
    line = np.cumsum(kind == 6)[w.starts] if len(doc) else np.zeros(0, np.int64)
    start = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        place = (np.arange(len(doc)) - np.repeat(start, np.diff(np.r_[start, len(doc)]))).astype(np.uint64)
        sums = np.add.reduceat(mix(w.hashes + mix(place)), start) if len(doc) else np.zeros(0, np.uint64)
    lines = np.bincount(doc[start], minlength=rows)
    own, _ = distinct(doc[start], sums)
    full = np.maximum(lines, 1)
    out = [n, lines, per_doc(length), longest, per_doc(length <= 3), np.bincount(d[head], minlength=rows) / some, top / some, n / full, np.bincount(own, minlength=rows) / full, per_doc(last), per_doc(inside[:, 0] == 0), per_doc(inside[:, 1])]
    return np.stack([*out, *(kinds[:, k] / size for k in range(1, 8))]).astype(float)


def text_statistics(docs: DataFrame, prefix: str = "stat_") -> DataFrame:
    """``docs`` with a double column per entry of ``STATS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [_statistics(data, offsets) for _, data, offsets in text_slices(b.column("text"))]
            if parts:
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, np.concatenate(parts, axis=1))], names=[*b.schema.names, *(prefix + s for s in STATS)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(prefix + s, DoubleType()) for s in STATS)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, whether above, bound), all of which hold


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self, prefix: str = "stat_") -> Column:
        """The score as one column expression."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = None
            for stat, above, bound in rule:
                x = F.col(prefix + STATS[stat])
                test = x > bound if above else x <= bound
                holds = test if holds is None else holds & test
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), total))))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for stat, above, bound in rule:
        out &= x[:, stat] > bound if above else x[:, stat] <= bound
    return out


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, curve: np.ndarray, rows: np.ndarray, stats: np.ndarray, path: Rule, depth: int, found: list[tuple[Rule, float]]) -> None:
    """Splits one node by the best cut; each node's path is a rule."""
    if path:
        found.append((path, float(-gradient[rows].sum() / (curve[rows].sum() + 1))))
    if not depth or len(rows) < 20:
        return
    total, weight = gradient[rows].sum(), curve[rows].sum()
    best = None
    for s in stats:
        g = np.cumsum(np.bincount(bins[rows, s], gradient[rows], len(cuts[s]) + 1))[:-1]
        c = np.cumsum(np.bincount(bins[rows, s], curve[rows], len(cuts[s]) + 1))[:-1]
        m = np.cumsum(np.bincount(bins[rows, s], minlength=len(cuts[s]) + 1))[:-1]
        gain = np.where((m >= 5) & (len(rows) - m >= 5), g**2 / (c + 1) + (total - g) ** 2 / (weight - c + 1), -1)
        if len(gain) and (best is None or gain.max() > best[0]):
            best = float(gain.max()), int(s), float(cuts[s][gain.argmax()])
    if best is None or best[0] <= total**2 / (weight + 1) + 1e-6:
        return
    _, s, cut = best
    low = x[rows, s] <= cut
    for side, above in ((rows[low], False), (rows[~low], True)):
        _grow(x, bins, cuts, gradient, curve, side, stats, (*path, (s, above, cut)), depth - 1, found)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on the logistic loss plus an L1 penalty."""
    size = 4 / max(1e-9, np.linalg.norm(z, 2) ** 2 / len(z) + 1)
    w, v, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0
    b = c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(steps):
        error = (sigmoid(z @ v + c) - y) / len(y)
        new = v - size * (z.T @ error)
        new = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0)
        nb = c - size * error.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, seed: int = 5) -> RuleModel:
    """Rules and weights for labels ``y`` of statistics ``x``."""
    if not len(y) or y.min() == y.max():
        return RuleModel((), (), float(60 * (2 * y[0] - 1)) if len(y) else 0.0)
    draw = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, 33)[1:-1])) for s in range(x.shape[1])]
    bins = np.stack([np.searchsorted(cuts[s], x[:, s], side="left") for s in range(x.shape[1])], 1)
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = sigmoid(margin)
        found: list[tuple[Rule, float]] = []
        rows = np.flatnonzero(draw.random(len(y)) < 0.5)
        stats = np.sort(draw.permutation(x.shape[1])[: max(1, x.shape[1] * 2 // 3)])
        _grow(x, bins, cuts, p - y, p * (1 - p), rows, stats, (), depth, found)
        paths = {r for r, _ in found}
        for rule, value in found:
            rules.setdefault(tuple(sorted(rule)))
            if not any(p[:-1] == rule for p in paths):  # a leaf
                margin += 0.2 * value * holds(rule, x)
    names = list(rules)
    z = np.stack([holds(r, x) for r in names], 1).astype(float)
    spread = z.std(0)
    names = [r for r, s in zip(names, spread, strict=True) if s > 0.005]
    z, spread = z[:, spread > 0.005], spread[spread > 0.005]
    if not names:
        return RuleModel((), (), float(np.log(y.mean() / (1 - y.mean()))))
    middle = z.mean(0)
    scaled = (z - middle) / spread
    part = draw.random(len(y)) < 0.8
    losses = []
    grid = (0.01, 0.004, 0.0015, 0.0005)
    for penalty in grid:
        w, b = _lasso(scaled[part], y[part], penalty)
        p = np.clip(sigmoid(scaled[~part] @ w + b), 1e-6, 1 - 1e-6)
        losses.append(-np.mean(np.where(y[~part] == 1, np.log(p), np.log(1 - p))))
    w, b = _lasso(scaled, y, grid[int(np.argmin(losses))])
    used = np.flatnonzero(w)
    return RuleModel(tuple(names[i] for i in used), tuple(float(w[i] / spread[i]) for i in used), float(b - (w / spread * middle)[used].sum()))


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleModel:
    rows = text_statistics(training_rows(docs, labels, "quality", max_rows)).drop("text").toPandas().sort_values("doc_id", kind="stable")
    return fit_rules(rows[["stat_" + s for s in STATS]].to_numpy(float).reshape(-1, len(STATS)), rows["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleModel, score: str = "quality_score") -> DataFrame:
    """``docs`` with a column ``score``, a probability from 0 to 1."""
    docs, prefix = docs.drop(score), "_stat_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return text_statistics(docs, prefix).withColumn(score, model.column(prefix)).select(*docs.columns, score)
