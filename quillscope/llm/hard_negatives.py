"""Operator 11, hard-negative mining: dual-tree search.

Two trees, one over the anchors and one over all rows, are searched together:
leaves and their blocks are Spark rows with the box that their vectors fill, and
below them chunks and blocks hold trees of their own. A pair of nodes is left out
as a whole, with all its anchors, where the interval of its inner products meets
no window of these anchors, or where its labels can't fit; otherwise both are
opened, and pairs of leaves are scored exactly.

The first search finds each anchor's first ``positives`` other rows of its label.
Each of their scores s sets a window of ``least`` to ``most`` percent of s, in
which the second search finds the first ``negatives`` rows of other labels;
positives of one score share a window. Equal scores go to the smaller id.

Defined results: rows with a null id, a null label, a null vector or a null or
non-finite component take no part; an empty vector has score 0 with other empty
ones, and vectors of different lengths don't meet; a negative positive score
leaves no window; equal rows of one id are rows of their own, as anchors,
positives and negatives, and only the anchor's own row isn't its positive; an
empty table gives an empty one; further columns don't matter. A component beyond
32 bits, or an inner product beyond 64, raises an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vector_blocks as vb
from ._store import release, stash

#: Rows of the leaves of the trees within chunks and blocks.
ANCHORS, ROWS = 32, 128


def _levels(x: np.ndarray, labels: np.ndarray, leaf: int) -> list[tuple[np.ndarray, ...]]:
    """Boxes and label ranges of the nodes, level by level, leaves first."""
    heads = np.arange(0, len(x), leaf)
    low, high = np.minimum.reduceat(x, heads), np.maximum.reduceat(x, heads)
    first, last = np.minimum.reduceat(labels, heads), np.maximum.reduceat(labels, heads)
    out = [(low, high, first, last)]
    while len(out[-1][0]) > 1:
        low, high, first, last = out[-1]
        heads = np.arange(0, len(low), 2)
        out.append((np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads), np.minimum.reduceat(first, heads), np.maximum.reduceat(last, heads)))
    return out


def _lifted(value: np.ndarray, levels: int, best: np.ufunc) -> list[np.ndarray]:
    out = [value]
    while len(out) < levels:
        out.append(best.reduceat(out[-1], np.arange(0, len(out[-1]), 2)))
    return out


def _leaf_pairs(anchors: list, rows: list, floor: np.ndarray, ceiling: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor leaf, row leaf, greatest score) of the leaf pairs that no pair of
    nodes above them rules out, from the roots down, all of one depth at once."""
    floors, ceilings = _lifted(floor, len(anchors), np.minimum), _lifted(ceiling, len(anchors), np.maximum)
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    a, b = len(anchors) - 1, len(rows) - 1
    while True:
        low, high, first, last = (v[i] for v in anchors[a])
        low_b, high_b, first_b, last_b = (v[j] for v in rows[b])
        least, most = vb.interval(low, high, low_b, high_b)
        ok = (most >= floors[a][i]) & (least <= ceilings[a][i])
        ok &= (first <= last_b) & (first_b <= last) if same else ~((first == last) & (first_b == last_b) & (first == first_b))
        i, j, most = i[ok], j[ok], most[ok]
        if a == 0 and b == 0:
            return i, j, most
        if a:
            a -= 1
            i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
            i, j = i[(some := i < len(anchors[a][0]))], j[some]
        if b:
            b -= 1
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
            i, j = i[(some := j < len(rows[b][0]))], j[some]


def _dual_tree(k: int, same: bool) -> Callable:
    """A kernel that finds the first ``k`` rows of the same label, or of others, in
    each window."""

    def kernel(chunk: dict, wins: np.ndarray, rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # windows stand in the order of their queries, so leaves are stretches
        q, low, high = wins[:, 0], wins[:, 2].copy(), wins[:, 3]
        heads = np.searchsorted(q, np.arange(0, len(chunk["ids"]), ANCHORS))
        ends = np.append(heads[1:], len(q))
        floor, ceiling = np.minimum.reduceat(low, heads), np.maximum.reduceat(high, heads)
        anchor_leaves, row_leaves, top = _leaf_pairs(_levels(chunk["x"], chunk["labels"], ANCHORS), _levels(rows["x"], rows["labels"], ROWS), floor, ceiling, same)
        out = [np.zeros((3, 0), np.int64)]
        for leaf in np.unique(anchor_leaves):
            mine = np.flatnonzero(anchor_leaves == leaf)
            mine = mine[np.argsort(-top[mine], kind="stable")]
            w = np.arange(heads[leaf], ends[leaf])
            base = leaf * ANCHORS
            x, labels = chunk["x"][base : base + ANCHORS], chunk["labels"][q[w]]
            done, size = 0, 1
            while done < len(mine):
                some = mine[done : done + size]
                done, size = done + size, size * 2
                some = some[top[some] >= low[w].min()]
                if not len(some):
                    break
                at = (row_leaves[some][:, None] * ROWS + np.arange(ROWS)).ravel()
                at = at[at < len(rows["ids"])]
                score = vb.dot(x, rows["x"][at])[q[w] - base]
                fits = (rows["labels"][at] == labels[:, None]) == same
                own = (rows["ids"][at] == chunk["ids"][q[w]][:, None]) & (rows["keys"][at] == chunk["keys"][q[w]][:, None]) & (rows["copies"][at] == 1)
                fits &= (score >= low[w][:, None]) & (score <= high[w][:, None]) & ~own
                i, j = np.nonzero(fits)
                out.append(np.stack([w[i], at[j], score[i, j]]))
                if len(at) > k:
                    kth = np.partition(np.where(fits, score, -vb.WIDE), len(at) - k, axis=1)[:, len(at) - k]
                    low[w] = np.maximum(low[w], kth)
        w, at, score = np.concatenate(out, axis=1)
        ok = score >= low[w]
        return vb.first_of_each(w[ok], at[ok], score[ok], rows["ids"], k)

    return kernel


def mine_hard_negatives(
    vectors: DataFrame, label: Column, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of
    a table (vec_id, embedding): up to ``negatives`` rows for each anchor and each
    of its positives. ``label`` is taken from the table's columns, ``anchors`` is a
    condition on ``id``."""
    rows = vb.members(vb.integers(vectors.where(label.isNotNull()), scale, label))
    block = vb.blocks(rows, ROWS)
    asked = stash(rows.where(anchors))
    one = asked.select("id", "key", F.lit(0).cast("long").alias("w"), F.lit(-vb.WIDE).alias("low"), F.lit(vb.WIDE).alias("high"))
    found = vb.search(asked, one, block, positives, _dual_tree(positives, True))
    # windows by score; integer divisions, rounded inwards
    down = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    windows = found.select("id", "key", F.col("score").alias("w")).distinct().select("id", "key", "w", (-down(-F.col("w") * least)).alias("low"), down(F.col("w") * most).alias("high"))
    windows = windows.where("low <= high")
    mined = vb.search(asked, windows, block, negatives, _dual_tree(negatives, False))
    pairs = found.select("id", "key", F.col("other").alias("positive_id"), F.col("score").alias("w"))
    times = asked.where("copies > 1").select("id", "key", "copies")
    out = mined.withColumnRenamed("score", "negative_score").join(pairs, ["id", "key", "w"]).join(times, ["id", "key"], "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    out = stash(out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), F.col("w").alias("positive_score"), "negative_score"))
    release(rows, block, asked, found, mined)
    return out
