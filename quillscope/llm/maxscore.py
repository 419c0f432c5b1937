"""Operator 13, exact top-k search: MaxScore over sharded postings.

Components are the terms. Every shard (a block of near rows) holds, for each
component, its rows in the order of their values: one posting list, read from the
end that a query's sign makes best, and parted into layers whose bounds are known.
For each query a shard's terms are split by these bounds: as long as the rest of
all lists can't reach the query's threshold together, it is non-essential and
isn't traversed; the layers that must be, those that lower the bound most for
their length, are essential. Rows that stand in no essential layer can't compete.
The others are probed for the remaining components, those of the widest bounds
first, and leave as soon as what is left can't lift them to the threshold.
Neighbouring queries read their lists and probe together: a row is dropped when
it can't compete for any of them.

Shards whose bound is below the thresholds of a chunk of queries aren't visited.
The others are visited in rounds, the most promising first; each round's results
are merged, and its k-th scores are the next one's thresholds.

Defined results: rows with a null id, a null vector or a null or non-finite
component take no part; an empty vector has score 0 with other empty ones, and
vectors of different lengths don't meet; equal rows of one id are rows of their
own, and only the query's own row is left out; fewer than k rows are all
returned; an empty table gives an empty one; further columns don't matter. A
component beyond 32 bits, or an inner product beyond 64, raises an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _vector_blocks as vb
from ._store import release, stash

#: Layers of a posting list, components that are probed at once, and neighbouring
#: queries whose lists are read together.
LAYERS, PROBED, TOGETHER = 8, 16, 32


def _postings(t: pa.Table, x: np.ndarray, sort: np.ndarray) -> bytes:
    """Each component's rows by value."""
    return np.argsort(x.T, axis=1, kind="stable").astype("<i4").tobytes()


def _split(q: np.ndarray, heads: np.ndarray, tails: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(layers that are essential of each term of each query, whether the query
    has to be answered here at all).

    ``heads`` and ``tails`` (component, layer) are the greatest values left when
    that many layers are read from the top, and the least from the bottom."""
    bound = np.where(q[:, :, None] >= 0, q[:, :, None] * heads, q[:, :, None] * tails).astype(np.float64)
    slack = 1e-9 * np.abs(bound[:, :, 0]).sum(1) + 1
    total = bound[:, :, 0].sum(1) + slack
    gain = bound[:, :, :-1] - bound[:, :, 1:]
    # a layer can be read after those before it only
    value = np.minimum.accumulate(gain, axis=2).reshape(len(q), -1)
    order = np.argsort(-value, axis=1, kind="stable")
    left = total[:, None] - np.cumsum(np.take_along_axis(gain.reshape(len(q), -1), order, axis=1), axis=1)
    needed = np.where(total >= threshold, (left >= threshold[:, None]).sum(1) + 1, 0)
    read = np.zeros_like(value, bool)
    np.put_along_axis(read, order, np.arange(value.shape[1]) < needed[:, None], axis=1)
    return read.reshape(gain.shape).sum(2), total >= threshold


def _max_score(k: int) -> Callable:
    """A kernel that finds the first ``k`` rows of each query."""

    def kernel(chunk: dict, wins: np.ndarray, rows: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, ids, n = rows["x"], rows["ids"], len(rows["ids"])
        dim = x.shape[1]
        queries, threshold = chunk["x"][wins[:, 0]], wins[:, 2].astype(np.float64)
        if not dim:
            w, at = np.repeat(np.arange(len(wins)), n), np.tile(np.arange(n), len(wins))
            return vb.first_of_each(w, at, np.zeros(len(w), np.int64), ids, k + 1)
        postings = np.frombuffer(rows["extra"], "<i4").reshape(dim, n)
        cuts = np.arange(LAYERS + 1) * n // LAYERS
        component = np.arange(dim)[:, None]
        # greatest value outside the last cuts[l] places, least outside the first
        heads = x[postings[component, np.maximum(n - 1 - cuts, 0)], component].astype(np.float64)
        tails = x[postings[component, np.minimum(cuts, n - 1)], component].astype(np.float64)
        most = float(np.abs(x).max()) * float(np.abs(queries).max(initial=0)) * dim
        wide = np.float64 if most < 2**53 else np.int64
        if most >= 2**63:
            raise ValueError("inner products don't fit a long")
        values, asked = x.astype(wide), queries.astype(wide)
        layers, due = _split(queries.astype(np.float64), heads, tails, threshold)
        out = [np.zeros((3, 0), np.int64)]
        for first in range(0, len(asked), TOGETHER):
            w = first + np.flatnonzero(due[first : first + TOGETHER])
            if not len(w):
                continue
            q, up = asked[w], asked[w] >= 0
            # essential layers of these queries, from either end of each list
            marked = np.zeros(n, bool)
            above, below = np.where(up, layers[w], 0).max(0), np.where(up, 0, layers[w]).max(0)
            for j in np.flatnonzero(above):
                marked[postings[j, n - cuts[above[j]] :]] = True
            for j in np.flatnonzero(below):
                marked[postings[j, : cuts[below[j]]]] = True
            at = np.flatnonzero(marked)
            # probe the widest components first
            top = np.where(up, q * heads[:, 0], q * tails[:, 0]).astype(np.float64)
            spread = top - np.where(up, q * tails[:, 0], q * heads[:, 0])
            order = np.argsort(-spread.sum(0), kind="stable")
            rest = top.sum(1)
            score = np.zeros((len(at), len(w)), wide)
            for a in range(0, dim, PROBED):
                some = order[a : a + PROBED]
                score += values[at[:, None], some] @ q[:, some].T
                rest = rest - top[:, some].sum(1)
                alive = (score + (rest + 1e-9 * np.abs(rest) + 1 - threshold[w]) >= 0).any(1)
                at, score = at[alive], score[alive]
            limit = wins[w, 2].astype(wide)
            if len(at) > k + 1:
                limit = np.maximum(limit, np.partition(score, len(at) - k - 1, axis=0)[len(at) - k - 1])
            i, j = np.nonzero(score >= limit)
            out.append(np.stack([w[j], at[i], score[i, j].astype(np.int64)]))
        w, at, score = np.concatenate(out, axis=1)
        # one more than k: the query's own row may be among them
        return vb.first_of_each(w, at, score, ids, k + 1)

    return kernel


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of a table (vec_id, embedding): the ``k``
    highest inner products of floor(scale * x) of each row that meets the condition
    ``queries`` (on ``id``) with all other rows, ties to the smaller id."""
    rows = vb.members(vb.integers(vectors, scale))
    block = vb.blocks(rows, 64, _postings)
    asked = stash(rows.where(queries))
    every = asked.select("id", "key", F.lit(0).cast("long").alias("w"), F.lit(-vb.WIDE).alias("low"), F.lit(vb.WIDE).alias("high"))
    found = vb.search(asked, every, block, k, _max_score(k))
    times = asked.where("copies > 1").select("id", "key", "copies")
    out = found.join(times, ["id", "key"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))))
    out = stash(out.select(F.col("id").alias("query_id"), "rank", F.col("other").alias("vec_id"), "score"))
    release(rows, block, asked, found)
    return out
