"""Operator 12, periodic runs: branching tandem repeats in suffix trees (Stoye
and Gusfield), rotated and merged into maximal runs.

Each document's words make a suffix tree of their own. Trees of a stretch of
documents are built together, as suffix order, common prefixes and the intervals
between them (each interval is an inner node, its deepest boundaries part its
children). For every node of depth q the leaf lists of all children but the
largest are walked: leaf i makes a tandem repeat with leaf i + q or i - q where
that stands below the same node, and a branching one where the word after the
repeat ends the period. A branching repeat is where a run ends; rotating it to
the left as long as words agree finds where it begins. Of runs with the same
ends the one of the smallest period is kept.

A run is a stretch with smallest period q of at least ``least`` words and 2 * q
words that can't be lengthened either way. Words are compared as they are, byte
by byte; blanks are 0x20 and 0x09 to 0x0D.

Documents need no others, so nothing is shuffled. A text is held whole, with
some 200 bytes for each of its words; leaf lists are walked in pieces.

Defined results: null and empty texts have no words, no runs and an empty
collapsed text; overlapping runs are all returned, and a word is dropped from the
collapsed text where any of them holds it after its first period; repeated rows
each give their row; a null id gives a row; an empty table gives an empty one;
further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that are worked on at once, unless one text has more; leaves that are
#: walked at once.
WORDS = 150_000
LEAVES = 1 << 20

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _suffix_order(t: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and for each k the place of the first suffix with the
    same 2**k words. Words are numbers, each of one document alone; ``end`` is
    where the document of each word ends."""
    n = len(t)
    size = np.bincount(t)
    rank = (np.cumsum(size) - size)[t].astype(np.int32)
    order = np.argsort(t, kind="stable").astype(np.int32)
    ranks, step = [rank], 1
    open_ = order[size[t[order]] > 1]
    while len(open_):
        after = open_ + step
        second = np.where(after < end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_].astype(np.int64) * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        open_, key = open_[sort], key[sort]
        at, old = np.arange(len(key)), rank[open_]
        new_group, old_group = np.ones(len(key), bool), np.ones(len(key), bool)
        new_group[1:], old_group[1:] = key[1:] != key[:-1], old[1:] != old[:-1]
        place = old + (at - np.maximum.accumulate(np.where(old_group, at, 0))).astype(np.int32)
        order[place] = open_
        rank = rank.copy()
        rank[open_] = place[np.maximum.accumulate(np.where(new_group, at, 0))]
        ranks.append(rank)
        alone = new_group.copy()
        alone[:-1] &= new_group[1:]
        open_, step = open_[~alone], step * 2
    return order, ranks


def _common(ranks: list[np.ndarray], end: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words that the different suffixes x and y of one document share."""
    long, n = np.zeros(len(x), np.int32), len(end)
    limit = end[x]
    for k in range(len(ranks) - 2, -1, -1):
        a, b = x + long, y + long
        same = (a < limit) & (b < limit) & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
        long[same] += 1 << k
    return long


def _nodes(common: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one place of the inner node that each boundary parts:
    the widest stretch around it whose boundaries are all as deep."""
    depth, lows = common[at], [common]
    low, high = at.copy(), at + 1
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    # widen by doubling steps while all agree, then by halving ones
    k = 0
    while left.any() or right.any():
        if k:
            half = 1 << (k - 1)
            before = lows[-1]
            lows.append(np.minimum(before[:-half], before[half:]) if len(before) > half else before[:0])
        row, step = lows[k], 1 << k
        k += 1
        can = left & (low - step >= 0)
        can[can] = row[low[can] - step] >= depth[can]
        low[can] -= step
        left = can
        can = right & (high + step <= len(common))
        can[can] = row[high[can]] >= depth[can]
        high[can] += step
        right = can
    for j in range(k - 1, -1, -1):
        row, step = lows[j], 1 << j
        some = np.flatnonzero(low >= step)
        some = some[row[low[some] - step] >= depth[some]]
        low[some] -= step
        some = np.flatnonzero(high + step <= len(common))
        some = some[row[high[some]] >= depth[some]]
        high[some] += step
    return low - 1, high


def _smaller_halves(first: np.ndarray, last: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, ...]:
    """(begin, end, first, last, depth) of every child but the largest of every
    node: its boundaries part the node's places into its children."""
    sort = np.lexsort((at, last, first))
    first, last, at, depth = first[sort], last[sort], at[sort], depth[sort]
    new = np.ones(len(at), bool)
    new[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    node = np.cumsum(new) - 1
    following = np.append(at[1:], 0)
    closing = np.append(new[1:], True)
    heads = np.flatnonzero(new)
    begin = np.concatenate([first[heads], at])
    stop = np.concatenate([at[heads], np.where(closing, last, following)])
    of = np.concatenate([node[heads], node])
    sort = np.lexsort((stop - begin, of))
    largest = np.ones(len(of), bool)
    largest[:-1] = of[sort][1:] != of[sort][:-1]
    small = sort[~largest]
    head = heads[of[small]]
    return begin[small], stop[small], first[head], last[head], depth[head]


def _branching_repeats(t: np.ndarray, begin: np.ndarray, end: np.ndarray, order: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching tandem repeats."""
    n, place = len(t), ranks[-1]
    at = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    common = np.zeros(n + 1, np.int32)
    common[at] = _common(ranks, end, order[at - 1], order[at])
    first, last = _nodes(common, at)
    a, b, first, last, depth = _smaller_halves(first, last, at, common[at])
    total = np.cumsum(b - a)
    starts, periods = [], []
    piece = 0
    while piece < len(a):
        done = total[piece - 1] if piece else 0
        stop = max(piece + 1, int(np.searchsorted(total, done + LEAVES, side="right")))
        some = slice(piece, stop)
        long = b[some] - a[some]
        inside = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
        i = order[np.repeat(a[some], long) + inside].astype(np.int64)
        q, low, high = (np.repeat(x[some], long) for x in (depth, first, last))
        for start in (i, i - q):
            other = start + q if start is i else start
            ok = np.flatnonzero((other >= begin[i]) & (other < end[i]))
            ok = ok[(place[other[ok]] >= low[ok]) & (place[other[ok]] < high[ok])]
            s, p, stops = start[ok], q[ok], end[i[ok]]
            after = s + 2 * p
            branches = (after >= stops) | (t[s + p] != t[np.minimum(after, n - 1)])
            starts.append(s[branches])
            periods.append(p[branches].astype(np.int64))
        piece = stop
    return np.concatenate(starts) if starts else np.zeros(0, np.int64), np.concatenate(periods) if periods else np.zeros(0, np.int64)


def runs_of(t: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, smallest period) of the runs, by start and period."""
    order, ranks = _suffix_order(t, end)
    start, q = _branching_repeats(t, begin, end, order, ranks)
    stop, edge = start + 2 * q, begin[start]
    for k in range(len(ranks) - 2, -1, -1):
        before = np.maximum(start - (1 << k), 0)
        same = (start - (1 << k) >= edge) & (ranks[k][before] == ranks[k][before + q])
        start = np.where(same, before, start)
    long = np.flatnonzero(stop - start >= least)
    start, stop, q = start[long], stop[long], q[long]
    sort = np.lexsort((q, stop, start))
    start, stop, q = start[sort], stop[sort], q[sort]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, q = start[new], stop[new], q[new]
    sort = np.lexsort((q, start))
    return start[sort], stop[sort], q[sort]


def _stretch(texts: list[list[bytes]], least: int) -> tuple[pa.Array, pa.Array]:
    """Runs, and the words that are kept of each text of a stretch."""
    sizes = np.array([len(w) for w in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    t, used = np.empty(bounds[-1], np.int32), 0
    for words, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        number: dict[bytes, int] = {}
        t[a:b] = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        t[a:b] += used
        used += len(number)
    begin, end = (np.repeat(x, sizes).astype(np.int32) for x in (bounds[:-1], bounds[1:]))
    start, stop, q = runs_of(t, begin, end, least) if len(t) else (np.zeros(0, np.int64),) * 3
    # words inside any run after its first period
    cover = np.zeros(len(t) + 1, np.int32)
    np.add.at(cover, start + q, 1)
    np.add.at(cover, stop, -1)
    kept = np.cumsum(cover[:-1]) == 0
    of = np.searchsorted(bounds, start, side="right") - 1
    offsets = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
    texts_left = []
    for d, (words, a, b) in enumerate(zip(texts, bounds[:-1], bounds[1:], strict=True)):
        if offsets[d] < offsets[d + 1]:
            words = [words[i] for i in np.flatnonzero(kept[a:b])]
        texts_left.append(b" ".join(words))
    values = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - bounds[of], stop - start, q)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(texts_left, pa.binary()).cast(pa.string())


def find_runs(docs: DataFrame, least: int = 12, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row of ``docs`` (doc_id, text):
    the runs with their first word, length and period, by start and period, and
    the words that are left, joined by one space, when each run keeps its first
    period only. ``rewrite`` may change the words of a document beforehand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())
            at, waiting, size = 0, [], 0
            for i, doc_id in enumerate(ids):
                words = (texts[i].as_py() or b"").split()
                waiting.append(rewrite(doc_id, words) if rewrite else words)
                size += len(waiting[-1])
                if size >= WORDS or i == len(ids) - 1:
                    n_words = pa.array([len(w) for w in waiting], pa.int64())
                    runs, left = _stretch(waiting, least)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id")[at : i + 1], n_words, runs, left], names=["doc_id", "n_words", "runs", "collapsed"])
                    at, waiting, size = i + 1, [], 0

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
