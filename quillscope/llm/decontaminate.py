"""Operator 10, benchmark decontamination: size-partitioned MinHash containment
search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity with the
whole document, so a MinHash search over whole documents finds nothing. Items
are therefore partitioned by their number of shingles (classes that grow by
half), and each class looks through documents in overlapping windows sized for
it; items of up to ``SHORT`` shingles look at every single shingle. Minima of 64
hash functions are taken once over blocks of eight shingles and combined into
the windows of every class. A document and an item that share a minimum at one
function are a candidate; it is confirmed by the exact share of the item's
distinct 5-word shingles among those of the whole document.

The shingle that gives an item's minimum stands in a document that has three
quarters of them with probability 3/4, and is the minimum of its window too with
n / (n + window) >= 0.33, wherever the other shingles stand. So a document with
``share`` of an item is missed with (1 - 0.75 * 0.33) ** 64, about 1e-8, and with
0.25 ** 12, about 6e-8, by short items.

Items are broadcast in blocks of about ``block_bytes`` of text (their index
takes some eight times that); each further block is a further pass over the
documents, and its broadcast is destroyed before the next. A longer single item
is a block of its own.

Defined results: words are runs without ASCII blanks, A-Z lower-cased; a text
of fewer than five words is one shingle, a null or empty text has none and
matches nothing; ids may repeat (each row counts, by its own text) or be null; a
table without rows on either side gives none; only ids and texts are read, so
further columns don't matter, and ``drop_contaminated`` passes them on. A text
is held whole in memory, some 100 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stash
from ._text import batch, constants, distinct, shingles, text_slices, words

SHINGLE, FUNCTIONS, BLOCK, FEW, SHORT = 5, 64, 8, 12, 40
BLOCK_BYTES = 4 << 20


def _classes(sizes: np.ndarray) -> np.ndarray:
    """Number of each item's size class: class c holds up to 8 * 1.5**c shingles,
    class -1 those of up to ``SHORT``."""
    return np.where(sizes <= SHORT, -1, np.ceil(np.log(np.maximum(sizes, 8) / 8) / np.log(1.5) - 1e-9).astype(int))


def _window(c: int) -> tuple[int, int]:
    """Blocks in a window of class c, and blocks between window starts."""
    most = 8 * 1.5**c
    step = max(1, int(most * 0.25 // BLOCK))
    return int(np.ceil(most / BLOCK)) + step + 1, step


def _functions() -> tuple[np.ndarray, np.ndarray]:
    return constants(FUNCTIONS, 101), constants(FUNCTIONS, 211)


def _values(h: np.ndarray, f: int) -> np.ndarray:
    a, b = _functions()
    return ((h >> np.uint64(32)).astype(np.uint32) ^ np.uint32(b[f] >> np.uint64(32))) * np.uint32(a[f] & np.uint64(0xFFFFFFFF))


def _minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minima, under each function, of runs of hashes that start at ``at``."""
    out = np.empty((FUNCTIONS, len(at)), np.uint32)
    for f in range(FUNCTIONS):
        out[f] = np.minimum.reduceat(_values(h, f), at)
    return out


def _widened(best: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Minima over ``width`` blocks, or as many as the text has left."""
    span = 1
    while span < width:
        more = min(span, width - span)
        reach = np.flatnonzero(left > more)
        wider = best.copy()
        wider[reach] = np.minimum(best[reach], best[reach + more])
        best, span = wider, span + more
    return best


class ItemIndex:
    """Items of a block: their shingles, and their minima by size class."""

    def __init__(self, ids: list, texts: list):
        rows, hashes = [], []
        for base, data, offsets in text_slices(pa.array(texts, pa.string())):
            doc, h = shingles(words(data, offsets, lower=True), SHINGLE)
            doc, h = distinct(doc, h)
            rows.append(doc + base)
            hashes.append(h)
        self.ids = ids
        self.item = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.hash = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.size = np.bincount(self.item, minlength=len(ids))
        self.first = np.searchsorted(self.item, np.arange(len(ids) + 1))
        some = np.flatnonzero(self.size)
        self.by_class: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if len(some):
            minima = _minima(self.hash, self.first[some])
            group = _classes(self.size[some])
            for c in np.unique(group):
                mine = np.flatnonzero(group == c)
                # value in the low half, function in the high half
                keys = (minima[:, mine].astype(np.uint64) + (np.arange(FUNCTIONS, dtype=np.uint64) << np.uint64(32))[:, None]).ravel()
                who = np.tile(some[mine], FUNCTIONS)
                order = np.argsort(keys, kind="stable")
                bits = np.zeros(1 << 20, bool)
                bits[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                self.by_class[int(c)] = keys[order], who[order], bits

    def candidates(self, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs that share a minimum, as rows."""
        if not len(h) or not self.by_class:
            return np.zeros((0, 2), np.int64)
        # blocks of eight shingles, none across two texts
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        offset = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
        at = np.flatnonzero(offset % BLOCK == 0)
        block_doc, block_no, minima = doc[at], offset[at] // BLOCK, _minima(h, at)
        left = len(at) - np.arange(len(at))
        last = np.flatnonzero(np.r_[block_doc[1:] != block_doc[:-1], True])
        left = np.repeat(last, np.diff(np.r_[-1, last])) - np.arange(len(at)) + 1
        out = []
        for c, (keys, who, bits) in self.by_class.items():
            if c < 0:  # short items, with few functions
                starts, owner = np.arange(len(h)), doc
                tried = ((f, _values(h, f)) for f in range(FEW))
            else:
                width, step = _window(c)
                starts, owner = np.flatnonzero(block_no % step == 0), block_doc
                tried = ((f, _widened(minima[f], left, width)) for f in range(FUNCTIONS))
            for f, best in tried:
                value = best[starts]
                hit = np.flatnonzero(bits[value & np.uint32((1 << 20) - 1)])
                key = value[hit].astype(np.uint64) + np.uint64(f << 32)
                lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                n = hi - lo
                if n.sum():
                    pick = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                    out.append(np.stack([np.repeat(owner[starts[hit]], n), who[pick]], 1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)

    def contained(self, texts: pa.Array, share: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) where shared / size >= share."""
        for base, data, offsets in text_slices(texts):
            doc, h = shingles(words(data, offsets, lower=True), SHINGLE)
            found = self.candidates(doc, h)
            cut = np.searchsorted(doc, np.arange(len(offsets)))
            for d in np.unique(found[:, 0]):
                own = np.unique(h[cut[d] : cut[d + 1]])
                for i in found[found[:, 0] == d, 1]:
                    n = int(np.isin(self.hash[self.first[i] : self.first[i + 1]], own, assume_unique=True).sum())
                    if share[1] * n >= share[0] * int(self.size[i]):
                        yield base + int(d), int(i), n


def _indexes(items: DataFrame, block_bytes: int) -> Iterator[ItemIndex]:
    """Items dealt by hash into blocks of about so many bytes, one at a time."""
    items = items.select("item_id", "text").where(F.octet_length("text") > 0)
    held = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-held // block_bytes)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        if rows:
            yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows])


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64())])


def find_contained(docs: DataFrame, items: DataFrame, share: tuple[int, int] = (3, 4), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of items of which at least ``share``
    (numerator, denominator; 3/4 or more) of the distinct shingles are in the document."""
    spark, found, index = docs.sparkSession, [], None
    for own in _indexes(items, block_bytes):
        if index is not None:
            found[-1] = stash(found[-1])
            index.destroy()
        index = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                hits = list(own.contained(b.column("text"), share))
                ids = b.column("doc_id").take(pa.array([x[0] for x in hits], pa.int64())).cast(pa.int64())
                yield batch(_FOUND, ids, pa.array([own.ids[x[1]] for x in hits], pa.int64()), np.array([x[2] for x in hits], np.int64), np.array([own.size[x[1]] for x in hits], np.int64))

        found.append(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long"))
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], "doc_id long, item_id long, n_shared long, n_item long")


def drop_contaminated(docs: DataFrame, items: DataFrame, share: tuple[int, int] = (3, 4), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows of which the text contains an item."""
    index = None
    for own in _indexes(items, block_bytes):
        if index is not None:
            docs = stash(docs)
            index.destroy()
        index = docs.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[row for row, _, _ in own.contained(b.column("text"), share)]] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
