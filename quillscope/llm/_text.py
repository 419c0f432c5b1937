"""Vectorised words, hashes and shingles of Arrow text batches.

A word is a run of bytes other than the ASCII blanks 0x20 and 0x09-0x0D, which
in UTF-8 equals ``[^\\x20\\x09-\\x0D]+`` on characters. Texts are cut into
slices of a few megabytes of whole documents, so temporary arrays stay small
whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public MurmurHash3 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def text_slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of whole texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    arr = texts.cast(pa.large_string()).fill_null("")
    if not len(arr):
        return
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(arr):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


@dataclass
class Words:
    """Words of a slice: byte spans, 64-bit hashes, and first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    data = LOWER[data] if lower else data
    n = len(data)
    blank = np.ones(n + 2, bool)
    blank[1:-1] = _BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = ~blank[1:-1]
    starts = np.flatnonzero(word & (blank[:-2] | edge[:-1]))
    ends = np.flatnonzero(word & (blank[2:] | edge[1:])) + 1
    return Words(data, starts, ends, _word_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view(np.uint64), (len(data) + 1,), (1,))
    length = ends - starts
    with np.errstate(over="ignore"):
        h = mix((eight[starts] & _KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at, more = 8, np.flatnonzero(length > 8)
        while len(more):
            part = eight[starts[more] + at] & _KEEP[np.minimum(length[more] - at, 8)]
            h[more] = mix(h[more] * np.uint64(0xD6E8FEB86659FD93) + part)
            at += 8
            more = more[length[more] > at]
    return h


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of each run of ``size`` words; a text of fewer words,
    but at least one, has its whole sequence as its only shingle."""
    times = constants(size, 7)
    counts, total = w.counts, len(w.hashes)
    with np.errstate(over="ignore"):
        full = np.full(max(0, total - size + 1), size, np.uint64)
        for j in range(size):
            full += w.hashes[j : total - size + 1 + j] * times[j]
        doc = w.doc
        inside = np.flatnonzero(doc[: total - size + 1] == doc[size - 1 :]) if total >= size else np.zeros(0, np.int64)
        out_doc, out = doc[inside], mix(full[inside])
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            h = counts[short].astype(np.uint64)
            for j in range(size - 1):
                has = counts[short] > j
                h[has] += w.hashes[w.first[short[has]] + j] * times[j]
            out_doc, out = np.concatenate([out_doc, short]), np.concatenate([out, mix(h)])
            order = np.argsort(out_doc, kind="stable")
            out_doc, out = out_doc[order], out[order]
    return out_doc, out


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, value) pairs, sorted."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of numpy arrays or Arrow arrays in the schema's order."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
