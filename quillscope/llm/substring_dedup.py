"""Operator 1, substring dedup: prefix-partitioned suffix trees.

A repeat of ``length`` words starts somewhere; instead of every suffix of the
corpus, only those that start at anchors are sorted. An anchor is the run of
``gram`` words of least hash within a window of ``length`` words, so two equal
windows have the same anchor at the same place, and about one word in twenty is
one. Suffixes are partitioned by their first ``gram`` words; prefixes that only
one document has are dropped before any text moves. A group of more than
``group_rows`` suffixes is split by more words: its windows are dealt into ranges
of 16 by the number of words before the anchor, then of 4 and at last of 1, and
the words that all windows of a range have in common, 34 at least, then 46, then
all 50, are the range's prefix. Only groups that are still too large go on to
the next length.

Each task takes whole prefix groups up to a memory budget, sorts their suffixes
by word and derives the common prefixes of neighbours, which is the group's
suffix tree: under a node of depth d lie the suffixes that share d words. A
window that starts a words before its anchor is repeated where leaves under a
node of depth ``length`` - a share the a words before it as well, and each of its
leaves is compared with the smallest doc_id there. A group whose prefix is the
whole window is one such node: its smallest doc_id is an aggregate.

Documents of equal word sequences are folded first. Every removal is judged on
the input. Word hashes have 64 bits; whole windows and folding use 128.

Defined results: a null or empty text has no words and keeps the empty text;
documents of fewer than ``length`` words lose nothing; a document loses nothing
to itself or to rows of the same doc_id; with a null doc_id nothing is removed
and nothing is lost to it; an empty table gives an empty one; only doc_id and
text are read, so further columns don't matter. A text is held whole in memory,
some 200 bytes for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import among, release, stash
from ._text import Words, batch, constants, mix, text_slices, words

LENGTH, GRAM = 50, 8
# a suffix takes some 400 bytes, and as much again for each of three sorted copies
GROUP_ROWS = 20_000
WIDTHS = (16, 4, 1)
TREE_BYTES = 24 << 20


def _upto(h: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of word hashes up to each word, and what undoes the weight
    of a first word: two lookups give the hash of any run of words."""
    with np.errstate(over="ignore"):
        base = constants(1, seed)[0]  # odd, so its powers have inverses
        power = np.full(len(h) + 1, base, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        inverse = np.full(len(h) + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64)
        inverse[0] = 1
        inverse = np.multiply.accumulate(inverse)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(seed)) * power[:-1], dtype=np.uint64)]), inverse


def _sums(h: np.ndarray, span: int, seed: int) -> np.ndarray:
    """Hash of each run of ``span`` words (runs may cross texts)."""
    upto, inverse = _upto(h, seed)
    n = max(0, len(h) - span + 1)
    with np.errstate(over="ignore"):
        return mix((upto[span : span + n] - upto[:n]) * inverse[:n])


def _digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each text's sequence of words."""
    out = []
    with np.errstate(over="ignore"):
        place = np.arange(len(w.hashes)) - np.repeat(w.first[:-1], w.counts)
        for seed in (3, 5):
            spread = mix(w.hashes * constants(1, seed)[0] + mix(place.astype(np.uint64) + np.uint64(seed)))
            upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)])
            out.append(mix(upto[w.first[1:]] - upto[w.first[:-1]]).view(np.int64))
    return out[0], out[1]


def _anchors(w: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram hash, anchor, first and last window start), word numbers in
    the slice; one row for each stretch of windows with one anchor."""
    counts = w.counts
    valid = np.flatnonzero(np.arange(len(w.hashes)) + length <= np.repeat(w.first[1:], counts))
    if not len(valid):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    value = _sums(w.hashes, gram, 17)
    spot = np.arange(len(value), dtype=np.int32)

    def join(a, b):
        less = b[0] < a[0]
        return np.where(less, b[0], a[0]), np.where(less, b[1], a[1])

    span, todo, have = 1, length - gram + 1, None
    level, offset = (value, spot), 0
    while todo:
        if todo & 1:
            part = level[0][offset:], level[1][offset:]
            n = len(part[0]) if have is None else min(len(part[0]), len(have[0]))
            have = part if have is None else join((have[0][:n], have[1][:n]), (part[0][:n], part[1][:n]))
            offset += span
        todo >>= 1
        if todo:
            level = join((level[0][:-span], level[1][:-span]), (level[0][span:], level[1][span:]))
            span *= 2
    anchor, doc = have[1][valid].astype(np.int64), w.doc[valid]
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[cut[1:], len(valid)] - 1
    return doc[cut], value[anchor[cut]].view(np.int64), anchor[cut], valid[cut], valid[last]


_ANCHOR = pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])
_ANCHOR_SQL = "array<struct<gram:bigint,at:int,first:int,last:int>>"


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("anchors", pa.list_(_ANCHOR))])
        for b in batches:
            for base, data, offsets in text_slices(b.column("text")):
                w = words(data, offsets)
                doc, g, at, first, last = _anchors(w, length, gram)
                start = w.first[doc] if len(doc) else doc
                rows = pa.StructArray.from_arrays([pa.array(g), *(pa.array((x - start).astype(np.int32)) for x in (at, first, last))], fields=list(_ANCHOR))
                cut = np.searchsorted(doc, np.arange(len(offsets))).astype(np.int32)
                ids = b.column("doc_id").slice(base, len(offsets) - 1).cast(pa.int64())
                yield batch(schema, ids, w.counts.astype(np.int64), *_digests(w), pa.ListArray.from_arrays(pa.array(cut), rows))

    return run


_CUT_SQL = "doc_id long, d1 long, width int, up long, gram long, more long, at int, first int, last int"
_CUT = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("width", pa.int32()), ("up", pa.int64()), ("gram", pa.int64()), ("more", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


def _suspects(column: pa.Array, w: Words, digest: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, gram, anchor, first, last) of a slice's suspects, in words of the
    slice; rows that share a doc_id keep those of their own text."""
    row = np.repeat(np.arange(len(column)), column.value_lengths().fill_null(0).to_numpy())
    flat = column.flatten()
    d1, gram, at, first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
    own = d1 == digest[row]
    row, zero = row[own], w.first[row[own]]
    return row, gram[own], at[own] + zero, first[own] + zero, last[own] + zero


def _cut(length: int, gram: int):
    """Suspects dealt into ranges of each of ``WIDTHS`` numbers of words before
    the anchor; a range's key hashes the words that all its windows have, ``up``
    is the key of the wider range around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data, offsets in text_slices(b.column("text")):
                w = words(data, offsets)
                digest, _ = _digests(w)
                suspects = _suspects(b.column("suspects").slice(base, len(offsets) - 1), w, digest)
                sums = [_upto(w.hashes, seed) for seed in (19, 23)]
                ids = b.column("doc_id").slice(base, len(offsets) - 1).cast(pa.int64())

                def key(anchor, at, before, width, which):  # noqa: B023
                    s, e = at - before, at + length - np.minimum(before + width - 1, length - gram)
                    upto, inverse = sums[which]
                    with np.errstate(over="ignore"):
                        return mix(mix((upto[e] - upto[s]) * inverse[s]) + mix(anchor.view(np.uint64) + (before * 64 + width).astype(np.uint64))).view(np.int64)

                for width, wider in zip(WIDTHS, (None, *WIDTHS[:-1]), strict=True):
                    row, anchor, at, first, last = suspects
                    low = (at - last) // width
                    n = (at - first) // width - low + 1
                    which = np.repeat(np.arange(len(row)), n)
                    before = (low[which] + np.arange(len(which)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)) * width
                    row, anchor, at, first, last = (x[which] for x in suspects)
                    up = anchor if wider is None else key(anchor, at, before // wider * wider, wider, 0)
                    more = key(anchor, at, before, width, 1) if width == 1 else np.zeros(len(row), np.int64)
                    zero, lo, hi = w.first[row], np.maximum(first, at - before - width + 1), np.minimum(last, at - before)
                    yield batch(_CUT, ids.take(pa.array(row)), digest[row], np.full(len(row), width, np.int32), up, key(anchor, at, before, width, 0), more, *((x - zero).astype(np.int32) for x in (at, lo, hi)))

    return run


_SUFFIX = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("d1", pa.int64()), ("first", pa.int32()), ("off", pa.int32()), ("n", pa.int32()), ("text", pa.string())])
_SUFFIX_SQL = "gram long, doc_id long, d1 long, first int, off int, n int, text string"


def _suffixes(length: int):
    """Texts of the suffixes to sort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data, offsets in text_slices(b.column("text")):
                w = words(data, offsets)
                digest, _ = _digests(w)
                row, key, at, first, last = _suspects(b.column("suspects").slice(base, len(offsets) - 1), w, digest)
                raw = data.tobytes()
                text = [raw[s:e].decode() for s, e in zip(w.starts[first], w.ends[last + length - 1], strict=True)]
                ids = b.column("doc_id").slice(base, len(offsets) - 1).cast(pa.int64()).take(pa.array(row))
                yield batch(_SUFFIX, key, ids, digest[row], *(x.astype(np.int32) for x in (first - w.first[row], at - first, last - first + 1)), text)

    return run


_SPAN = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_SPAN_SQL = "doc_id long, d1 long, first int, last int"


def _subtrees(rows: pa.Table, length: int) -> pa.RecordBatch | None:
    """Repeated windows of whole prefix groups, as runs of window starts."""
    docs, off, n = (rows.column(c).to_numpy() for c in ("doc_id", "off", "n"))
    hashes, first = [], [np.zeros(1, np.int64)]
    for _, data, offsets in text_slices(rows.column("text")):
        w = words(data, offsets)
        first.append(w.first[1:] + first[-1][-1])
        hashes.append(w.hashes)
    h, first = np.concatenate(hashes), np.concatenate(first)
    m = len(docs)
    # the suffix from each anchor, to at most ``length`` words; what a text lacks equals nothing
    column = np.arange(length)
    place = first[:-1, None] + off[:, None] + column
    lacks = place >= first[1:, None]
    right = h[np.minimum(place, len(h) - 1)]
    right[lacks] = mix(np.arange(1, lacks.sum() + 1, dtype=np.uint64))
    order = np.argsort(np.ascontiguousarray(right.astype(">u8")).view(f"V{8 * length}").ravel(), kind="stable")
    right, docs, off, n = right[order], docs[order], off[order], n[order]
    start = first[:-1][order]
    same = right[1:] == right[:-1]
    common = np.where(same.all(1), length, same.argmin(1))  # of neighbours: the tree's inner depths
    found = np.zeros((m, length + 1), bool)
    before = np.zeros(m, np.uint64)
    for a in range(int(off.max()) + 1):
        if a:
            with np.errstate(over="ignore"):
                before = mix(before * np.uint64(0x9E3779B97F4A7C15) + h[np.maximum(start + off - a, 0)])
        mine = np.flatnonzero((a <= off) & (a > off - n))
        if len(mine) < 2:
            continue
        node = np.cumsum(np.r_[0, common < length - a])[mine]
        key = mix(before[mine] ^ mix(node.astype(np.uint64)))
        by = np.lexsort((docs[mine], key))
        sorted_key, sorted_doc = key[by], docs[mine][by]
        head = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
        least = sorted_doc[head][np.cumsum(head) - 1]
        found[mine[by[sorted_doc > least]], length - 1 - a] = True
    if not found.any():
        return None
    step = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, lo = np.nonzero(step == 1)
    hi = np.nonzero(step == -1)[1] - 1
    # column length - 1 - a is the window that starts a words before the anchor
    zero = rows.column("first").to_numpy()[order][row] + off[row] - (length - 1)
    return batch(_SPAN, docs[row], rows.column("d1").to_numpy()[order][row], (zero + lo).astype(np.int32), (zero + hi).astype(np.int32))


def _trees(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= TREE_BYTES:
                rows = pa.Table.from_batches(held)
                gram = rows.column("gram").to_numpy()
                whole = int(np.searchsorted(gram, gram[-1]))  # the last group may go on
                if whole:
                    out = _subtrees(rows.slice(0, whole).combine_chunks(), length)
                    if out is not None:
                        yield out
                    rows = rows.slice(whole).combine_chunks()
                held, size = rows.to_batches(), rows.nbytes
        if held:
            out = _subtrees(pa.Table.from_batches(held).combine_chunks(), length)
            if out is not None:
                yield out

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, d1, first, last): windows of ``length`` words that start at word
    ``first`` to ``last`` of the document (of digest d1, where rows share a
    doc_id) and that a document of smaller doc_id has too."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    scan = stash(docs.mapInArrow(_scan(length, gram), f"doc_id long, n_words long, d1 long, d2 long, anchors {_ANCHOR_SQL}"))
    folded = scan.where(F.col("n_words") >= length).groupBy("n_words", "d1", "d2").agg(F.min("doc_id").alias("original"))
    folded = stash(folded)
    named = scan.join(folded, ["n_words", "d1", "d2"])
    copies = named.where("doc_id > original").select("doc_id", "d1", F.lit(0).alias("first"), (F.col("n_words") - length).cast("int").alias("last"))
    copies = stash(copies)
    fits = stash(named.where("doc_id = original").select("doc_id", "d1", F.explode("anchors").alias("x")).select("doc_id", "d1", "x.*"))
    release(scan, folded)

    def shared(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Keys that several documents have, written so that a join with rows
        of a frequent key can be split."""
        counts = rows.groupBy(keys).agg(F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        return stash(counts.where("low < high").select(*keys, "low", (F.col("rows") > group_rows).alias("large")))

    def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
        listed = rows.groupBy("doc_id").agg(F.collect_list(F.struct("d1", "gram", "at", "first", "last")).alias("suspects"))
        return texts.join(listed, "doc_id")

    columns = ["doc_id", "d1", "gram", "at", "first", "last"]
    grams = shared(fits, ["gram"])
    marked = fits.join(grams, "gram")
    suspects, deep = marked.where("not large").select(columns), None
    if not grams.where("large").isEmpty():
        rest = stash(marked.where("large").select(columns))
        # only texts of these move: the others are left out where they are read
        cut = stash(with_texts(rest, among(docs, "doc_id", rest.select("doc_id"))).mapInArrow(_cut(length, gram), _CUT_SQL))
        for width in WIDTHS:
            ranges = cut.where(F.col("width") == width).join(grams.where("large").select(F.col("gram").alias("up")), "up", "left_semi")
            if width == 1:  # each group is a node of full depth
                deep = stash(ranges.join(shared(ranges, ["gram", "more"]), ["gram", "more"]).where("doc_id > low").select("doc_id", "d1", "first", "last"))
                break
            grams = shared(ranges, ["gram"])
            suspects = suspects.unionAll(ranges.join(grams, "gram").where("not large").select(columns))
    suffixes = stash(with_texts(suspects, docs).mapInArrow(_suffixes(length), _SUFFIX_SQL))
    release(fits)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trees = stash(suffixes.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_trees(length), _SPAN_SQL))
    release(suffixes)
    found = copies.unionAll(trees)
    return found if deep is None else found.unionAll(deep)


def _apply(length: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, data, offsets in text_slices(b.column("text")):
                w = words(data, offsets)
                digest, _ = _digests(w)
                change = np.zeros(len(w.hashes) + 1, np.int32)
                spans = b.column("_spans").slice(base, len(offsets) - 1)
                flat, count = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy()
                if len(flat):
                    row = np.repeat(np.arange(len(offsets) - 1), count)
                    d1, lo, hi = (flat.field(i).to_numpy() for i in range(3))
                    own = d1 == digest[row]
                    np.add.at(change, w.first[row[own]] + lo[own], 1)
                    np.add.at(change, w.first[row[own]] + hi[own] + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                # kept words joined by one blank: each but a text's last takes the byte behind it
                starts, ends, doc = w.starts[keep], w.ends[keep], w.doc[keep]
                joined = np.r_[doc[1:] == doc[:-1], np.zeros(min(1, len(doc)), bool)]
                out = np.append(data, np.uint8(32))
                out[ends[joined]] = 32
                edge = np.zeros(len(out) + 1, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, ends + joined, -1)
                text = out[np.cumsum(edge[:-1]) > 0].tobytes()
                size = np.bincount(doc, ends - starts + joined, len(offsets) - 1).astype(np.int64)
                cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
                kept = [text[cut[i] : cut[i + 1]] for i in range(len(offsets) - 1)]
                removed = w.counts - np.bincount(doc, minlength=len(offsets) - 1)
                made = {"n_words": pa.array(w.counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "kept_text": pa.array([x.decode() for x in kept]) if "kept_text" in columns else None}
                made["doc_id"] = b.column("doc_id").slice(base, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([made[c] for c in columns], names=columns)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: bool = True, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, with
    ``texts``, kept_text: the words no repeated window covers, joined by blanks."""
    spans = repeated_spans(docs, length, **options).groupBy("doc_id").agg(F.collect_list(F.struct("d1", "first", "last")).alias("_spans"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * texts]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_apply(length, columns), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
