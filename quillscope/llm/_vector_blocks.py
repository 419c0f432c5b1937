"""Integer vectors in blocks of near ones, searched in rounds.

What operators 11 and 13 share: components become integers; a tree of
hyperplanes, made from a bounded sample, gives each row the code of its leaf; the
rows of a leaf are dealt into blocks of bounded size, each one row with its ids,
labels, vectors and the least and greatest value of every component. Queries are
packed likewise, by the first bits of the same codes.

A search finds, for every window [low, high] of every query, the ``k`` highest
scores within it. Boxes give each pair of nodes the interval that its inner
products lie in: queries are held against the leaves, what is left against their
blocks. The blocks of each chunk of queries are then visited in rounds, the most
promising first and four times as many each round; after every round a window
begins at its k-th score, which rules further blocks out. No row is dropped
otherwise, and what a round returns stays near k rows for each window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import release, stash

#: Components (rows times length) of a block of rows and of a chunk of queries,
#: rows of the sample the tree is made from (and components at most), and leaves.
BLOCK, CHUNK, SAMPLE, SAMPLE_VALUES, DEPTH = 1 << 18, 1 << 16, 4096, 1 << 19, 8
#: Beyond every score.
WIDE = 1 << 62
_ROW = "id long, label long, dim int, code int, vec binary"
_PACKED = "dim int, code int, sub int, size int, ids binary, keys binary, labels binary, copies binary, vecs binary, low binary, high binary, extra binary"


def integers(vectors: DataFrame, scale: int, label: Column | None = None) -> DataFrame:
    """(id, label, v) of the rows that take part: floor(scale * x) of every
    component. Rows with a null id, a null vector or a null or non-finite
    component don't."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return used.select(F.col("vec_id").cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"), v.alias("v"))


def axis(x: np.ndarray) -> np.ndarray:
    """The direction of greatest spread, by a few power steps."""
    centred = x - x.mean(0)
    w = centred[np.argmax((centred * centred).sum(1))] if len(x) and x.shape[1] else np.zeros(x.shape[1])
    for _ in range(4):
        w = centred.T @ (centred @ w)
        size = np.linalg.norm(w)
        if not size:
            break
        w = w / size
    return w


def _halving_tree(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Hyperplanes (normals, offsets) of a binary tree, heap order."""
    normals, cuts = np.zeros(((1 << depth) - 1, x.shape[1])), np.zeros((1 << depth) - 1)
    groups = {0: x}
    for node in range(len(cuts)):
        part = groups.pop(node)
        if len(part) > 1:
            normals[node] = axis(part)
            along = part @ normals[node]
            cuts[node] = np.median(along)
            right = along > cuts[node]
        else:
            right = np.zeros(len(part), bool)
        groups[2 * node + 1], groups[2 * node + 2] = part[~right], part[right]
    return normals, cuts


def _codes(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Leaf codes of ``DEPTH`` bits: a shallower tree fills the first ones."""
    node, depth = np.zeros(len(x), np.int64), 0
    if tree is not None:
        normals, cuts = tree
        depth = (len(cuts) + 1).bit_length() - 1
        for _ in range(depth):
            node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normals[node]) > cuts[node])
        node -= (1 << depth) - 1
    return (node << (DEPTH - depth)).astype(np.int32)


def arrange(x: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which each ``leaf`` of them lie near each other."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            out.append(part)
            continue
        half = leaf * (1 << max(0, math.ceil(math.log2(len(part) / leaf)) - 1))
        sort = part[np.argsort(x[part] @ axis(x[part]), kind="stable")]
        todo += [sort[half:], sort[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2**63:
        raise ValueError("inner products don't fit a long")
    return a.astype(np.int64) @ b.T.astype(np.int64)


def interval(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of a box of ``a`` with a box of ``b``, row by
    row; widened by what rounding may lose."""
    ends = [x.astype(np.float64) * y for x in (low_a, high_a) for y in (low_b, high_b)]
    least, most = np.minimum.reduce(ends).sum(-1), np.maximum.reduce(ends).sum(-1)
    slack = 1e-9 * (np.abs(least) + np.abs(most)) + 1
    return least - slack, most + slack


def members(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, v) with leaf codes, equal rows folded: id, label, dim,
    code, vec (32-bit integers), copies, key. Written."""
    n = rows.count()
    first = rows.select(F.size("v").alias("d")).where("d > 0").first() if n else None
    m = max(64, min(SAMPLE, SAMPLE_VALUES // max(1, first["d"] if first else 1)))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // m))) == 0).limit(2 * m).select("v").collect() if n else []
    by_length: dict[int, list] = {}
    for r in picked:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    trees = {}
    for d, sample in by_length.items():
        expected = n * len(sample) / len(picked)
        depth = min(DEPTH, math.ceil(math.log2(max(1.0, expected * d / BLOCK))), math.floor(math.log2(max(1, len(sample) / 4))))
        if d and depth > 0:
            trees[d] = _halving_tree(np.array(sample, np.float64), depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            flat, offsets = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64), v.offsets.to_numpy() - v.offsets[0].as_py()
            if len(flat) and np.abs(flat).max() >= 2**31:
                raise ValueError("a component doesn't fit 32 bits")
            long = np.diff(offsets)
            for d in np.unique(long):
                some = np.flatnonzero(long == d)
                x = flat[offsets[some][:, None] + np.arange(d)] if d else np.zeros((len(some), 0), np.int64)
                data = pa.py_buffer(x.astype("<i4").tobytes())
                ends = pa.py_buffer((np.arange(len(some) + 1) * 4 * d).astype(np.int32).tobytes())
                vec = pa.Array.from_buffers(pa.binary(), len(some), [None, ends, data])
                codes = _codes(x.astype(np.float64), trees.get(int(d)))
                at = pa.array(some)
                columns = [b.column("id").take(at), b.column("label").take(at), pa.array(np.full(len(some), d), pa.int32()), pa.array(codes, pa.int32()), vec]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "dim", "code", "vec"])

    folded = rows.mapInArrow(run, _ROW).groupBy("id", "label", "dim", "code", "vec").agg(F.count("*").alias("copies"))
    return stash(folded.withColumn("key", F.xxhash64("label", "vec")))


def _packed(rows: DataFrame, room: int, bits: int, extra: Callable | None, leaf: int) -> DataFrame:
    """Rows (id, key, label, dim, code, vec, copies, and for queries win) dealt
    into blocks: one row each. Leaves of more rows than have room are dealt by a
    hash of row identities, so that no block grows with a frequent one."""
    codes = F.shiftright("code", DEPTH - bits)
    rows = rows.withColumn("code", codes)
    sizes = rows.groupBy("dim", "code").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") * F.greatest("dim", F.lit(1)) / room)
    dealt = rows.join(sizes, ["dim", "code"]).withColumn("sub", F.pmod(F.xxhash64("id", "key"), parts).cast("int")).drop("n")

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        d, n = t.column("dim")[0].as_py(), t.num_rows
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<i4").reshape(n, d)
        sort = arrange(x.astype(np.float64), leaf)
        x = x[sort]
        number = lambda name, kind: t.column(name).to_numpy()[sort].astype(kind).tobytes()
        more = extra(t, x, sort) if extra else b""
        columns = [[d], [t.column("code")[0].as_py()], [t.column("sub")[0].as_py()], [n], [number("id", "<i8")], [number("key", "<i8")], [number("label", "<i8")], [number("copies", "<i8")], [x.tobytes()], [x.min(0).astype("<i4").tobytes()], [x.max(0).astype("<i4").tobytes()], [more]]
        kinds = [pa.int32()] * 4 + [pa.binary()] * 8
        names = ["dim", "code", "sub", "size", "ids", "keys", "labels", "copies", "vecs", "low", "high", "extra"]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.groupBy("dim", "code", "sub").applyInArrow(pack, _PACKED)


def blocks(rows: DataFrame, leaf: int, extra: Callable | None = None) -> DataFrame:
    """``members`` in blocks, written: a number, dim, code, and the columns of
    ``opened``. ``extra`` may add what a search wants to find in each."""
    numbered = _packed(rows, BLOCK, DEPTH, extra, leaf)
    return stash(numbered.withColumn("b", F.concat_ws("/", "dim", "code", "sub")).drop("sub"))


def opened(row: dict) -> dict:
    """Arrays of a packed row."""
    n, d = row["size"], row["dim"]
    read = lambda name, kind: np.frombuffer(row[name], kind)
    return {"ids": read("ids", "<i8"), "keys": read("keys", "<i8"), "labels": read("labels", "<i8"), "copies": read("copies", "<i8"), "x": read("vecs", "<i4").reshape(n, d), "extra": row["extra"]}


def _windows(t: pa.Table, x: np.ndarray, sort: np.ndarray) -> bytes:
    """(query, window, low, high) of each window of a chunk, as 64-bit integers."""
    lists = t.column("win").combine_chunks().take(pa.array(sort))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, long = lists.flatten(), lists.value_lengths().to_numpy()
    of = np.repeat(np.arange(len(long)), long)
    return np.column_stack([of, *(values.field(k).to_numpy() for k in ("w", "low", "high"))]).astype("<i8").tobytes()


def windows_of(extra: bytes) -> np.ndarray:
    return np.frombuffer(extra, "<i8").reshape(-1, 4)


def _leaves(block: DataFrame) -> DataFrame:
    """The box of each leaf: those of its blocks, put together within the tasks
    and then across them."""

    def together(dim: list, code: list, low: list, high: list) -> list:
        boxes: dict = {}
        for key, *ends in zip(zip(dim, code, strict=True), low, high, strict=True):
            ends = [np.frombuffer(x, "<i4") for x in ends]
            old = boxes.get(key)
            boxes[key] = (np.minimum(ends[0], old[0]), np.maximum(ends[1], old[1])) if old else ends
        rows = [(*key, *(x.astype("<i4").tobytes() for x in ends)) for key, ends in boxes.items()]
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int32(), pa.int32(), pa.binary(), pa.binary()])]

    names = ["dim", "code", "low", "high"]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(together(*(b.column(k).to_pylist() for k in names)), names=names)

    def across(t: pa.Table) -> pa.Table:
        return pa.table(together(*(t.column(k).to_pylist() for k in names)), names=names)

    schema = "dim int, code int, low binary, high binary"
    some = block.select(*names).mapInArrow(within, schema)
    return some.groupBy("dim", "code").applyInArrow(across, schema).select("dim", "code", F.col("low").alias("low_b"), F.col("high").alias("high_b"))


def _in_reach(pairs: DataFrame, keep: str, schema: str) -> DataFrame:
    """Of pairs of boxes (low to high, low_b to high_b) those whose interval meets
    [floor, ceiling], with the greatest score possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            top, ok = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            columns = zip(*(b.column(k).to_pylist() for k in ("low", "high", "low_b", "high_b", "floor", "ceiling")), strict=True)
            for i, (*boxes, floor, ceiling) in enumerate(columns):
                least, top[i] = interval(*(np.frombuffer(x, "<i4") for x in boxes))
                ok[i] = top[i] >= floor and least <= ceiling
            some = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(some) for k in keep.split()), pa.array(top[ok])], names=[*keep.split(), "top"])

    return pairs.mapInArrow(run, schema)


def search(queries: DataFrame, windows: DataFrame, block: DataFrame, k: int, kernel: Callable, rounds: int = 4) -> DataFrame:
    """The ``k`` highest scores of each window, ties to smaller ids: id, key (of
    the query), w, rank, other, score. Equal rows each take a rank.

    ``queries`` are some of ``members``; ``windows`` has id, key, w, low, high;
    ``kernel(chunk, windows, block)`` gives (place in windows, row of block,
    score) of the rows in a window, of which it may leave out those with k higher
    or equal ones of smaller ids in the same block."""
    spark = queries.sparkSession
    result = "id long, key long, w long, other long, score long, copies long"
    n = queries.agg(F.count("*"), F.sum(F.greatest("dim", F.lit(1)))).first()
    bits = max(0, min(DEPTH, math.floor(math.log2(max(1, (n[1] or 0) / CHUNK)))))
    windows, best, pairs, seen, size = stash(windows), None, None, 0, 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, rows = (opened(batch.column(name)[row].as_py()) for name in ("chunk", "block"))
                wins = windows_of(chunk["extra"])
                w, at, score = kernel(chunk, wins, rows)
                q = wins[w, 0]
                # a row is not its own partner; its equals are
                copies = rows["copies"][at] - ((chunk["ids"][q] == rows["ids"][at]) & (chunk["keys"][q] == rows["keys"][at]))
                columns = (chunk["ids"][q], chunk["keys"][q], wins[w, 1], rows["ids"][at], score, copies)
                ok = copies > 0
                yield pa.RecordBatch.from_arrays([pa.array(c[ok], pa.int64()) for c in columns], names=["id", "key", "w", "other", "score", "copies"])

    while True:
        wins = windows.groupBy("id", "key").agg(F.collect_list(F.struct("w", "low", "high")).alias("win"), F.min("low").alias("floor"), F.max("high").alias("ceiling"))
        asked = queries.join(wins, ["id", "key"])
        chunks = _packed(asked, CHUNK, bits, _windows, 32).withColumn("c", F.concat_ws("/", "dim", "code", "sub"))
        chunks = stash(chunks)
        reach = chunks.select("c", "dim", "low", "high", "extra")
        limits = reach.mapInArrow(_limits, "c string, dim int, low binary, high binary, floor long, ceiling long")
        if pairs is None:
            near = _in_reach(limits.join(_leaves(block), "dim"), "c dim code low high floor ceiling", "c string, dim int, code int, low binary, high binary, floor long, ceiling long, top double")
            boxes = block.select("b", "dim", "code", F.col("low").alias("low_b"), F.col("high").alias("high_b"))
            close = _in_reach(near.drop("top").join(boxes, ["dim", "code"]), "c b", "c string, b string, top double")
            pairs = stash(close.withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("top"), "b"))))
            last = pairs.agg(F.max("place")).first()[0] or 0
        due = pairs.where(F.col("place").between(seen + 1, seen + size)).join(limits.select("c", "floor"), "c").where("top >= floor").select("c", "b")
        whole = lambda df, key, name: df.select(key, F.struct("dim", "size", "ids", "keys", "labels", "copies", "vecs", "extra").alias(name))
        found = due.join(whole(chunks, "c", "chunk"), "c").join(whole(block, "b", "block"), "b").select("chunk", "block").mapInArrow(scored, result)
        found = stash(found)
        every = found if best is None else found.unionAll(best.select("id", "key", "w", "other", "score", F.lit(1).cast("long").alias("copies")))
        each = every.select("id", "key", "w", "other", "score", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))).alias("copy"))
        rank = F.row_number().over(Window.partitionBy("id", "key", "w").orderBy(F.desc("score"), "other"))
        after = stash(each.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "key", "w", "rank", "other", "score"))
        release(found, chunks, *([best] if best is not None else []))
        best, seen, size = after, seen + size, seen + size
        size *= rounds - 1
        if seen >= last:
            release(pairs, windows)
            return best
        reached = best.where(F.col("rank") == k).select("id", "key", "w", F.col("score").alias("kth"))
        raised = stash(windows.join(reached, ["id", "key", "w"], "left").select("id", "key", "w", F.greatest("low", F.coalesce("kth", "low")).alias("low"), "high"))
        release(windows)
        windows = raised


def _limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least start and the greatest end of a chunk's windows."""
    for b in batches:
        wins = [windows_of(x.as_py()) for x in b.column("extra")]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("c", "dim", "low", "high")), pa.array([int(w[:, 2].min()) for w in wins], pa.int64()), pa.array([int(w[:, 3].max()) for w in wins], pa.int64())], names=["c", "dim", "low", "high", "floor", "ceiling"])


def first_of_each(w: np.ndarray, at: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each window by score and id."""
    sort = np.lexsort((ids[at], -score, w))
    w, at, score = w[sort], at[sort], score[sort]
    head = np.ones(len(w), bool)
    head[1:] = w[1:] != w[:-1]
    place = np.arange(len(w)) - np.maximum.accumulate(np.where(head, np.arange(len(w)), 0)) if len(w) else np.zeros(0, np.int64)
    ok = place < k
    return w[ok], at[ok], score[ok]

