"""Operator 2, n-gram Jaccard join: PartEnum signatures.

A document's set holds its distinct 5-word shingles. Two sets of Jaccard
similarity >= 3/4 differ in at most k = a seventh of the sum of their sizes, and
their sizes are in the same or in adjacent bands that grow by 4/3; a set signs
in its own band and the next, so neighbours meet. For each band the feature
domain is dealt by hash into n1 first-level partitions of three second-level
partitions each. Of n1 partitions, at most k/2 can hold two differences; any
other has two of its three second-level partitions in common with the similar
set. The subsets enumerated are therefore the pairs of second-level partitions
of each first-level partition, and a pair's content is a signature: 0.44 to 0.57
signatures a shingle and band, each on four shingles or more. Bands of up to
``SMALL`` shingles have too few for that: there k + 1 partitions are more than
the differences can reach, and each partition by itself is the subset.

Subsets that are empty sign nothing. How many signatures a set shares, at least,
with any similar one follows from its own non-empty subsets; the plans leave
four standard deviations of room, so that number is positive for all but some
three sets in 100,000. Those few are joined among each other by the least
quarter of their shingles, which similar sets can't avoid sharing, so no link
rests on chance. (A pair with one set of positive number meets by signatures.)

Equal sets are folded first. Sets that share a signature form runs. A set with
fewer signatures in runs than it must share takes part in none, and signatures of
the same sets are one row, with their number as its weight. A run isn't
expanded into pairs: pairs of a member and the run's pivot that occur several
times are verified, links give components, and only runs that still hold
several components go on, again with the member of most links as pivot. What
remains is settled exactly: different components meet in a run, each set only in
as many of its signatures, those of short runs first, that the others are fewer
than it must share with a similar set. Two similar sets have the first signature
they share among these. Long runs, which come from passages that many documents
share, are last in that order and so are left to sets that have little else. A
component has one row in a run, however many of its sets stand there, and the sets
of two components that met are compared once, however many runs they share. Which
of 512 hash ranges hold an odd number of members bounds the difference of two sets
from below; the joins that make pairs have that bound in their condition. Counts of
members in 256 hash ranges drop more, before whole sets are moved.
Every link counts only after its exact intersection.

Defined results: a null or empty text has no shingles, size 0 and its own
doc_id as component; fewer than five words are one shingle; a row with a null
doc_id has the component of rows with an equal set, a set that only such rows
have links with nothing and has a null component; repeated rows each give a row, and rows
of one doc_id with other texts are documents of their own; an empty
table gives an empty one; only doc_id and text are read, so further columns
don't matter. A text is held whole in memory, some 100 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._components import connected
from ._store import among, release, stash
from ._text import batch, constants, distinct, mix, shingles, text_slices, words

SHINGLE, SMALL, OFTEN, HOT = 5, 120, 3, 32
#: Runs of up to so many sets rank alike, by signature.
SHORT = 2
WORDS = 8
BITS = [f"bits{i}" for i in range(WORDS)]
_EDGES = np.array([1.0])
while _EDGES[-1] < 1e9:
    _EDGES = np.append(_EDGES, _EDGES[-1] * 4 / 3)
FLUSH = 250_000
SLICE = 512 << 10


def _band(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(_EDGES, sizes * (1 + 1e-12), side="right") - 1


def _plan(band: int) -> tuple[int, int]:
    """(first-level partitions, second-level partitions of each) of a band."""
    top = _EDGES[band + 1]
    if top < 40:  # a partition for nearly every shingle
        return 1 << 14, 1
    n2 = 1 if top < SMALL else 3
    n1 = int(top / 7) if n2 == 3 else int(top * 2 / 7)
    while True:
        safe = True
        for size, differ in ((top, 2 * top / 7), (top * 9 / 16, top * 3 / 16)):
            differ = int(differ)
            x = np.exp(-size / (n1 * n2))  # a second-level partition is empty
            if n2 == 1:
                empty, spread = n1 * x, np.sqrt(n1 * x * (1 - (1 + size / n1) * x))
            else:  # of three pairs
                empty, spread = n1 * 3 * x * x, np.sqrt(n1 * (3 * x * x + 6 * x**3 - 9 * x**4))
            safe &= n1 * (3 if n2 == 3 else 1) - _lost(differ, n1, n2) - empty - 4 * spread >= 1
        if safe:
            return n1, n2
        n1 += max(1, n1 // 128)


def _lost(differ, n1, n2):
    """Subsets that so many differences can reach: of three pairs the first
    difference in a first-level partition reaches two, the second the last."""
    return np.where(n2 == 3, differ + np.minimum(differ, n1), differ)


_PLANS = np.array([_plan(b) for b in range(len(_EDGES) - 2)], np.int64)


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, start of each set, text index, hash) of distinct shingles."""
    for base, data, offsets in text_slices(texts, SLICE):
        doc, h = distinct(*shingles(words(data, offsets, lower=True), SHINGLE))
        yield base, len(offsets) - 1, np.searchsorted(doc, np.arange(len(offsets))), doc, h


def _digest(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (11, 13):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h * constants(1, seed)[0]), dtype=np.uint64)])
            out.append(mix(sums[first[1:]] - sums[first[:-1]] + np.uint64(seed)))
    return out[0].view(np.int64), out[1].view(np.int64)


def _odd_counts(rows: int, doc: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """64 x ``WORDS`` bits for each set: is the number of its members in a hash
    range odd? Two sets differ in at least as many members as in bits."""
    word = doc * WORDS + (h >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)  # ascending, as members are
    at = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    out = np.zeros(rows * WORDS, np.uint64)
    if len(at):
        bit = np.uint64(1) << ((h >> np.uint64(64 - WORDS.bit_length() + 1 - 6)) & np.uint64(63))
        out[word[at]] = np.bitwise_xor.reduceat(bit, at)
    return list(out.view(np.int64).reshape(rows, WORDS).T)


def _subsets(size: np.ndarray, doc: np.ndarray, h: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(band of each set, and of each non-empty subset: its set, place and content)
    for the instance of a set's own band (shift 0) or the next (1)."""
    band = _band(np.maximum(size, 1)) + shift
    n1, n2 = _PLANS[band, 0], _PLANS[band, 1]
    with np.errstate(over="ignore"):
        spread = mix(h + np.uint64(0x51ED27))
        part = ((spread >> np.uint64(32)) * (n1 * n2)[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        slot = doc << 32 | part
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        at = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        total = np.add.reduceat(mix(h[order] ^ np.uint64(0xA5A5)), at) if len(at) else np.zeros(0, np.uint64)
    who, part = slot[at] >> 32, slot[at] & 0xFFFFFFFF
    single = n2[who] == 1
    sets, places, sums = [who[single]], [part[single]], [total[single]]
    who, part, total = who[~single], part[~single], total[~single]
    if len(who):
        first, second = part // 3, part % 3
        head = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (first[1:] != first[:-1])])
        group = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(who)]))
        content, some = np.zeros((3, len(head)), np.uint64), np.zeros((3, len(head)), bool)
        content[second, group], some[second, group] = total, True
        for i, j in ((0, 1), (0, 2), (1, 2)):
            held = np.flatnonzero(some[i] | some[j])
            sets.append(who[head[held]])
            places.append(first[head[held]] * 4 + i + j)
            with np.errstate(over="ignore"):
                sums.append(content[i, held] + content[j, held])
    return band, np.concatenate(sets), np.concatenate(places), np.concatenate(sums)


def _needs(first: np.ndarray, doc: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """How many signatures, at least, a set shares with any similar set, in the
    instances of its own and the next band."""
    size, out = np.diff(first), []
    for shift in (0, 1):
        band, who, _, _ = _subsets(size, doc, h, shift)
        other = np.minimum(size * 4 / 3, _EDGES[band + 1])
        differ = np.floor((size + other) / 7 + 1e-9).astype(np.int64)
        own = np.bincount(who, minlength=len(size))
        out.append((own - _lost(differ, _PLANS[band, 0], _PLANS[band, 1])).astype(np.int32))
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("odd", pa.int32()), ("need0", pa.int32()), ("need1", pa.int32()), *((c, pa.int64()) for c in BITS)])
    for b in batches:
        for base, rows, first, doc, h in _sets(b.column("text")):
            size = np.diff(first).astype(np.int64)
            odd = (_band(np.maximum(size, 1)) & 1).astype(np.int32)
            doc_id, mark = (b.column(c).slice(base, rows).cast(pa.int64()) for c in ("doc_id", "mark"))
            yield batch(schema, doc_id, mark, size, *_digest(first, h), odd, *_needs(first, doc, h), *_odd_counts(rows, doc, h))


def _signatures(first: np.ndarray, doc: np.ndarray, h: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node) of every set in its own band and the next; bit 16 of a
    signature tells whether the number of its band is odd."""
    size = np.diff(first)
    out_sig, out_node, bit = [], [], np.uint64(1 << 16)
    with np.errstate(over="ignore"):
        for shift in (0, 1):
            band, who, place, content = _subsets(size, doc, h, shift)
            level = band[who].astype(np.uint64)
            out_sig.append((mix(content + mix(place.astype(np.uint64) + (level << np.uint64(40)))) & ~bit) | ((level & np.uint64(1)) * bit))
            out_node.append(node[who])
    return np.concatenate(out_sig), np.concatenate(out_node)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least quarter of each set's shingles, and one more, as signatures in
    the instances of both parities: similar sets have one of them in common."""
    for b in batches:
        for base, rows, first, _, h in _sets(b.column("text")):
            node = b.column("node").slice(base, rows).to_numpy()
            size = np.diff(first)
            at = np.arange(len(h)) - np.repeat(first[:-1], size) <= np.repeat(size, size) // 4
            with np.errstate(over="ignore"):
                sig, bit = mix(h[at] + np.uint64(0x9E37)), np.uint64(1 << 16)
            who = np.repeat(node, size)[at]
            yield batch(pa.schema([("sig", pa.int64()), ("node", pa.int64())]), np.r_[sig & ~bit, sig | bit].view(np.int64), np.r_[who, who])


_PACKED = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("sigs", pa.binary()), ("refs", pa.binary()), ("nodes", pa.binary())])


def _pack(sigs: list[np.ndarray], nodes: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Signatures of a stretch of input, a row per bucket. A signature of more
    than ``HOT`` sets here is spread over all buckets by set; one of its sets
    stands for it in its own bucket, so that few sets elsewhere meet company."""
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    sig, node = sig[keep], node[keep]
    head = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    times = np.diff(np.r_[head, len(sig)])
    hot = np.repeat(times > HOT, times)
    own = ~hot
    own[head] = True
    with np.errstate(over="ignore"):
        spread = mix(sig[hot] ^ mix(node[hot].view(np.uint64)))
    rows = [*_rows(sig[own], node[own], sig[own], buckets, False), *_rows(sig[hot], node[hot], spread, buckets, True)]
    return batch(_PACKED, *([r[i] for r in rows] for i in range(5)))


def _rows(sig: np.ndarray, node: np.ndarray, by: np.ndarray, buckets: int, hot: bool) -> Iterator[tuple]:
    """(bucket, hot, sigs, refs, nodes): six bytes of each signature and a
    reference into the row's list of nodes."""
    bucket = ((by >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)
    order = np.argsort(bucket, kind="stable")
    sig, node, bucket = sig[order], node[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(sig) else np.zeros(0, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own, refs = np.unique(node[a:b], return_inverse=True)
        # bytes of equal rank together, so that sorted signatures compress
        six = sig[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 7:1:-1].T.tobytes()
        yield int(bucket[a]), hot, six, refs.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes(), own.tobytes()


def _sign(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, nodes, held = [], [], 0
        for b in batches:
            for _, _, first, doc, h in _sets(b.column("text")):
                node, _ = _digest(first, h)
                s, n = _signatures(first, doc, h, node)
                sigs.append(s)
                nodes.append(n)
                held += len(s)
                if held >= FLUSH:
                    yield _pack(sigs, nodes, buckets)
                    sigs, nodes, held = [], [], 0
        if held:
            yield _pack(sigs, nodes, buckets)

    return run


def _meet(rows: list) -> pa.RecordBatch:
    """(sig, node) of signatures that several nodes of a bucket have, or of all
    where the bucket holds parts of hot ones."""
    sigs, nodes = [], []
    for r in rows:
        six = np.frombuffer(r["sigs"], np.uint8).reshape(6, -1).T
        sig = np.zeros((len(six), 8), np.uint8)
        sig[:, 7:1:-1] = six
        own = np.frombuffer(r["nodes"], np.int64)
        sigs.append(sig.view("<u8").ravel())
        nodes.append(own[np.frombuffer(r["refs"], np.uint16 if len(own) < 1 << 16 else np.uint32)])
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    sig, node = sig[keep], node[keep]
    more = np.r_[sig[1:] == sig[:-1], False]
    more[1:] |= more[:-1].copy()
    more |= rows[0]["hot"]
    return batch(pa.schema([("sig", pa.int64()), ("node", pa.int64())]), sig[more].view(np.int64), node[more])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket; a bucket's rows are taken together."""
    held: list = []
    for b in batches:
        for r in b.to_pylist():
            if held and (held[0]["bucket"], held[0]["hot"]) != (r["bucket"], r["hot"]):
                yield _meet(held)
                held = []
            held.append(r)
    if held:
        yield _meet(held)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets themselves, and counts of their members in 256 hash ranges."""
    schema = pa.schema([("node", pa.int64()), ("members", pa.binary()), ("ranges", pa.binary())])
    for b in batches:
        for base, rows, first, _, h in _sets(b.column("text")):
            own = [h[first[i] : first[i + 1]] for i in range(rows)]
            ranges = [np.minimum(np.bincount((x >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for x in own]
            yield batch(schema, b.column("node").slice(base, rows), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(ranges, pa.binary()))


def _plausible(share: tuple[int, int]):
    """Pairs of which the counts by range don't differ by more than similar sets
    can: what two sets don't share is no less than that difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            if not b.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for c in ("left", "right"))
            total = b.column("na").to_numpy() + b.column("nb").to_numpy()
            keep = pa.array(np.abs(left - right).sum(1) * (share[0] + share[1]) <= total * (share[1] - share[0]))
            yield batch(schema, b.column("a").filter(keep), b.column("b").filter(keep))

    return run


def _similar(share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            keep = []
            for left, right in zip(b.column("left"), b.column("right"), strict=True):
                x, y = np.frombuffer(left.as_py(), np.uint64), np.frombuffer(right.as_py(), np.uint64)
                n = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(share[1] * n >= share[0] * (len(x) + len(y) - n))
            keep = pa.array(keep, pa.bool_())
            yield batch(schema, b.column("a").filter(keep), b.column("b").filter(keep))

    return run


def _parity() -> Column:
    return F.shiftright("sig", 16).bitwiseAND(1)


def _need() -> Column:
    """What a set must share among signatures of a parity: of its own band or the next."""
    return F.when(F.col("parity") == F.col("odd"), F.col("need0")).otherwise(F.col("need1"))


def weighted_runs(runs: DataFrame, size: DataFrame) -> DataFrame:
    """(sig, node, weight) of runs (sig, node): sets that have fewer signatures in
    runs than they must share with a similar set are left out, and of signatures
    that the same sets have one stands for all; weight is their number."""
    runs = runs.withColumn("parity", _parity())
    needs = size.select("node", "odd", "need0", "need1")
    who = F.xxhash64("node", "parity").alias("who")
    able = stash(runs.groupBy("node", "parity").agg(F.count("*").alias("times")).join(needs, "node").where(F.col("times") >= _need()).select(who))
    # runs stay where they are: a set that a bitmap lets through too much is left out later
    rows = stash(among(runs.select("sig", "node", who), "who", able).select("sig", "node"))
    # equal sets of nodes: number, ends and two sums of 36 bits, which can't overflow
    short = lambda *x: F.sum(F.shiftrightunsigned(F.xxhash64("node", *x), 28))
    alike = [F.count("*").alias("length"), F.min("node").alias("low"), F.max("node").alias("high"), short().alias("sum1"), short(F.lit(1)).alias("sum2")]
    sets = rows.groupBy("sig").agg(*alike).where("low < high")
    one = sets.groupBy(_parity().alias("parity"), "length", "low", "high", "sum1", "sum2").agg(F.min("sig").alias("sig"), F.count("*").alias("weight"))
    kept = stash(one.select("sig", "weight"))
    out = stash(rows.join(kept, "sig").select("sig", "node", "weight"))
    release(able, rows, kept)
    return out


def least_common(rest: DataFrame, size: DataFrame) -> DataFrame:
    """Of the runs (sig, node, weight, component) of each set, and each band it
    signs in, those of fewest members up to where what is left weighs less than it
    must share with a similar set: two similar sets have the first one they share
    among them. Returns sig, node, component, size."""
    lengths = stash(rest.groupBy("sig").agg(F.count("*").alias("length")))
    rows = rest.join(lengths, "sig").join(size.select("node", "size", "odd", "need0", "need1"), "node")
    rows = rows.withColumn("parity", _parity()).withColumn("need", _need())
    every = Window.partitionBy("node", "parity")
    first = every.orderBy(F.greatest("length", F.lit(SHORT)), "sig").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("weight").over(first), F.lit(0))
    ranked = rows.withColumns({"before": before, "total": F.sum("weight").over(every)})
    out = stash(ranked.where(F.col("before") <= F.col("total") - F.col("need")).select("sig", "node", "component", "size"))
    release(lengths)
    return out


def _differ(suffix: str) -> Column:
    """In how many hash ranges one of two sets has an odd number of members."""
    return sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + suffix))) for c in BITS), F.lit(0))


def _near(share: tuple[int, int], sizes: tuple, differ: Column) -> Column:
    """Whether sets of such least and greatest sizes, of which so many members at
    least aren't shared, can be similar; as part of a join's condition it drops
    pairs before they are made."""
    low, high, low2, high2 = (F.col(x) for x in sizes)
    return (high * share[1] >= low2 * share[0]) & (high2 * share[1] >= low * share[0]) & (differ * (share[0] + share[1]) <= (high + high2) * (share[1] - share[0]))


def meeting(kept: DataFrame, size: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b), each once, of sets of different components that meet in runs
    ``kept`` (sig, node, component, size) and can be similar. Components meet
    first, a row for each in a run however many of its sets stand there; one set
    stands for a component, and what differs is at least what differs from it, less
    how far (away) the component's sets are from it. Sets of components that met
    are then compared with each other."""
    renamed = lambda rows, *same: rows.select(*(F.col(c) if c in same else F.col(c).alias(c + "2") for c in rows.columns))
    members = stash(kept.select("node", "component", "size").distinct().join(size.select("node", *BITS), "node"))
    centre = members.groupBy("component").agg(F.min(F.struct("node", *BITS)).alias("of"), F.min("size").alias("low"), F.max("size").alias("high"))
    centre = stash(centre.select("component", "low", "high", *(F.col(f"of.{c}").alias(c) for c in BITS)))
    away = members.join(renamed(centre.select("component", *BITS), "component"), "component").groupBy("component").agg(F.max(_differ("2")).alias("away"))
    balls = stash(centre.join(away, "component"))
    runs = stash(kept.select("sig", "component").distinct().join(balls, "component"))
    near = _near(share, ("low", "high", "low2", "high2"), _differ("2") - F.col("away") - F.col("away2"))
    met = stash(runs.join(renamed(runs, "sig"), "sig").where((F.col("component") < F.col("component2")) & near).select("component", "component2").distinct())
    # the ball comes first: of a component's sets only those in its reach become rows
    ends = met.join(renamed(balls), "component2").join(members, "component")
    ends = ends.where(_near(share, ("size", "size", "low2", "high2"), _differ("2") - F.col("away2"))).select("component2", "node", "size", *BITS)
    pairs = ends.join(renamed(members), "component2").where(_near(share, ("size", "size", "size2", "size2"), _differ("2")))
    out = stash(pairs.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")))
    release(members, centre, balls, runs, met)
    return out


def link_ngrams(docs: DataFrame, share: tuple[int, int] = (3, 4), buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, classes): documents have doc_id, mark (of the text), n_shingles,
    s1, s2; classes of equal sets have n_shingles, s1, s2, rep (smallest doc_id),
    component (smallest doc_id that links lead to) and kept_mark (of its text).
    ``share`` of at least 3/4."""
    if share[0] * 4 < share[1] * 3:
        raise ValueError("signatures are laid out for similarities of 3/4 or more")
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that repeat a doc_id may hold other texts: the mark tells which one
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    traits = {"odd": "int", "need0": "int", "need1": "int"} | dict.fromkeys(BITS, "long")
    described = stash(docs.mapInArrow(_describe, "doc_id long, mark long, n_shingles long, s1 long, s2 long, " + ", ".join(f"{c} {t}" for c, t in traits.items())))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark")))
    folded = described.where("n_shingles > 0").groupBy("n_shingles", "s1", "s2").agg(least.alias("least"), *(F.first(c).alias(c) for c in traits))
    classes = stash(folded.select("n_shingles", "s1", "s2", F.col("least.doc_id").alias("rep"), F.col("least.mark").alias("mark"), *traits))
    packed = docs.mapInArrow(_sign(buckets), "bucket int, hot boolean, sigs binary, refs binary, nodes binary")
    runs = stash(packed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "hot").mapInArrow(_gather, "sig long, node long"))
    size = classes.select(F.col("s1").alias("node"), F.col("n_shingles").alias("size"), "rep", "mark", *traits)

    # few, and written, so that texts needn't be dealt to meet them
    unsure = stash(size.where("least(need0, need1) < 1").select("node", F.col("rep").alias("doc_id"), "mark"))
    if not unsure.isEmpty():
        again = docs.join(unsure, ["doc_id", "mark"]).groupBy("node").agg(F.first("text").alias("text"))
        found, runs = runs, stash(runs.unionAll(again.mapInArrow(_prefixes, "sig long, node long")))
        release(found)
    found, runs = runs, weighted_runs(runs, size)
    release(found)

    wanted = stash(runs.select("node").distinct().join(size, "node").select("node", F.col("rep").alias("doc_id"), "mark"))
    # texts are made unique where the join has them, and only then become sets
    texts = among(docs.where("doc_id is not null"), "doc_id", wanted.select("doc_id")).join(wanted, ["doc_id", "mark"]).groupBy("doc_id", "mark", "node").agg(F.first("text").alias("text"))
    sets = stash(texts.select("node", "text").mapInArrow(_members, "node long, members binary, ranges binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of which the exact similarity reaches the threshold."""
        end = lambda name, n, suffix: size.select(F.col("node").alias(name), F.col("size").alias(n), *(F.col(c).alias(c + suffix) for c in BITS))
        sized = pairs.join(end("a", "na", ""), "a").join(end("b", "nb", "2"), "b").where(_near(share, ("na", "na", "nb", "nb"), _differ("2"))).select("a", "b", "na", "nb")
        side = lambda end, name, what: sets.select(F.col("node").alias(end), F.col(what).alias(name))
        counted = sized.join(side("a", "left", "ranges"), "a").join(side("b", "right", "ranges"), "b")
        close = stash(counted.select("a", "b", "na", "nb", "left", "right").mapInArrow(_plausible(share), "a long, b long"))
        rows = close.join(side("a", "left", "members"), "a").join(side("b", "right", "members"), "b")
        found = stash(rows.select("a", "b", "left", "right").mapInArrow(_similar(share), "a long, b long"))
        release(close)
        return found

    def by_pivot(runs: DataFrame, pivot: DataFrame) -> DataFrame:
        rows = runs.join(stash(pivot), "sig").where("node <> pivot")  # written, so that a join with a long run can be split
        pairs = rows.groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).agg(F.sum("weight").alias("times"))
        return pairs.where(F.col("times") >= OFTEN).select("a", "b")

    def unsettled(runs: DataFrame, links: DataFrame) -> DataFrame:
        """``runs``, with components, that still hold several components."""
        named = runs.select("sig", "node", "weight").join(connected(links), "node", "left").select("sig", "node", "weight", F.coalesce("component", "node").alias("component"))
        open_ = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
        return stash(named.join(stash(open_), "sig"))

    first = stash(by_pivot(runs, runs.groupBy("sig").agg(F.min("node").alias("pivot"))))
    links = verified(first)
    rest = unsettled(runs, links)
    release(runs)
    degree = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    ranked = rest.join(degree, "node", "left").select("sig", "node", "weight", "component", F.coalesce("degree", F.lit(0)).alias("degree"))
    hub = ranked.groupBy("sig").agg(F.max("degree").alias("degree")).join(ranked, ["sig", "degree"]).groupBy("sig").agg(F.max("node").alias("pivot"))
    second = stash(by_pivot(rest, hub).join(first, ["a", "b"], "left_anti"))
    tried, links = first.unionAll(second), stash(links.unionAll(verified(second)))
    held, rest = rest, unsettled(rest, links)
    release(held)
    # what is left, exactly: members of different components of a run
    held = least_common(rest, size)
    third = meeting(held, size, share)
    links = links.unionAll(verified(third.join(tried, ["a", "b"], "left_anti")))
    release(sets, wanted, unsure, rest, held, first, second, third)
    found = connected(links)
    named = stash(classes.join(found.withColumnRenamed("node", "s1").withColumnRenamed("component", "group"), "s1", "left"))
    # what stands for a group: its smallest doc_id, and of other texts under that
    # id the one of least mark
    first = stash(named.where("group is not null").groupBy("group").agg(F.min(F.struct("rep", "mark")).alias("kept")))
    own = F.when(F.col("rep").isNotNull(), F.struct("rep", "mark"))
    joined = named.join(first, "group", "left").withColumn("kept", F.coalesce("kept", own))
    out = stash(joined.select("n_shingles", "s1", "s2", "rep", F.col("kept.rep").alias("component"), F.col("kept.mark").alias("kept_mark")))
    release(named, first)
    return described, out


def ngram_components(docs: DataFrame, share: tuple[int, int] = (3, 4)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    described, classes = link_ngrams(docs, share)
    out = described.join(classes, ["n_shingles", "s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, share: tuple[int, int] = (3, 4)) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest doc_id.
    Rows of one doc_id with other texts are documents of their own; of several
    such rows in one component one text stays. Equal rows stay or go together."""
    described, classes = link_ngrams(docs, share)
    rows = described.where("doc_id is not null").join(classes.where("component is not null"), ["n_shingles", "s1", "s2"])
    gone = rows.where("doc_id <> component or mark <> kept_mark").select("doc_id", F.col("mark").alias("_mark_")).distinct()
    same = (docs["doc_id"] == gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["_mark_"])
    return docs.join(gone, same, "left_anti")
