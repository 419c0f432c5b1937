"""Operator 4, embedding near-dedup: NN-descent.

Vectors that lie within half the threshold angle of a pivot are all linked with
each other, so such a ball is counted instead of expanded; NN-descent runs over
the balls. Its graph starts from vectors that stand next to each other in the
order of random hyperplane codes, and is refined through joins of neighbours of
neighbours: every node compares its neighbours and reverse neighbours with one
another, and a pair is passed on where it improves a list. A list whose last
neighbour still lies in reach of the threshold (its angle, the node's radius and
that of the widest ball) is saturated and is enlarged, up to ``MOST`` places; nodes
that are saturated beyond that are searched exhaustively at the end, blocks of them
against blocks of all. A sample of nodes by hash is searched exhaustively as well,
to audit recall: it grows until it holds ``AUDIT_LINKS`` links; without any, recall
is unmeasured. While recall is below
``recall``, all lists grow and further code tables join the graph; where it is
below ``least_recall`` at the end, an error is raised, so links are never lost
in silence. At last the pairs of balls in reach are compared in double
precision, block of vectors against block of vectors.

No larger table is broadcast for the size that Spark takes it to have, and no vectors
are: a file of copies is small where its rows aren't, and so is an estimate before
rows are multiplied. An
exhaustive search sends ``HELD`` bytes of the nodes it looks for to all others at a
time. Neighbours meet in parts of ``PART`` bytes, and tables are dropped as soon as
nothing reads them, so disks hold a few copies of the vectors.

Vectors of different lengths link with nothing of another length; each length is
a search of its own.

Defined results: null or zero vectors and vectors with null or non-finite
components link with nothing; repeated rows of one vec_id count as one vector
(the shortest, then the first in order of its components) and each gives a row;
ties in a list go to the smaller id; a null vec_id gives a row without links; an
empty table gives an empty one; only vec_id and embedding are read, so further
columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._components import connected
from ._store import release, stash, unsized
from ._text import batch

LIST, MOST, TABLES, NEXT, BLOCK, QUERIES = 8, 256, 8, 4, 256, 1024
#: Links that an audit wants to see, and how many times ``QUERIES`` nodes it searches
#: for them at most.
AUDIT_LINKS, AUDIT_TIMES = 1000, 16
#: Bytes of wanted nodes that an exhaustive search sends out at a time, and of
#: neighbours that meet at a time.
HELD, PART = 16 << 20, 4 << 30
_PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])


def _rows(column: pa.Array) -> np.ndarray:
    """Unit vectors (float64) of a non-empty column of binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("unit", pa.binary())])
    for b in batches:
        ids, dims, units = [], [], []
        for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if i is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if not np.isfinite(x).all() or not top:
                continue
            x = x / top  # no overflow or underflow in the norm
            ids.append(i)
            dims.append(len(x))
            units.append((x / np.sqrt(x @ x)).tobytes())
        yield batch(schema, pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary()))


def _centre(vectors: DataFrame, dim: int) -> np.ndarray:
    """Mean of some 1,000 vectors: codes look at what is left beside a direction
    that all vectors share."""
    n = vectors.count()
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // QUERIES))) == 0).limit(2 * QUERIES).select("unit").collect()
    return np.mean([np.frombuffer(r["unit"], np.float64) for r in some], axis=0) if some else np.zeros(dim)


def _coded(vectors: DataFrame, seed: int, bits: int, dim: int, centre: np.ndarray) -> DataFrame:
    """``vectors`` (id, unit, ...) with the code of ``bits`` random hyperplanes
    through the centre."""
    planes = np.random.default_rng(seed).standard_normal((dim, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                code = (((_rows(b.column("unit")) - centre) @ planes > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code)], names=[*b.schema.names, "code"])

    return vectors.mapInArrow(run, vectors.schema.simpleString()[7:-1] + ",code:bigint")


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("id", pa.int64()), ("unit", pa.binary()), ("pivot", pa.int64()), ("angle", pa.float64())])
    for b in batches:
        if b.num_rows:
            dot = np.einsum("ij,ij->i", _rows(b.column("unit")), _rows(b.column("pivot_unit")))
            yield batch(schema, b.column("id"), b.column("unit"), b.column("pivot"), np.arccos(np.clip(dot, -1, 1)))


def _balls(vectors: DataFrame, reach: float, rounds: int, dim: int, centre: np.ndarray) -> DataFrame:
    """(id, unit, ball, angle): each vector in the ball of a pivot within
    ``reach``; a vector that no round takes in is a ball of its own."""
    free, done = vectors, []
    for r in range(rounds):
        coded = stash(_coded(free, 1000 + r, 16, dim, centre))
        pivots = coded.join(coded.groupBy("code").agg(F.min("id").alias("id")), ["code", "id"]).select("code", F.col("id").alias("pivot"), F.col("unit").alias("pivot_unit"))
        angled = coded.join(pivots, "code").select("id", "unit", "pivot", "pivot_unit").mapInArrow(_angles, "id long, unit binary, pivot long, angle double")
        angled = stash(angled)
        taken = angled.where(f"id <> pivot and angle <= {reach!r}")
        owners = taken.select(F.col("pivot").alias("id")).distinct()
        own = angled.join(owners, "id", "left_semi").select("id", "unit", F.col("id").alias("ball"), F.lit(0.0).alias("angle"))
        done.append(stash(taken.select("id", "unit", F.col("pivot").alias("ball"), "angle").unionAll(own)))
        old, free = free, stash(angled.join(done[-1].select("id"), "id", "left_anti").select("id", "unit"))
        release(coded, angled, *([old] if r else []))
    single = free.select("id", "unit", F.col("id").alias("ball"), F.lit(0.0).alias("angle"))
    balls = stash(reduce(DataFrame.unionAll, done, single))
    release(*done, *([free] if rounds else []))
    return balls


def _neighbours_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_ids, last = np.zeros(0, np.int64), None
    for b in batches:
        if not b.num_rows:
            continue
        ids, x = b.column("id").to_numpy(), _rows(b.column("unit"))
        if last is not None:
            ids, x = np.r_[last_ids, ids], np.r_[last, x]
        for step in range(1, min(NEXT + 1, len(ids))):
            sim = np.einsum("ij,ij->i", x[step:], x[:-step])
            yield batch(_PAIR, np.r_[ids[step:], ids[:-step]], np.r_[ids[:-step], ids[step:]], np.r_[sim, sim])
        last_ids, last = ids[-NEXT:], x[-NEXT:]


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, unit) with the units in single precision, in which lists are refined."""
    schema = pa.schema([("x", pa.int64()), ("unit", pa.binary())])
    for b in batches:
        if b.num_rows:
            yield batch(schema, b.column("id"), pa.array([x.tobytes() for x in _rows(b.column("unit")).astype(np.float32)], pa.binary()))


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a node's neighbours that improve the list of either side."""
    for b in batches:
        out = []
        for near in b.column("near"):
            near = near.as_py()
            ids = np.array([n["x"] for n in near])
            x = np.frombuffer(b"".join(n["unit"] for n in near), np.float32).reshape(len(ids), -1)
            sim = (x @ x.T).astype(np.float64)
            worst = np.array([n["worst"] for n in near])
            i, j = np.nonzero((sim > worst[:, None]) & (ids[:, None] != ids[None, :]))
            out.append((ids[i], ids[j], sim[i, j]))
        if out:
            yield batch(_PAIR, *(np.concatenate([o[k] for o in out]) for k in range(3)))


def _best(pairs: DataFrame, room: DataFrame) -> DataFrame:
    """Each node's list: the nearest of ``pairs``, as many as its ``room``."""
    rank = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    ranked = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("place", F.row_number().over(rank))
    return ranked.join(room, "u").where("place <= room").select("u", "v", "sim", "place", "room")


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """(ids, units, radii) of up to ``most`` of the rows that a task reads."""
    schema = pa.schema([("ids", pa.binary()), ("units", pa.binary()), ("radii", pa.binary())])

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, radii = (t.column(c).to_numpy().tobytes() for c in ("id", "radius"))
        return batch(schema, *(pa.array([x], pa.binary()) for x in (ids, b"".join(t.column("unit").to_pylist()), radii)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, most - count))
                at, count = at + held[-1].num_rows, count + held[-1].num_rows
                if count == most:
                    yield packed(held)
                    held, count = [], 0
        if count:
            yield packed(held)

    return rows.select("id", "unit", "radius").mapInArrow(run, "ids binary, units binary, radii binary")


def _exhaustive(nodes: DataFrame, wanted: DataFrame, floor: str) -> DataFrame:
    """All pairs (u, v, sim) of a node u of ``wanted`` and another node v whose
    balls are in reach of each other. Blocks of all nodes stay where they are read;
    those that are wanted come to them, ``HELD`` bytes in a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                (ids, r), (others, s) = ((np.frombuffer(row[k], np.int64), np.frombuffer(row[k + 2], np.float64)) for k in (0, 3))
                x, y = (np.frombuffer(row[k], np.float64).reshape(len(i), -1) for k, i in ((1, ids), (4, others)))
                sim = x @ y.T
                limit = np.cos(np.minimum(np.pi, float(floor) + r[:, None] + s[None, :])) - 1e-9
                i, j = np.nonzero((sim >= limit) & (ids[:, None] != others[None, :]))
                if len(i):
                    yield batch(_PAIR, ids[i], others[j], sim[i, j])

    wanted = stash(wanted.select("id", "unit", "radius"))
    size = wanted.agg(F.sum(F.length("unit") + 16)).first()[0] or 0
    passes, found = max(1, -(-size // HELD)), []
    for k in range(passes):
        # hashed as no sample is, so passes are of one size
        some = wanted.where(F.pmod(F.xxhash64("id", F.lit("pass")), F.lit(passes)) == k).coalesce(1)
        left = _blocks(some, QUERIES).toDF("ids", "units", "radii")
        right = _blocks(nodes, QUERIES).toDF("others", "other_units", "other_radii")
        found.append(stash(right.crossJoin(F.broadcast(left)).select("ids", "units", "radii", "others", "other_units", "other_radii").mapInArrow(run, "u long, v long, sim double")))
    release(wanted)
    return reduce(DataFrame.unionAll, found)


def _audit(nodes: DataFrame, total: int, floor: str, audit: int) -> tuple[DataFrame, int]:
    """(links of some nodes, found exhaustively; how many): the sample grows until
    it holds enough links to tell, all nodes are in it, or it is as large as an
    audit may be."""
    size = audit
    while True:
        some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // size))) == 0)
        truth = _exhaustive(nodes, some, floor).select("u", "v")
        due = truth.count()
        if due >= AUDIT_LINKS or size >= total or size >= AUDIT_TIMES * audit:
            return truth, due
        size *= 4


def _counts(threshold: float):
    """Links of each vector of a block of one ball into a block of another."""

    def unpacked(block: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = block.field(0).to_numpy()
        return ids, _rows(block.field(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        for batch_ in batches:
            for a, b, left, right in zip(batch_.column("a").to_pylist(), batch_.column("b").to_pylist(), batch_.column("left"), batch_.column("right"), strict=True):
                (ids, x), (_, y) = unpacked(left.values), unpacked(right.values)
                n = (x @ y.T >= threshold).sum(1)
                some = np.flatnonzero(n)
                if len(some):
                    yield batch(schema, ids[some], np.full(len(some), a), np.full(len(some), b), n[some].astype(np.int64))

    return run


def _graph(nodes: DataFrame, dim: int, centre: np.ndarray, angle: float, lists: int, rounds: int, least_rounds: int, recall: float, least_recall: float, audit: int) -> tuple[DataFrame, dict]:
    """((a, b) of balls in reach of each other, audit figures)."""
    spark = nodes.sparkSession
    total = nodes.count()
    figures = {"balls": total, "rounds": 0, "audited": 0, "recall": None, "saturated": 0}
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 256))

    def coded_pairs(seeds: range) -> DataFrame:
        start = None
        for t in seeds:
            line = _coded(nodes.select("id", "unit"), t, 32, dim, centre).repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id").drop("code")
            found = line.mapInArrow(_neighbours_in_order, "u long, v long, sim double")
            start = found if start is None else start.unionAll(found)
        return start

    # what single precision may lack in a sum of ``dim`` products is let through: links are counted in double
    in_reach = lambda sim, r1, r2: F.col(sim) >= F.cos(F.least(F.lit(np.pi), angle + F.col(r1) + F.col(r2))) - 1e-9 - dim * 2.0**-23
    single = stash(nodes.select("id", "unit").mapInArrow(_single, "x long, unit binary"))
    radius = nodes.select(F.col("id").alias("u"), F.col("radius").alias("ru"))
    other = nodes.select(F.col("id").alias("v"), F.col("radius").alias("rv"))
    graph = stash(_best(coded_pairs(range(TABLES)), nodes.select(F.col("id").alias("u"), F.lit(lists).alias("room"))))
    truth, due = _audit(nodes, total, repr(angle), audit) if total else (None, 0)
    widest = nodes.agg(F.max("radius")).first()[0] or 0.0

    def lasts(graph: DataFrame) -> DataFrame:
        """Each list's last place, and whether it is saturated."""
        last = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.max("place").alias("held"), F.max("room").alias("room")).join(radius, "u")
        full = F.col("held") >= F.col("room")
        # beyond its last entry there may be a ball as wide as the widest
        return last.select("u", "worst", "room", full.alias("full"), (full & (F.col("worst") >= F.cos(F.least(F.lit(np.pi), angle + widest + F.col("ru"))) - 1e-9)).alias("saturated"))

    for turn in range(1, rounds + 1):
        poor = figures["recall"] is not None and figures["recall"] < recall and turn > least_rounds
        grown = F.when(F.col("saturated") | F.lit(poor), F.least(F.col("room") * 2, F.greatest("room", F.lit(MOST)))).otherwise(F.col("room"))
        last = stash(lasts(graph).withColumn("grown", grown).select("u", F.when(F.col("full") & (F.col("grown") == F.col("room")), F.col("worst")).otherwise(-2.0).alias("worst"), F.col("grown").alias("room")))
        back = Window.partitionBy("w").orderBy(F.xxhash64("x", F.lit(turn)), "x")
        reverse = graph.select(F.col("v").alias("w"), F.col("u").alias("x")).withColumn("place", F.row_number().over(back))
        near = stash(graph.select(F.col("u").alias("w"), F.col("v").alias("x")).unionAll(reverse.where(f"place <= {lists}").select("w", "x")).distinct())
        own = single.join(last.select(F.col("u").alias("x"), "worst"), "x")
        before, parts_ = graph, max(1, -(-near.count() * (4 * dim + 32) // PART))
        for k in range(parts_):
            met = near if parts_ == 1 else near.where(F.pmod(F.xxhash64("w", F.lit("part")), F.lit(parts_)) == k)
            better = met.join(own, "x").groupBy("w").agg(F.collect_list(F.struct("x", "unit", "worst")).alias("near")).select("near").mapInArrow(_local_join, "u long, v long, sim double")
            if poor and not k:
                better = better.unionAll(coded_pairs(range(TABLES * turn, TABLES * (turn + 1))))
            after = stash(_best(graph.select("u", "v", "sim").unionAll(better), last.select("u", "room")))
            if k:
                release(graph)
            graph = after
        changed = graph.join(before, ["u", "v"], "left_anti").count()
        release(before, last, near)
        got = truth.join(graph.select("u", "v").unionAll(graph.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), ["u", "v"]).count() if due else 0
        more = lasts(graph).where(f"saturated and room < {MOST}").count()
        figures |= {"rounds": turn, "audited": due, "recall": got / due if due else None}
        settled = changed <= 0.002 * total * lists or turn >= least_rounds
        if (not due or figures["recall"] >= recall) and not more and settled:
            break
    if due and figures["recall"] < least_recall:
        raise RuntimeError(f"recall of the neighbour graph stayed too low: {figures}")
    rest = lasts(graph).where("saturated").select(F.col("u").alias("id"))
    figures["saturated"] = rest.count()
    pairs = graph.select("u", "v", "sim")
    if figures["saturated"]:
        pairs = pairs.unionAll(_exhaustive(nodes, nodes.join(rest, "id", "left_semi"), repr(angle)))
    close = pairs.join(radius, "u").join(other, "v").where(in_reach("sim", "ru", "rv"))
    close = stash(close.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct())
    release(graph, single)
    return close, figures


def _links(units: DataFrame, dim: int, threshold: float, **options) -> tuple[DataFrame, dict]:
    """((id, n_links, component), audit figures) of unit vectors of one length."""
    angle = float(np.arccos(threshold))
    centre = _centre(units, dim)
    balls = _balls(units, angle / 2 - 1e-9, 3, dim, centre)
    sizes = stash(balls.groupBy(F.col("ball").alias("id")).agg(F.max("angle").alias("radius"), F.count("*").alias("size"), F.min("id").alias("least")))
    nodes = stash(balls.where("id = ball").select("id", "unit").join(sizes, "id"))
    close, figures = _graph(nodes, dim, centre, angle, **options)
    of = sizes.select(F.col("id").alias("ball"), "size", "least")
    members = stash(balls.select("id", "ball", "unit").join(of, "ball"))
    release(balls, nodes)
    ways = close.unionAll(close.select(F.col("b").alias("a"), F.col("a").alias("b")))
    needed = members.join(stash(ways.select(F.col("a").alias("ball")).distinct()), "ball", "left_semi")
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))
    blocks = stash(needed.groupBy("ball", block.alias("block")).agg(F.collect_list(F.struct("id", "unit")).alias("vectors")))
    left, right = blocks.select(F.col("ball").alias("a"), F.col("vectors").alias("left")), blocks.select(F.col("ball").alias("b"), F.col("vectors").alias("right"))
    counted = stash(ways.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right").mapInArrow(_counts(threshold), "id long, a long, b long, n long"))
    release(blocks)
    across = stash(counted.groupBy("id").agg(F.sum("n").alias("across")))
    name = sizes.select("id", "least")
    pairs = counted.where("a < b").select("a", "b").distinct().join(name.select(F.col("id").alias("a"), F.col("least").alias("la")), "a").join(name.select(F.col("id").alias("b"), F.col("least").alias("lb")), "b")
    component = connected(pairs.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    out = members.select("id", "least", (F.col("size") - 1).alias("inside")).join(across, "id", "left").join(component.select(F.col("node").alias("least"), "component"), "least", "left")
    found = stash(out.select("id", (F.col("inside") + F.coalesce("across", F.lit(0))).cast("long").alias("n_links"), F.coalesce("component", "least").alias("component")))
    release(counted, members, across, close, sizes)
    return found, figures


def embedding_links(vectors: DataFrame, threshold: float = 0.9, lists: int = LIST, rounds: int = 16, least_rounds: int = 4, recall: float = 0.97, least_recall: float = 0.9, audit: int = QUERIES) -> tuple[DataFrame, dict]:
    """((id, n_links, component) of each usable vector, audit figures by length)
    of a table (vec_id, embedding)."""
    with unsized(vectors.sparkSession):
        units = vectors.select("vec_id", "embedding").mapInArrow(_units, "id long, dim int, unit binary")
        usable = stash(units.groupBy("id").agg(F.min(F.struct("dim", "unit")).alias("x")).select("id", "x.*"))
        options = {"lists": lists, "rounds": rounds, "least_rounds": least_rounds, "recall": recall, "least_recall": least_recall, "audit": audit}
        out, figures = usable.where("false").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")), {}
        for dim in sorted(r["dim"] for r in usable.groupBy("dim").count().where("count > 1").collect()):
            links, figures[dim] = _links(usable.where(f"dim = {dim}").select("id", "unit"), dim, threshold, **options)
            out = out.unionAll(links)
    return out, figures


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept, and
    recall, the audited recall of the search (of the worst length); null where the
    audit met no link, which is no measure."""
    links, figures = embedding_links(vectors, threshold, **options)
    out = vectors.select("vec_id").join(links.withColumnRenamed("id", "vec_id").hint("merge"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    recall = min((x["recall"] for x in figures.values() if x["recall"] is not None), default=None)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"), F.lit(recall).cast("double").alias("recall"))
