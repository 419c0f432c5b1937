"""Trees, linked lists and nested marks as rows, without a walk.

What an extractor lists as nodes with a parent, entries with a successor or
operations that open and close are paths: every row knows the row that it leads
to. Rows are dealt by ranges of document and node, and a stretch of up to ``CHUNK``
of them follows its own paths by pointer doubling on arrays, to where they end or
leave it. Only the rows that such paths lead to go on, as shorter lists of the same
form; nodes that are near each other have near numbers as a rule, so these are few.
Where they aren't, what is left is followed by joins, log2(n) of them for a path of
n steps. Paths that run in a circle never end: a round in which no path ends has no
other left, and the rows on these come back as unreachable.

The tour around a tree is one such path, followed back to the root: a node is
entered from its parent or after its elder sibling is left, and left after its last
child. What lies on the way, in nodes entered and left, gives a node's depth, its
place in document order and the last place below it. Nodes below another are then a
stretch of places, and sums over them are differences of running sums.

Running sums are made of stretches of ``STRETCH`` places and sums of stretches,
so no window holds a whole document. Siblings of one parent are put in order by
one window, which sorts and spills but is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..written import cut, release

STRETCH, CHUNK = 1 << 16, 1 << 20
#: Ways that leave a stretch go on by joins, if these are so few and so many steps.
FEW, STEPS = 1 << 17, 12
#: Levels of tables or lists in others that sums climb by joins.
LEVELS = 6


def _followed(rows: pa.Table, keys: list[str], own: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """A stretch of rows in order of keys and node, each followed to the last row of its
    path in here: (node, to, whether a row leads on, whether a group begins, last row,
    sums of ``own`` up to it without its own, whether the path runs in a circle)."""
    n = rows.num_rows
    column = lambda name: rows.column(name).combine_chunks()
    new = np.zeros(n, bool)
    for k in keys:
        code = column(k).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    group = np.cumsum(new)
    number = lambda name: pc.fill_null(column(name), 0).to_numpy(zero_copy_only=False)
    node, to, leads = number("node"), number("to"), column("to").is_valid().to_numpy(zero_copy_only=False)
    low, wide = int(node.min()), int(node.max()) - int(node.min()) + 1
    if (int(group[-1]) + 1) * wide < 1 << 62:
        known = (to >= low) & (to - low < wide)
        place, wanted = group * wide + (node - low), group * wide + np.where(known, to - low, 0)
    else:
        nodes, code = np.unique(node, return_inverse=True)
        at = np.minimum(np.searchsorted(nodes, to), len(nodes) - 1)
        known = nodes[at] == to
        place, wanted = group * len(nodes) + code, group * len(nodes) + at
    found = np.minimum(np.searchsorted(place, wanted), n - 1)
    here = leads & known & (place[found] == wanted)
    step = np.where(here, found, np.arange(n))
    total = [np.where(here, x, 0) for x in own]
    open_ = np.flatnonzero(here & here[step])
    for _ in range(n.bit_length() + 1):
        if not len(open_):
            break
        ahead = step[open_]
        gained, step_on = [t[ahead] for t in total], step[ahead]
        for t, g in zip(total, gained, strict=True):
            t[open_] += g
        step[open_] = step_on
        open_ = open_[here[step_on]]
    ring = column("ring").to_numpy(zero_copy_only=False).astype(bool)[step] if "ring" in rows.column_names else np.zeros(n, bool)
    ring[open_] = True
    return node, to, leads, new, step, total, ring


def _inside(rows: pa.Table, keys: list[str], sums: list[str]) -> pa.Table:
    """A stretch of rows in order of keys and node: each with the last row of its
    path in here (tail), where that leads (to) and the sums up to it."""
    column = lambda name: rows.column(name).combine_chunks()
    own = [pc.fill_null(column(s), 0).to_numpy(zero_copy_only=False).astype(np.int64) for s in sums]
    _, to, leads, _, step, total, ring = _followed(rows, keys, own)
    out = {c: rows.column(c) for c in rows.column_names}
    out["tail"], out["ring"] = column("tail").take(pa.array(step)), pa.array(ring)
    out["to"] = pa.array(to[step], mask=~leads[step] | ring)
    out |= {s: pa.array(t + x[step]) for s, t, x in zip(sums, total, own, strict=True)}
    return pa.table(out)


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, count = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            held.append(b.slice(at, most - count))
            at, count = at + held[-1].num_rows, count + held[-1].num_rows
            if count == most:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


def _stretches(keys: list[str], sums: list[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _chunks(batches, most):
            yield from _inside(rows, keys, sums).to_batches(1 << 16)

    return run


def _doubled(rows: DataFrame, keys: list[str], sums: list[str], made: list[DataFrame]) -> DataFrame:
    """``rows`` of ``_ends``, followed by joins."""
    known = rows.select(*keys, F.col("node").alias("to"), F.lit(True).alias("_known"))
    state = rows.join(known, [*keys, "to"], "left").select(*keys, "node", F.when(F.col("_known"), F.col("to")).alias("to"), "tail", "ring", *sums)
    state, before = cut(state), None
    while True:
        open_ = state.where("to is not null")
        left = open_.count()
        # on a path that ends, rows twice as far from its end come to it each round
        if left in (0, before):
            break
        before = left
        ahead = state.select(*keys, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("tail").alias("_tail"), F.col("ring").alias("_ring"), *(F.col(s).alias(f"_s_{s}") for s in sums))
        on = open_.drop("tail", "ring").join(ahead, [*keys, "to"])
        on = on.select(*keys, "node", F.col("_to").alias("to"), F.col("_tail").alias("tail"), F.col("_ring").alias("ring"), *((F.col(s) + F.col(f"_s_{s}")).alias(s) for s in sums))
        old, state = state, cut(state.where("to is null").unionByName(on))
        release(old)
    made.append(state)
    return state.select(*keys, "node", "tail", (F.col("ring") | F.col("to").isNotNull()).alias("ring"), *sums)


def _ends(rows: DataFrame, keys: list[str], sums: list[str], made: list[DataFrame], dealt: bool = False, parts: int | None = None) -> DataFrame:
    """The last row (tail) of each path, whether it runs in a circle (ring), and the
    sums on the way, both ends included. ``rows`` has keys, node, to, tail, ring,
    the sums from node to tail, and columns that are passed on; tail leads to ``to``."""
    if not dealt:
        rows = (rows.repartitionByRange(parts, *keys, "node") if parts else rows.repartitionByRange(*keys, "node")).sortWithinPartitions(*keys, "node")
    local = cut(rows.mapInArrow(_stretches(keys, sums, CHUNK), rows.schema), made)
    out = local.where("to is null").drop("to")
    due = local.where("to is not null")
    aims = cut(due.select(*keys, F.col("to").alias("node")).distinct(), made)
    if aims.isEmpty():
        return out
    heads = cut(local.join(aims, [*keys, "node"]).select(*keys, "node", "to", "tail", "ring", *sums), made)
    some = heads.count()
    if 2 * some > local.count():
        ends = _doubled(heads, keys, sums, made)
    else:
        ends = _ends(heads, keys, sums, made, parts=1 + some // CHUNK)
    ends = cut(ends, made)
    ahead = ends.select(*keys, F.col("node").alias("to"), F.col("tail").alias("_tail"), F.col("ring").alias("_ring"), *(F.col(s).alias(f"_s_{s}") for s in sums))
    more = {s: F.col(s) + F.coalesce(f"_s_{s}", F.lit(0)) for s in sums}
    joined = due.join(ahead, [*keys, "to"], "left").withColumns({"tail": F.coalesce("_tail", "tail"), "ring": F.coalesce("_ring", F.lit(False))} | more)
    return out.unionByName(joined.select(out.columns))


def follow(rows: DataFrame, keys: list[str], weights: list[str], more: tuple[str, ...] = (), dealt: bool = False, made: list[DataFrame] | None = None) -> DataFrame:
    """Where each row's path ends. ``rows`` has ``keys``, node (unique), to (the
    next node; null or unknown: the path ends here) and ``weights`` (numbers to be
    added up along the path, the node itself left out). Returns keys, node, the
    sums, end (the last node; null where the path runs in a circle) and the columns
    ``more``. ``dealt`` rows stand in ranges and in order of keys and node already;
    others are read twice. ``made`` takes note of the tables it writes."""
    kind = rows.schema["node"].dataType
    sums = [f"_u_{w}" for w in weights]
    # a null key leads nowhere
    there = F.lit(True)
    for k in keys:
        there &= F.col(k).isNotNull()
    node = F.col("node").cast("long")
    start = rows.select(*keys, node.alias("node"), F.when(there, F.col("to").cast("long")).alias("to"), node.alias("tail"), F.lit(False).alias("ring"), *(F.col(w).cast("long").alias(s) for w, s in zip(weights, sums, strict=True)), *(F.col(w).cast("long").alias(w) for w in weights), *more)
    out = _ends(start, keys, sums, [] if made is None else made, dealt)
    return out.select(*keys, F.col("node").cast(kind).alias("node"), *((F.col(s) - F.col(w)).alias(w) for w, s in zip(weights, sums, strict=True)), F.when(~F.col("ring"), F.col("tail").cast(kind)).alias("end"), *more)


def running(rows: DataFrame, keys: list[str], at: str, values: dict[str, tuple[Column, str]]) -> DataFrame:
    """``rows`` with running sums, minima or maxima along the whole numbers ``at``:
    name -> (value, "sum", "min" or "max"), the row itself included."""
    how = {"sum": (F.sum, lambda a, b: a + b, 0), "min": (F.min, F.least, None), "max": (F.max, F.greatest, None)}
    part = F.floor(F.col(at) / STRETCH).alias("_part")
    marked = rows.select("*", part, *(v.alias(f"_v_{n}") for n, (v, _) in values.items()))
    inside = Window.partitionBy(*keys, "_part").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.groupBy(*keys, "_part").agg(*(how[h][0](f"_v_{n}").alias(f"_p_{n}") for n, (_, h) in values.items()))
    parts = parts.select(*keys, "_part", *(how[h][0](f"_p_{n}").over(before).alias(f"_b_{n}") for n, (_, h) in values.items()))
    out = marked.join(parts, [*keys, "_part"])
    total = {}
    for n, (_, h) in values.items():
        own, carried = how[h][0](f"_v_{n}").over(inside), F.col(f"_b_{n}")
        total[n] = F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0)) if h == "sum" else how[h][1](own, carried)
    return out.withColumns(total).select(*rows.columns, *values)


def _toured(nodes: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(doc_id, node, parent, root, depth, place, last) of nodes with a parent, the
    sibling before them and their last child, in ranges of document and node; all
    but the first three are null for nodes that no root reaches. Entering a node is
    number 2 * node of the tour, leaving it 2 * node + 1."""
    twice = lambda name, more: F.col(name) * 2 + more
    number, one, none = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(None).cast("long")
    enter = F.struct(twice("node", 0).alias("node"), F.coalesce(twice("before", 1), twice("parent", 0)).alias("to"), one.alias("entered"), number.alias("left"), F.col("parent").alias("parent"))
    leave = F.struct(twice("node", 1).alias("node"), F.coalesce(twice("child", 1), twice("node", 0)).alias("to"), number.alias("entered"), one.alias("left"), none.alias("parent"))
    # both stand where the node did
    steps = nodes.sortWithinPartitions("doc_id", "node").select("doc_id", F.inline(F.array(enter, leave)))
    tour = follow(steps, ["doc_id"], ["entered", "left"], ("parent",), dealt=True, made=made)
    entering = F.col("node").bitwiseAND(1) == 0
    at = lambda name, side=entering: F.max(F.when(side, F.col(name))).alias(name)
    sides = tour.groupBy("doc_id", F.shiftright("node", 1).alias("node")).agg(F.max("parent").alias("parent"), at("end"), at("entered"), at("left"), F.max(F.when(~entering, F.col("entered"))).alias("_last"))
    here = F.col("end").isNotNull()
    facts = {"root": F.shiftright("end", 1), "depth": F.col("entered") - F.col("left"), "place": F.col("entered"), "last": F.col("_last") - 1}
    return sides.select("doc_id", "node", "parent", *(F.when(here, x).alias(n) for n, x in facts.items()))


def tree_places(listed: DataFrame) -> DataFrame:
    """Trees in document order: (doc_id, node, parent, root, depth, place, last) of
    rows (doc_id, node, parent, place), where place orders the children of a parent;
    they are read several times.
    Places count from 0 in each tree; ``last`` is that of the last node below.

    A node that several parents list belongs to the first of them, by their number
    and place, that a root reaches: no node that can be reached is lost. Nodes of a
    circle, and below one, have nulls. A parent that isn't listed itself is none."""
    listed, made = listed.select("doc_id", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.col("place").alias("_order")), []
    first = F.struct(F.col("parent").isNotNull().alias("_inner"), "parent", "_order")
    chosen = listed.repartitionByRange("doc_id", "node").groupBy("doc_id", "node").agg(F.min(first).alias("_at"), F.count("*").alias("_times"))
    chosen = chosen.select("doc_id", "node", F.col("_at.parent").alias("to"), F.col("_at._order").alias("_order"), "_times", F.lit(1).alias("steps")).sortWithinPartitions("doc_id", "node")
    up = lambda rows, dealt: follow(rows.withColumn("_to", F.col("to")), ["doc_id"], ["steps"], ("_to", "_order", "_times"), dealt, made)
    reached = up(chosen, True)
    while True:
        # only a node that is listed again can have another parent
        lost = reached.where("end is null and _times > 1").select("doc_id", "node")
        if lost.isEmpty():
            break
        found = reached.where("end is not null").select("doc_id", F.col("node").alias("parent"))
        other = listed.join(lost, ["doc_id", "node"]).join(found, ["doc_id", "parent"]).groupBy("doc_id", "node").agg(F.min(F.struct("parent", "_order")).alias("_new"))
        other = cut(other, made)
        if other.isEmpty():
            break
        chosen = reached.join(other, ["doc_id", "node"], "left").select("doc_id", "node", F.coalesce("_new.parent", "_to").alias("to"), F.coalesce("_new._order", "_order").alias("_order"), "_times", F.lit(1).alias("steps"))
        reached = up(cut(chosen, made), False)
    # where no step could be taken the parent isn't there
    parent = F.when(F.col("end").isNull() | (F.col("steps") > 0), F.col("_to"))
    nodes = reached.select("doc_id", "node", parent.alias("parent"), "_order")
    siblings = Window.partitionBy("doc_id", "parent", F.when(F.col("parent").isNull(), F.col("node"))).orderBy("_order", "node")
    inner = F.col("parent").isNotNull()
    nodes = nodes.select("doc_id", "node", "parent", F.when(inner, F.lag("node").over(siblings)).alias("before"), (inner & F.lead("node").over(siblings).isNull()).alias("_last"))
    old, made = made, []
    nodes = cut(nodes, made)
    release(*old)
    none = F.lit(None).cast("long")
    last = nodes.where("_last").select("doc_id", F.col("parent").alias("node"), none.alias("parent"), none.alias("before"), F.col("node").alias("child"))
    both = nodes.select("doc_id", "node", "parent", "before", none.alias("child")).unionAll(last).repartitionByRange("doc_id", "node")
    out = cut(_toured(both.groupBy("doc_id", "node").agg(*(F.max(c).alias(c) for c in ("parent", "before", "child"))), made))
    release(*made)
    return out


def document_depth(places: DataFrame, most: int = 50) -> DataFrame:
    """(doc_id, depth): levels below the root, as far as they are measured."""
    return places.where("root is not null").groupBy("doc_id").agg(F.least(F.max("depth"), F.lit(most)).cast("int").alias("depth"))


def headings_in_order(places: DataFrame, tags: DataFrame, roles: DataFrame, most: int = 200) -> DataFrame:
    """(doc_id, place, level, tag) of headings, by place in the document. ``tags``
    has doc_id, node, tag; ``roles`` maps tags of a document to standard ones."""
    named = tags.join(roles.select("doc_id", "tag", "role"), ["doc_id", "tag"], "left").withColumn("level", F.coalesce("role", "tag")).where(F.col("level").rlike("^H[1-6]?$"))
    inside = places.where((F.col("depth") <= most) & F.col("root").isNotNull())
    return inside.join(named, ["doc_id", "node"]).select("doc_id", "place", "level", "tag")


def outline_places(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Outlines of linked entries: (doc_id, node, depth, place) of the entries that
    the document's first one leads to. ``entries`` has doc_id, node, first (its
    first child), next (its next sibling); ``roots`` has doc_id, first. Entries
    that are named twice count where they are a first child, else after the entry
    of smaller number; a successor that leads back into its own list is dropped."""
    top = roots.select("doc_id", F.lit(-1).cast("long").alias("node"), "first", F.lit(None).cast("long").alias("next"))
    every = entries.select("doc_id", "node", "first", "next").unionByName(top)
    heads = every.where("first is not null").groupBy("doc_id", F.col("first").alias("node")).agg(F.min("node").alias("owner"))
    named = every.where("next is not null").groupBy("doc_id", F.col("next").alias("node")).agg(F.min("node").alias("before"))
    # each entry's list leads back to its head, and so to its owner
    known, made = every.select("doc_id", "node"), []
    back = cut(known.join(heads, ["doc_id", "node"], "left").join(named, ["doc_id", "node"], "left").withColumn("before", F.when(F.col("owner").isNull(), F.col("before"))), made)
    lists = follow(back.select("doc_id", "node", F.col("before").alias("to"), "before", F.lit(1).alias("steps")), ["doc_id"], ["steps"], ("before",), made=made)
    owners = back.where("owner is not null").select("doc_id", F.col("node").alias("end"), "owner")
    owned = cut(lists.join(owners, ["doc_id", "end"], "left").select("doc_id", "node", F.col("owner").alias("parent"), "before", "steps"), made)
    last = owned.where("parent is not null").groupBy("doc_id", F.col("parent").alias("node")).agg(F.max_by("node", "steps").alias("child"))
    none = F.lit(None).cast("long")
    both = owned.select("doc_id", "node", "parent", "before", none.alias("child")).unionAll(last.select("doc_id", "node", none, none, "child"))
    found = cut(_toured(both.repartitionByRange("doc_id", "node").groupBy("doc_id", "node").agg(*(F.max(c).alias(c) for c in ("parent", "before", "child"))), made))
    release(*made)
    return found.where("root = -1 and node <> -1").select("doc_id", "node", (F.col("depth") - 1).alias("depth"), (F.col("place") - 1).alias("place"))


def outline_titles(places: DataFrame, titles: DataFrame, most: int = 50) -> DataFrame:
    """(doc_id, entries, titles): how many entries an outline has, and its first
    titles, indented by two blanks a level; entries without a title have none."""
    named = places.join(titles.select("doc_id", "node", "title"), ["doc_id", "node"], "left")
    title = F.when(F.coalesce("title", F.lit("")) != "", F.struct("place", F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int")), "title").alias("title")))
    counted = named.groupBy("doc_id").agg(F.count("*").alias("entries"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))
    first = named.withColumn("_t", title).where("_t is not null").withColumn("_n", rank).where(F.col("_n") <= most)
    lists = first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("_t")), lambda t: t["title"]).alias("titles"))
    return counted.join(lists, "doc_id", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def matched(marks: DataFrame, keys: list[str]) -> DataFrame:
    """``marks`` (keys, ord, step: 1 opens, -1 closes) with level and partner: the
    ``ord`` of the other end. Brackets are matched without a stack: opening and
    closing marks of one level take turns. A mark that closes nothing has level 0
    and no partner, one that is never closed has none."""
    summed = running(marks, keys, "ord", {"_sum": (F.col("step"), "sum")})
    before = F.col("_sum") - F.col("step")
    low = running(summed, keys, "ord", {"_low": (before, "min")})
    # how many are open before a mark; sums fall below the lowest where none was
    depth = before - F.col("_low")
    levels = low.withColumn("level", F.when(F.col("step") == 1, depth + 1).otherwise(depth))
    turns = Window.partitionBy(*keys, "level").orderBy("ord")
    other = F.when(F.col("level") > 0, F.when(F.col("step") == 1, F.lead("ord").over(turns)).otherwise(F.lag("ord").over(turns)))
    return levels.withColumn("partner", other).drop("_sum", "_low")


def restored(events: DataFrame, keys: list[str], states: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``events`` (keys, ord, step: 1 saves, -1 restores, 0 neither) with states: name
    -> (setter, value), the value that was set last, where a restoring event brings
    back what held at the saving one it belongs to. Every event takes a state from an
    earlier one: a setter has its own, a restoring event that of its partner, all
    others that of the event before; such paths are followed to their setters. All
    states share the matching of events and the running sums."""
    marked = events.withColumns({f"_sets_{n}": F.coalesce(setter, F.lit(False)) for n, (setter, _) in states.items()} | {f"_value_{n}": value for n, (_, value) in states.items()})
    pairs = matched(events.where("step <> 0").select(*keys, "ord", "step"), keys).where("step = -1 and partner is not null").select(*keys, "ord", "partner")
    turns = {n: F.col(f"_sets_{n}") | F.col("partner").isNotNull() for n in states}
    out = placed = cut(running(marked.join(pairs, [*keys, "ord"], "left"), keys, "ord", {f"_last_{n}": (F.when(turns[n], F.col("ord")), "max") for n in states}))
    for n in states:
        sets, last = F.col(f"_sets_{n}"), f"_last_{n}"
        # only events that set or restore are steps of a path
        lasts = placed.select(*keys, F.col("ord").alias("partner"), F.col(last).alias("_held"))
        steps = placed.where(turns[n]).select(*keys, "ord", "partner", sets).join(lasts, [*keys, "partner"], "left")
        steps = steps.select(*keys, F.col("ord").alias("node"), F.when(~sets, F.coalesce("_held", F.lit(-1))).alias("to"), F.lit(1).alias("steps"))
        paths = follow(steps, keys, ["steps"])
        # a path that ends at a restoring event leads to before the first setter
        values = placed.where(sets).select(*keys, F.col("ord").alias("end"), F.col(f"_value_{n}").alias(n))
        held = paths.join(values, [*keys, "end"], "left").select(*keys, F.col("node").alias(last), n)
        out = out.join(held, [*keys, last], "left")
    return out.select(*events.columns, *states)


def marked_texts(items: DataFrame) -> DataFrame:
    """(doc_id, id, text): the text of each mark, to the innermost one that has an
    id. ``items`` has doc_id, ord, kind (begin, end, text), id, text, line_end; a
    line's end counts as a blank."""
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    opens = (F.col("kind") == "begin") & (F.coalesce("id", F.lit("")) != "")
    # an opening mark's own state is what an end brings back only to marks inside
    events = items.withColumn("step", step)
    inner = _innermost(events, opens)
    piece = F.concat("text", F.when(F.col("line_end"), F.lit(" ")).otherwise(F.lit("")))
    texts = inner.where((F.col("kind") == "text") & F.col("text").isNotNull() & ((F.col("text") != "") | F.col("line_end")) & F.col("state").isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", piece.alias("t")))), lambda x: x["t"]), "")
    return texts.groupBy("doc_id", F.col("state").alias("id")).agg(joined.alias("text"))


def _innermost(events: DataFrame, opens: Column) -> DataFrame:
    """``events`` with state, the id of the innermost open mark with one: an opening
    mark saves what held before it, and sets its own; so it is two events."""
    saved = events.withColumns({"ord": F.col("ord") * 2, "_sets": F.lit(False)})
    sets = events.where(opens).withColumns({"ord": F.col("ord") * 2 + 1, "step": F.lit(0), "_sets": F.lit(True)})
    both = saved.unionByName(sets)
    return restored(both, ["doc_id"], {"state": (F.col("_sets"), F.col("id"))}).where("ord % 2 = 0").withColumn("ord", F.floor(F.col("ord") / 2)).drop("_sets")


def visible_fonts(operations: DataFrame) -> DataFrame:
    """(doc_id, fonts, unresolved): fonts of text that can be seen, by name, and
    whether some such text has none. ``operations`` has doc_id, page, ord, op (font,
    mode, save, restore, show), font, mode, text; saving and restoring a page's
    state brings both font and rendering mode back, mode 3 can't be seen."""
    keys = ["doc_id", "page"]
    step = F.when(F.col("op") == "save", 1).when(F.col("op") == "restore", -1).otherwise(0)
    events = operations.withColumn("step", step)
    states = restored(events, keys, {"_font": (F.col("op") == "font", F.col("font")), "_mode": ((F.col("op") == "mode") & F.col("mode").isNotNull(), F.col("mode"))})
    shown = states.where((F.col("op") == "show") & (F.coalesce("_mode", F.lit(0)) != 3) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return shown.groupBy("doc_id").agg(F.array_sort(F.collect_set("_font")).alias("fonts"), F.max(F.col("_font").isNull()).alias("unresolved"))


def within_steps(starts: DataFrame, edges: DataFrame, most: int, made: list[DataFrame] | None = None) -> DataFrame:
    """(doc_id, start, node, steps): what each start reaches in up to ``most``
    steps, and by how few, itself included. A node is opened once for each start.
    ``starts`` has doc_id, start, node; ``edges`` has doc_id, source, target."""
    made = [] if made is None else made
    seen = frontier = cut(starts.select("doc_id", "start", "node", F.lit(0).alias("steps")).distinct(), made)
    edges = cut(edges.select("doc_id", F.col("source").alias("node"), "target").distinct(), made)
    for n in range(1, most + 1):
        ahead = frontier.join(edges, ["doc_id", "node"]).select("doc_id", "start", F.col("target").alias("node")).distinct()
        frontier = cut(ahead.join(seen, ["doc_id", "start", "node"], "left_anti").withColumn("steps", F.lit(n)), made)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def live_fonts(objects: DataFrame, values: DataFrame, most: int = 12) -> DataFrame:
    """(doc_id, descriptor, names): font descriptors that a font of some resource
    dictionary uses, with the base names of these fonts. ``values`` lists what
    stands inside what (doc_id, source, key, target), ``objects`` are the places a
    search starts at (doc_id, node); fonts stand under the key Font up to ``most``
    levels inside an object, a composite font's descriptor under its descendant."""
    inside = values.where("key not in ('Font', 'entry', 'DescendantFonts', 'FontDescriptor', 'BaseFont')")
    # it doesn't matter which object leads there: all are one start
    held = within_steps(objects.select("doc_id", F.lit(0).alias("start"), "node"), inside, most)
    via = lambda rows, key, name: rows.join(values.where(F.col("key") == key).select("doc_id", F.col("source").alias("node"), F.col("target").alias(name)), ["doc_id", "node"])
    dictionaries = via(held.select("doc_id", "node").distinct(), "Font", "dictionary").select("doc_id", F.col("dictionary").alias("node")).distinct()
    fonts = via(dictionaries, "entry", "font").select("doc_id", F.col("font").alias("node")).distinct()
    own = fonts.select("doc_id", "node", F.col("node").alias("font"))
    below = via(fonts, "DescendantFonts", "part").select("doc_id", F.col("part").alias("node"), F.col("node").alias("font"))
    users = via(own.unionByName(below).distinct(), "FontDescriptor", "descriptor")
    names = values.where("key = 'BaseFont'").select("doc_id", F.col("source").alias("of"), F.col("target").alias("name"))
    of = users.select("doc_id", "descriptor", F.explode(F.array("font", "node")).alias("of")).distinct()
    named = of.join(names, ["doc_id", "of"], "left")
    return named.groupBy("doc_id", "descriptor").agg(F.array_sort(F.collect_set("name")).alias("names"))


def subtree_sums(places: DataFrame, values: dict[str, Column], only: Column | None = None, made: list[DataFrame] | None = None) -> DataFrame:
    """``places`` with sums over each node and all below it: a node's stretch of
    places holds them, so each is a difference of running sums. ``only`` says
    which nodes' sums are wanted."""
    there = places.where("root is not null")
    keys = ["doc_id", "root"]
    summed = cut(running(there, keys, "place", {n: (v, "sum") for n, v in values.items()}), made)
    ends = summed.select(*keys, F.col("place").alias("last"), *(F.col(n).alias(f"_e_{n}") for n in values))
    own = {n: F.col(f"_e_{n}") - F.col(n) + v for n, v in values.items()}
    wanted = summed if only is None else summed.where(only)
    return wanted.join(ends, [*keys, "last"]).withColumns(own).drop(*(f"_e_{n}" for n in values))


def covered(places: DataFrame, covers: Column) -> DataFrame:
    """``places`` with covered: whether a node above covers what is in it. A node
    is below an earlier one whose stretch hasn't ended, so the furthest end of the
    covering nodes before it tells."""
    there, keys = places.where("root is not null"), ["doc_id", "root", "place"]
    # a node's own stretch covers what is in it, not itself
    ends = there.select("doc_id", "root", (F.col("place") + 1).alias("place"), F.when(covers, F.col("last")).alias("_last"))
    far = running(ends, ["doc_id", "root"], "place", {"_far": (F.col("_last"), "max")}).drop("_last")
    return there.join(far, keys, "left").withColumn("covered", F.coalesce(F.col("_far") >= F.col("place"), F.lit(False))).select(*places.columns, "covered")


_ITEM = "struct<what:bigint,span:bigint,node:bigint,parent:bigint,place:bigint>"
_HELD = f"top bigint, to bigint, up bigint, steps bigint, lost boolean, again boolean, items array<{_ITEM}>"


def _held(most: int):
    """What each stop of a stretch holds of the elements in here. Rows are in order of
    document and node; those of an element are numbered 2 * node + 1, and a stop has
    another one before, 2 * node, that leads to its parent."""
    fields = ("what", "span", "node", "parent", "place")

    def gathered(rows: pa.Table, before: tuple | None) -> pa.Table:
        n, docs = rows.num_rows, rows.column("doc_id").combine_chunks()
        node, to, leads, new, step, (steps,), ring = _followed(rows, ["doc_id"], [np.ones(n, np.int64)])
        stop = rows.column("stop").to_numpy().astype(bool)
        start, end = stop & (node & 1 == 0), stop & (node & 1 == 1)
        number = {f: node >> 1 if f == "node" else pc.fill_null(rows.column(f), 0).to_numpy() for f in fields}
        # numbers rise unless one was there before
        again = bool(((node[1:] <= node[:-1]) & ~new[1:]).any()) or before is not None and before[0] == docs[0].as_py() and bool(node[0] <= before[1])
        # a stretch has all numbers from its first to its last row: what would stand
        # between them and isn't here is nowhere
        group, onto = np.cumsum(new), to[step]
        nowhere = ((group > group[0]) | (onto > node[0])) & ((group < group[-1]) | (onto < node[-1]))
        due = leads[step] & ~nowhere & ~ring
        ended = ~due & ~ring
        wanted = (number["what"] != 0) & ~stop
        items, starts = np.flatnonzero(wanted & ended & end[step]), np.flatnonzero(start)
        slots = np.union1d(step[items], starts + 1)
        of, at = np.searchsorted(slots, step[items]), np.searchsorted(slots, starts + 1)
        order, size = items[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(slots))
        far = np.flatnonzero(wanted & due)
        at_row = np.r_[np.minimum(slots, n - 1), far]
        k, m = len(slots), len(far)
        onward, up, far_up = (np.zeros(k + m, np.int64) for _ in range(3))
        has, has_up, lost = (np.zeros(k + m, bool) for _ in range(3))
        onward[at], has[at], lost[at] = to[step[starts]], due[starts], ring[starts]
        onward[k:], has[k:] = to[step[far]], True
        up[at], has_up[at] = node[step[starts]] >> 1, ended[starts] & end[step[starts]]
        far_up[at] = steps[starts] + due[starts]
        taken = np.r_[order, far]
        values = pa.StructArray.from_arrays([pa.array(number[f][taken].astype(np.int64)) for f in fields], list(fields))
        offsets = np.r_[0, np.cumsum(np.r_[size, np.ones(m, np.int64)])]
        if not k + m:
            # nothing to say but whether something came again
            size, at_row, onward, has, up, has_up, far_up, lost = (np.zeros(1, t) for t in (np.int64, np.int64, np.int64, bool, np.int64, bool, np.int64, bool))
            offsets = np.zeros(2, np.int64)
        return pa.table({
            "doc_id": docs.take(pa.array(at_row)), "top": pa.array(node[at_row] >> 1, mask=np.arange(len(at_row)) >= k), "to": pa.array(onward >> 1, mask=~has), "up": pa.array(up, mask=~has_up), "steps": pa.array(far_up), "lost": pa.array(lost),
            "again": pa.array(np.full(len(at_row), again)), "items": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for rows in _chunks(batches, most):
            yield from gathered(rows, before).to_batches(1 << 14)
            before = (rows.column("doc_id")[-1].as_py(), rows.column("node")[-1].as_py())

    return run


def _gathered(tree: DataFrame, elements: DataFrame | None, columns: list[str], stop: Column, what: Column, span: Column, made: list[DataFrame]) -> DataFrame:
    """(doc_id, node, up, steps, lost, items) of the elements that ``stop`` names: the next
    such one above and how many levels it is away, whether no root reaches it, and the
    elements below it that have a ``what`` other than 0 and no stop between: what, span,
    node, parent, place. ``tree`` has places and ``elements`` their columns, or ``tree``
    lists elements with parent and place, not placed yet.

    A stretch of near elements gathers what it can; ways that leave it are few as a
    rule and go on by joins, a step each, and where they aren't or are long, all
    elements' ways are followed."""
    base = ["doc_id", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), F.col("place").cast("long").alias("place")]
    rows = tree if elements is None else tree.where("root is not null").join(elements.select("doc_id", "node", *columns), ["doc_id", "node"])
    rows = rows.where("doc_id is not null and node is not null").select(*base, *columns)
    stops = F.coalesce(stop, F.lit(False))
    slim = rows.select("doc_id", "node", "parent", "place", stops.alias("stop"), F.coalesce(what, F.lit(0)).cast("long").alias("what"), span.cast("long").alias("span"))
    dealt = slim.repartitionByRange("doc_id", "node").sortWithinPartitions("doc_id", "node")
    half = dealt.withColumn("_half", F.explode(F.array(F.lit(0), F.lit(1)))).where("stop or _half = 1")
    steps = half.select("doc_id", (F.col("node") * 2 + F.col("_half")).alias("node"), F.when(~F.col("stop") | (F.col("_half") == 0), F.col("parent") * 2 + 1).alias("to"), "stop", "what", "span", "parent", "place")
    parts = cut(steps.mapInArrow(_held(CHUNK), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_HELD}"), made)
    if not parts.where("again").isEmpty():
        # which parent counts depends on what a root reaches
        places = tree_places(rows)
        made.append(places)
        return _gathered(places, rows.dropDuplicates(["doc_id", "node"]).select("doc_id", "node", *columns), columns, stop, what, span, made)
    due = parts.where("to is not null").select("doc_id", "to").distinct()
    known = slim.select("doc_id", "node", "parent", "stop")
    found, open_ = [], cut(due.select("doc_id", F.col("to").alias("from"), "to"), made)
    for taken in range(STEPS):
        left = open_.count()
        if not left or left > FEW:
            break
        met = known.join(F.broadcast(open_.select(F.col("doc_id").alias("_doc"), "from", "to")), (F.col("doc_id") == F.col("_doc")) & (F.col("node") == F.col("to")))
        met = cut(met.select("doc_id", "from", "node", "parent", "stop"), made)
        found.append(met.where("stop").select("doc_id", "from", F.col("node").alias("end"), F.lit(taken).cast("long").alias("on"), F.lit(False).alias("ring")))
        # a parent that isn't listed is none: what leads to it has ended
        open_ = met.where("not stop and parent is not null").select("doc_id", "from", F.col("parent").alias("to"))
    if not open_.isEmpty():
        taken = len(found)
        steps = known.select("doc_id", "node", F.when(~F.col("stop"), F.col("parent")).alias("to"), F.lit(1).alias("on"), F.col("stop").cast("int").alias("at"), "stop")
        ways = follow(steps, ["doc_id"], ["on", "at"], ("stop",), made=made).where("end is null or stop or at = 1")
        ways = ways.select("doc_id", F.col("node").alias("to"), "end", (F.col("on") + taken).alias("on"), F.col("end").isNull().alias("ring"))
        found.append(open_.join(ways, ["doc_id", "to"]).select("doc_id", "from", "end", "on", "ring"))
    top, up, steps, lost = F.col("top"), F.col("up"), F.col("steps"), F.col("lost")
    if found:
        ends = cut(reduce(DataFrame.unionByName, found), made).withColumnRenamed("from", "to")
        parts = parts.join(ends, ["doc_id", "to"], "left")
        up, steps, lost = F.coalesce(up, F.when(top.isNotNull(), F.col("end"))), steps + F.coalesce("on", F.lit(0)), lost | (top.isNotNull() & F.coalesce("ring", F.lit(False)))
        top = F.coalesce(top, "end")
    parts = parts.select("doc_id", top.alias("node"), up.alias("up"), F.when(up.isNotNull(), steps).alias("steps"), lost.alias("lost"), "items").where("node is not null")
    return parts.groupBy("doc_id", "node").agg(*(F.max(x).alias(x) for x in ("up", "steps", "lost")), F.flatten(F.collect_list("items")).alias("items"))


def _nested_sums(tops: DataFrame, values: list[str], made: list[DataFrame]) -> DataFrame:
    """``tops`` (doc_id, node, up: the next one above, lost: no root reaches it) with
    sums of ``values`` over each and all below it, without those that no root reaches.
    Each goes up to all above it, a join for each level; where they stand deeper than
    ``LEVELS``, or in circles, those that aren't alone are put in document order."""
    slim = tops.select("doc_id", F.col("node").alias("_at"), F.col("up").alias("_next"), F.col("lost").alias("_lost"))
    below = tops.where("up is not null").select("doc_id", "node", F.col("up").alias("_at"), *values)
    gains, gone = [], [tops.where("lost").select("doc_id", "node")]
    for _ in range(LEVELS):
        met = cut(below.join(slim, ["doc_id", "_at"]), made)
        gains.append(met.select("doc_id", F.col("_at").alias("node"), *(F.col(v).alias(f"_{v}") for v in values)))
        gone.append(met.where("_lost").select("doc_id", "node"))
        below = met.where("_next is not null").select("doc_id", "node", F.col("_next").alias("_at"), *values)
        if below.isEmpty():
            gained = reduce(DataFrame.unionByName, gains).groupBy("doc_id", "node").agg(*(F.sum(f"_{v}").alias(f"_{v}") for v in values))
            here = tops.join(reduce(DataFrame.unionByName, gone).distinct(), ["doc_id", "node"], "left_anti")
            return here.join(gained, ["doc_id", "node"], "left").withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).select(tops.columns)
    above = tops.where("up is not null").select("doc_id", F.col("up").alias("node"), F.lit(True).alias("_above")).distinct()
    some = tops.join(above, ["doc_id", "node"], "left").where("up is not null or lost or _above")
    # what is lost hangs on itself
    some = cut(some.select("doc_id", "node", F.when(F.col("lost"), F.col("node")).otherwise(F.col("up")).alias("parent"), *values), made)
    places = tree_places(some.select("doc_id", "node", "parent", F.col("node").alias("place")))
    made.append(places)
    sums = subtree_sums(places.join(some.select("doc_id", "node", *values), ["doc_id", "node"]), {f"_{v}": F.col(v) for v in values}, made=made)
    both = tops.join(sums.select("doc_id", "node", F.lit(True).alias("_in"), *(f"_{v}" for v in values)), ["doc_id", "node"], "left")
    return both.where("_in or (up is null and not lost)").withColumns({v: F.coalesce(f"_{v}", v) for v in values}).select(tops.columns)


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(row that an item stands in, its fields) of the items of a batch."""
    items = b.column("items")
    values = items.flatten()
    of = np.repeat(np.arange(b.num_rows), items.value_lengths().to_numpy(zero_copy_only=False))
    return of, {f.name: values.field(f.name).to_numpy(zero_copy_only=False) for f in values.type}


def _at(of: np.ndarray, node: np.ndarray, by: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``node`` of the row ``of`` is the ``wanted`` one of the row ``by``; -1: nowhere."""
    if not len(node) or not len(wanted):
        return np.full(len(wanted), -1)
    known = np.unique(node)
    code = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    key, aim = of * len(known) + np.searchsorted(known, node), by * len(known) + code
    order = np.argsort(key)
    at = order[np.minimum(np.searchsorted(key[order], aim), len(order) - 1)]
    return np.where((known[code] == wanted) & (key[at] == aim), at, -1)


_ROW, _SECTION, _TH, _TD, _CAPTION = 1, 2, 3, 4, 5


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each table, and how many columns its rows have. A cell is in as many
    rows as it spans: it comes in one and is gone after the last."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        table, (of, x) = b.column("node").to_numpy(), _flat(b)
        kind = x["what"] & 7
        count = lambda test: pa.array(np.bincount(of[test], minlength=n))
        counts = [count(kind == _TH), count((kind == _TH) & (x["what"] & 8 > 0)), count(kind == _TD), count((kind == _TD) & (x["what"] & 16 > 0)), count(kind == _CAPTION), pa.array(np.ones(n, np.int64))]
        part = np.flatnonzero((kind == _SECTION) & (x["parent"] == table[of]))
        line = np.flatnonzero(kind == _ROW)
        # a row is the table's or a section's child, and stands where that one does
        inside, direct = _at(of[part], x["node"][part], of[line], x["parent"][line]), x["parent"][line] == table[of[line]]
        good = direct | (inside >= 0)
        line, inside, direct = line[good], inside[good], direct[good]
        head = line.copy()
        head[~direct] = part[inside[~direct]]
        order = np.lexsort((x["node"][line], x["place"][line], x["node"][head], x["place"][head], of[line]))
        line = line[order]
        size = np.bincount(of[line], minlength=n)
        first = np.r_[0, np.cumsum(size)]
        cells = np.flatnonzero((kind == _TH) | (kind == _TD))
        at = _at(of[line], x["node"][line], of[cells], x["parent"][cells])
        cells, at = cells[at >= 0], at[at >= 0]
        # a table has a place more than rows, where its last cells are gone
        width = np.zeros(len(line) + n, np.int64)
        np.add.at(width, at + of[cells], x["what"][cells] >> 5)
        np.subtract.at(width, np.minimum(at + x["span"][cells], first[1:][of[cells]]) + of[cells], x["what"][cells] >> 5)
        width = np.delete(np.cumsum(width), first[1:] + np.arange(n))
        some, same = np.flatnonzero(size), np.zeros(n, bool)
        if len(some):
            same[some] = np.minimum.reduceat(width, first[some]) == np.maximum.reduceat(width, first[some])
        kept = [b.column(c) for c in ("doc_id", "node", "up", "lost")]
        yield pa.RecordBatch.from_arrays([*kept, *counts, pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(width.astype(np.int32))), pa.array(same, mask=size == 0)],
            names=["doc_id", "node", "up", "lost", *_TABLE_SUMS, "rows", "columnCounts", "same"])


_TABLE_SUMS = ["heads", "scoped", "data", "associated", "captions", "tables"]


def table_facts(tree: DataFrame, elements: DataFrame | None = None) -> DataFrame:
    """What each table of a structure tree is made of: (doc_id, node) with the
    fields of ``schemas.TABLE`` but one, and its cell counts. ``elements`` has
    doc_id, node, tag (a standard one), scope, headers (whether a cell has them),
    col_span, row_span; ``tree`` has their places. Without ``elements``, ``tree`` lists
    them with parent and place, a whole number that orders the children of a parent.
    Cells, captions and inner tables count wherever they stand below a table; rows
    are its children, or those of its sections.

    Each table gathers the elements below it that stand in no inner one, as one row;
    sums then climb from table to table."""
    made: list[DataFrame] = []
    tag = F.col("tag")
    flag = lambda name, bit: F.when(F.coalesce(F.col(name), F.lit(False)), bit).otherwise(0)
    width = lambda name: F.greatest(F.lit(1), F.coalesce(F.col(name), F.lit(1))).cast("long")
    cell = flag("scope", 8) + flag("headers", 16) + width("col_span") * 32
    what = F.when(tag == "TR", _ROW).when(tag.isin("THead", "TBody", "TFoot"), _SECTION).when(tag == "TH", cell + _TH).when(tag == "TD", cell + _TD).when(tag == "Caption", _CAPTION)
    held = _gathered(tree, elements, ["tag", "scope", "headers", "col_span", "row_span"], tag == "Table", what, width("row_span"), made)
    kind = held.schema["doc_id"].dataType.simpleString()
    tops = cut(held.mapInArrow(_tables, f"doc_id {kind}, node long, up long, lost boolean, {', '.join(f'{x} long' for x in _TABLE_SUMS)}, rows int, columnCounts array<int>, same boolean"))
    release(*made)
    made.clear()
    out = cut(_nested_sums(tops, _TABLE_SUMS, made))
    release(tops, *made)
    return out.select(
        "doc_id", "node", (F.col("heads") > 0).alias("hasHeaders"), F.col("heads").cast("int").alias("headerCount"), F.col("data").cast("int").alias("dataCellCount"),
        ((F.col("heads") > 0) & (F.col("heads") == F.col("scoped"))).alias("hasScope"), (F.col("heads") - F.col("scoped")).cast("int").alias("scopeMissingCount"),
        (F.col("rows") > 0).alias("hasRowStructure"), F.col("rows").alias("rowCount"), (F.col("tables") > 1).alias("hasNestedTable"), (F.col("captions") > 0).alias("hasCaption"),
        F.col("same").alias("hasConsistentColumns"), "columnCounts", (F.col("associated") > 0).alias("hasHeaderAssociation"),
    )


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of each list, and how many of them have labels and bodies."""
    for b in batches:
        n, (of, x) = b.num_rows, _flat(b)
        item = np.flatnonzero(x["what"] == 1)
        sums = [np.bincount(of[item], minlength=n)]
        for kind in (2, 3):
            part = np.flatnonzero(x["what"] == kind)
            at = np.unique(_at(of[item], x["node"][item], of[part], x["parent"][part]))
            sums.append(np.bincount(of[item[at[at >= 0]]], minlength=n))
        kept = ["doc_id", "node", "up", "steps", "lost"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *map(pa.array, sums)], names=[*kept, "items", "labels", "bodies"])


def list_facts(tree: DataFrame, elements: DataFrame | None = None, most: int = 15) -> DataFrame:
    """What each list of a structure tree is made of: doc_id, node, itemCount,
    hasLabels, hasBodies, isWellFormed (every item has a body), nestingDepth (of
    the deepest list below it, up to ``most`` levels). ``elements`` has doc_id,
    node, tag and ``tree`` their places, or ``tree`` lists them as for ``table_facts``;
    items count wherever they stand below a list."""
    made: list[DataFrame] = []
    tag, sums = F.col("tag"), ["items", "labels", "bodies"]
    held = _gathered(tree, elements, ["tag"], tag == "L", F.when(tag == "LI", 1).when(tag == "Lbl", 2).when(tag == "LBody", 3), F.lit(0), made)
    kind = held.schema["doc_id"].dataType.simpleString()
    tops = cut(held.mapInArrow(_lists, f"doc_id {kind}, node long, up long, steps long, lost boolean, {', '.join(f'{x} long' for x in sums)}"))
    release(*made)
    made.clear()
    sums = cut(_nested_sums(tops, sums, made), made)
    # from each list to the next one above
    over = tops.where("up is not null").select("doc_id", "node", F.col("up").alias("above"), "steps")
    found = level = over.where(F.col("steps") <= most).select("doc_id", F.col("above").alias("node"), "steps").distinct()
    # the next lists stand one step higher at least
    for _ in range(most - 1):
        level = level.withColumnRenamed("steps", "_below").join(over, ["doc_id", "node"]).select("doc_id", F.col("above").alias("node"), (F.col("steps") + F.col("_below")).alias("steps"))
        level = cut(level.where(F.col("steps") <= most).distinct(), made)
        if level.isEmpty():
            break
        found = found.unionByName(level)
    nested = found.groupBy("doc_id", "node").agg(F.max("steps").cast("int").alias("nested"))
    out = cut(sums.join(nested, ["doc_id", "node"], "left"))
    release(tops, *made)
    return out.select(
        "doc_id", "node", F.col("items").cast("int").alias("itemCount"), (F.col("labels") > 0).alias("hasLabels"), (F.col("bodies") > 0).alias("hasBodies"),
        ((F.col("items") > 0) & (F.col("items") == F.col("bodies"))).alias("isWellFormed"), F.coalesce("nested", F.lit(0)).alias("nestingDepth"),
    )
