"""Trees, outlines, marks and states against walks in plain Python."""

import random

from pyspark.sql import functions as F

import pytest

from quillscope import written
from quillscope.operators import trees


def walk(children, root):
    """Places of a depth-first walk."""
    out, stack, place = {}, [(root, 0)], 0
    while stack:
        node, depth = stack.pop()
        out[node] = [depth, place, place]
        place += 1
        stack += [(c, depth + 1) for c in reversed(children.get(node, []))]
    for node in sorted(out, key=lambda n: -out[n][1]):
        for c in children.get(node, []):
            out[node][2] = max(out[node][2], out[c][2])
    return {n: tuple(v) for n, v in out.items()}


def test_tree_places(spark, monkeypatch):
    monkeypatch.setattr(trees, "STRETCH", 16)
    draw = random.Random(2)
    rows, expected = [], {}
    for doc in range(4):
        n = (1, 60, 400, 150)[doc]
        numbers = list(range(n))
        draw.shuffle(numbers)
        children = {}
        for k in range(1, n):
            parent = numbers[k - 1 if doc == 2 else draw.randrange(k)]
            children.setdefault(parent, []).append(numbers[k])
        for parent, kids in children.items():
            rows += [(doc, kid, parent, i * 10) for i, kid in enumerate(kids)]
        rows.append((doc, numbers[0], None, 0))
        expected |= {(doc, k): (numbers[0], *v) for k, v in walk(children, numbers[0]).items()}
    # two circles, one with a branch below it; a node that its own descendant lists
    # as well; a parent that isn't there
    rows += [(1, 1001, 1002, 0), (1, 1002, 1001, 0), (1, 1003, 1002, 1), (1, 1004, 1004, 0)]
    rows += [(5, 9, None, 0), (5, 8, 9, 0), (5, 7, 8, 0), (5, 8, 7, 0), (5, 6, 777, 0), (5, 6, 777, 0)]
    expected |= {(1, k): (None,) * 4 for k in (1001, 1002, 1003, 1004)}
    expected |= {(5, 9): (9, 0, 0, 2), (5, 8): (9, 1, 1, 2), (5, 7): (9, 2, 2, 2), (5, 6): (6, 0, 0, 0)}
    listed = spark.createDataFrame(rows, "doc_id long, node long, parent long, place int")
    places = trees.cut(trees.tree_places(listed))
    assert {(r.doc_id, r.node): (r.root, r.depth, r.place, r.last) for r in places.collect()} == expected
    assert {r.doc_id: r.depth for r in trees.document_depth(places).collect()} == {d: min(50, max(v[1] for (e, _), v in expected.items() if e == d and v[0] is not None)) for d in (0, 1, 2, 3, 5)}
    # sums below, and what a node above covers
    summed = trees.subtree_sums(places, {"below": F.lit(1), "odd": F.col("node") % 2})
    for r in summed.collect():
        _, _, a, b = expected[r.doc_id, r.node]
        inside = [k for (d, k), v in expected.items() if d == r.doc_id and v[0] == r.root and a <= v[2] <= b]
        assert (r.below, r.odd) == (len(inside), sum(k % 2 for k in inside))
    for r in trees.covered(places, F.col("node") % 7 == 3).collect():
        _, _, a, _ = expected[r.doc_id, r.node]
        assert r.covered == any(k % 7 == 3 and v[0] == r.root and v[2] < a <= v[3] for (d, k), v in expected.items() if d == r.doc_id and v[0] is not None)
    tags = spark.createDataFrame([(d, k, f"H{k % 9}" if k % 2 else ("Kop" if k % 3 else "P")) for d, k in expected], "doc_id long, node long, tag string")
    roles = spark.createDataFrame([(2, "Kop", "H2"), (3, "P", "H")], "doc_id long, tag string, role string")
    found = [(r.doc_id, r.level, r.tag) for r in trees.headings_in_order(places, tags, roles).orderBy("doc_id", "place").collect()]
    want = []
    for (d, k), v in sorted(expected.items(), key=lambda x: (x[0][0], x[1][2] or 0)):
        tag = f"H{k % 9}" if k % 2 else ("Kop" if k % 3 else "P")
        level = {(2, "Kop"): "H2", (3, "P"): "H"}.get((d, tag), tag)
        if v[0] is not None and v[1] <= 200 and level in ("H", "H1", "H2", "H3", "H4", "H5", "H6"):
            want.append((d, level, tag))
    assert [x for x in found if x[0] != 5] == [x for x in want if x[0] != 5]
    assert trees.tree_places(listed.where("false")).count() == 0


def test_outlines(spark):
    # 1 > (2 > 3, 4), 5 -> leads back to 1; 8 and 9 can't be reached; document 2 is empty
    entries = [(1, 1, 2, 5, "One"), (1, 2, 3, 4, "Two"), (1, 3, None, None, ""), (1, 4, None, None, None), (1, 5, 6, 1, "Five"), (1, 6, None, None, "Six"), (1, 8, None, 9, "lost"), (1, 9, None, 8, "lost"), (3, 1, None, 2, "a")]
    entries += [(3, k, None, k + 1, f"t{k}") for k in range(2, 70)] + [(3, 70, None, 40, "end")]
    rows = spark.createDataFrame([(d, n, f, x, t) for d, n, f, x, t in entries], "doc_id long, node long, first long, next long, title string")
    roots = spark.createDataFrame([(1, 1), (2, None), (3, 1)], "doc_id long, first long")
    places = trees.outline_places(rows, roots)
    found = {r.doc_id: (r.entries, r.titles) for r in trees.outline_titles(places, rows).collect()}
    assert found == {1: (6, ["One", "  Two", "Five", "  Six"]), 3: (70, ["a"] + [f"t{k}" for k in range(2, 51)])}


def test_marks_and_states(spark, monkeypatch):
    monkeypatch.setattr(trees, "STRETCH", 8)
    draw = random.Random(6)
    items, texts = [], {}
    for doc in range(6):
        stack = []
        for i in range(120):
            kind = draw.choice(["begin", "end", "text", "text"]) if doc else "text"
            mark = draw.choice([None, "", f"m{i}", f"m{i % 5}"]) if kind == "begin" else None
            text, line_end = (draw.choice(["", "ab", " c", None]), draw.random() < 0.3) if kind == "text" else (None, False)
            items.append((doc, i, kind, mark, text, line_end))
            if kind == "begin":
                stack.append(mark or None)
            elif kind == "end":
                stack and stack.pop()
            elif text is not None and (text or line_end):
                inner = next((m for m in reversed(stack) if m), None)
                if inner:
                    texts[doc, inner] = texts.get((doc, inner), "") + text + (" " if line_end else "")
    rows = spark.createDataFrame(items, "doc_id long, ord long, kind string, id string, text string, line_end boolean")
    assert {(r.doc_id, r.id): r.text for r in trees.marked_texts(rows).collect()} == texts

    operations, expected = [], {}
    for doc in range(5):
        for page in range(3):
            stack, font, mode = [], None, 0
            for i in range(80):
                op = draw.choice(["font", "mode", "save", "restore", "show"])
                name, number, text = draw.choice([None, "A", "B", "C"]), draw.choice([0, 3, None]), draw.choice([" ", "x", None, "y"])
                operations.append((doc, page, i, op, name if op == "font" else None, number if op == "mode" else None, text if op == "show" else None))
                if op == "font":
                    font = name
                elif op == "mode" and number is not None:
                    mode = number
                elif op == "save":
                    stack.append((font, mode))
                elif op == "restore" and stack:
                    font, mode = stack.pop()
                elif op == "show" and mode != 3 and text and text.strip():
                    seen = expected.setdefault(doc, [set(), False])
                    seen[0] |= {font} - {None}
                    seen[1] |= font is None
    rows = spark.createDataFrame(operations, "doc_id long, page int, ord long, op string, font string, mode int, text string")
    assert {r.doc_id: [set(r.fonts), r.unresolved] for r in trees.visible_fonts(rows).collect()} == expected


def test_within_steps_and_live_fonts(spark):
    edges = [(1, a, b) for a, b in [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (0, 5), (5, 3), (4, 6), (6, 7)]]
    found = trees.within_steps(spark.createDataFrame([(1, 0, 0), (1, 6, 6)], "doc_id long, start long, node long"), spark.createDataFrame(edges, "doc_id long, source long, target long"), 4)
    assert {(r.start, r.node): r.steps for r in found.collect()} == {(0, 0): 0, (0, 1): 1, (0, 2): 2, (0, 3): 2, (0, 5): 1, (0, 4): 3, (0, 6): 4, (6, 6): 0, (6, 7): 1}
    values = [("page", "Resources", "res"), ("res", "Font", "dict"), ("dict", "entry", "f1"), ("dict", "entry", "f2"), ("f1", "FontDescriptor", "d1"), ("f1", "BaseFont", "Arial"), ("f2", "DescendantFonts", "cid"), ("f2", "BaseFont", "Two"), ("cid", "FontDescriptor", "d2"), ("cid", "BaseFont", "Cid"), ("orphan", "FontDescriptor", "d3"), ("orphan", "BaseFont", "Old")]
    deep = [(f"n{i}", "inside", f"n{i + 1}") for i in range(20)] + [("n12", "Font", "dict2"), ("dict2", "entry", "f3"), ("f3", "FontDescriptor", "d4"), ("n13", "Font", "dict3"), ("dict3", "entry", "f4"), ("f4", "FontDescriptor", "d5")]
    rows = spark.createDataFrame([(1, *v) for v in values + deep], "doc_id long, source string, key string, target string")
    objects = spark.createDataFrame([(1, "page"), (1, "orphan"), (1, "n0")], "doc_id long, node string")
    assert {r.descriptor: r.names for r in trees.live_fonts(objects, rows).collect()} == {"d1": ["Arial"], "d2": ["Cid", "Two"], "d4": []}


@pytest.mark.parametrize("near", [True, False])
def test_paths_over_stretches(spark, monkeypatch, near):
    # paths that leave stretches of 8 rows again and again; a circle over several
    monkeypatch.setattr(trees, "CHUNK", 8)
    draw = random.Random(3)
    rows = [(d, k, (k + draw.randrange(1, 4) if near else draw.choice([k + 37, k + 101])) if k % 50 else None, k % 5) for d in (1, 2) for k in range(300)]
    rows += [(3, k, (k + 1) % 40, 1) for k in range(40)] + [(3, 100, 7, 1), (3, 101, 500, 1), (None, 1, 2, 1), (None, 2, None, 1)]
    found = trees.follow(spark.createDataFrame(rows, "doc_id long, node int, to long, w int"), ["doc_id"], ["w"])
    to, w = {(d, n): (d, t) for d, n, t, _ in rows}, {(d, n): x for d, n, _, x in rows}
    for r in found.collect():
        at, total, seen = (r.doc_id, r.node), 0, 0
        while r.doc_id and to[at] in to and seen < 400:
            at, seen = to[at], seen + 1
            total += w[at]
        assert (r.end, r.w if r.end is not None else None) == ((at[1], total) if seen < 400 else (None, None))


def test_deep_trees_take_no_more_steps(spark, monkeypatch):
    # a chain is followed inside stretches, so 32 times its depth needs no further joins
    taken, write = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda *a: taken.append(1) or write(*a))
    steps = []
    for n in (64, 2048):
        taken.clear()
        rows = spark.range(n).selectExpr("1L AS doc_id", "id AS node", "nullif(id, 0) - 1 AS parent", "id AS place")
        found = trees.tree_places(rows).collect()
        assert sorted((r.node, r.root, r.depth, r.place, r.last) for r in found) == [(k, 0, k, k, n - 1) for k in range(n)]
        steps.append(len(taken))
    assert steps[0] == steps[1]


def test_lists_leave_one_table(spark):
    # lists in lists, one 15 levels below the first, one 16
    rows = [(1, k, k - 1 if k else None, "L" if k in (0, 3, 15, 16) else ("LI" if k % 2 else "Span")) for k in range(17)] + [(1, 100, 1, "LBody"), (1, 200, 201, "L"), (1, 201, 200, "L")]
    listed = spark.createDataFrame(rows, "doc_id long, node long, parent long, tag string")
    places = trees.tree_places(listed.withColumn("place", F.col("node")))
    held = len(written._WRITTEN)
    found = trees.list_facts(places, listed)
    assert {r.node: (r.itemCount, r.nestingDepth, r.hasBodies, r.isWellFormed) for r in found.collect()} == {0: (6, 15, True, False), 3: (5, 13, False, False), 15: (0, 1, False, False), 16: (0, 0, False, False)}
    assert len(written._WRITTEN) == held + 1


def test_tables_leave_one_table(spark):
    # a row in a section, one outside any table, a cell outside any row
    rows = [(1, 0, None, "Table"), (1, 1, 0, "TBody"), (1, 2, 1, "TR"), (1, 3, 2, "TH"), (1, 4, 2, "TD"), (1, 5, 0, "TR"), (1, 6, 5, "TD"), (1, 7, 0, "TD"), (1, 8, None, "TR"), (1, 9, 8, "TD")]
    listed = spark.createDataFrame(rows, "doc_id long, node long, parent long, tag string").selectExpr("*", "false AS scope", "false AS headers", "1 AS col_span", "1 AS row_span")
    places = trees.tree_places(listed.withColumn("place", F.col("node")))
    held = len(written._WRITTEN)
    found = trees.table_facts(places, listed.drop("parent")).collect()
    assert [(r.node, r.headerCount, r.dataCellCount, r.rowCount, r.columnCounts) for r in found] == [(0, 1, 3, 2, [2, 1])]
    assert len(written._WRITTEN) == held + 1


def test_fonts_are_searched_from_all_objects_at_once(spark, monkeypatch):
    held, within = [], trees.within_steps
    monkeypatch.setattr(trees, "within_steps", lambda *a: held.append(within(*a)) or held[-1])
    values = [("a", "inside", "c"), ("b", "inside", "c"), ("c", "Font", "d"), ("d", "entry", "f"), ("f", "FontDescriptor", "x")]
    rows = spark.createDataFrame([(1, *v) for v in values], "doc_id long, source string, key string, target string")
    objects = spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, node string")
    assert [(r.descriptor, r.names) for r in trees.live_fonts(objects, rows).collect()] == [("x", [])]
    # c is opened once, not once for each object that leads there
    assert sorted((r.node, r.steps) for r in held[0].collect()) == [("a", 0), ("b", 0), ("c", 1)]


def _facts(rows, kind):
    """Tables or lists by a walk: node -> counts; elements list several parents, of which
    the first that a root reaches counts."""
    nodes = {n for n, *_ in rows}
    parent, reached = {}, set()
    tag = {n: t for n, _, t in rows}
    while True:
        more = {n: p for n, p, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)) [::-1] if n not in reached and (p is None or p not in nodes or p in reached)}
        if not more:
            break
        parent |= more
        reached |= set(more)
    below = {}
    for n in reached:
        at = parent[n]
        while at in reached:
            below.setdefault(at, set()).add(n)
            at = parent[at]
    out = {}
    for n in reached:
        if tag[n] == kind == "Table":
            held = [tag[k] for k in below.get(n, ())]
            out[n] = (held.count("TH"), held.count("TD"), "Caption" in held, "Table" in held)
        if tag[n] == kind == "L":
            items = [k for k in below.get(n, ()) if tag[k] == "LI"]
            kids = {i: {tag[k] for k in reached if parent[k] == i} for i in items}
            deep, level = 0, {n: 0}
            for k in sorted(below.get(n, ()), key=lambda k: _depth(k, parent, reached)):
                level[k] = level[parent[k]] + 1
            for k in below.get(n, ()):
                if tag[k] == "L" and level[k] <= 15:
                    deep = max(deep, level[k])
            out[n] = (len(items), any("Lbl" in x for x in kids.values()), any("LBody" in x for x in kids.values()), bool(items) and all("LBody" in x for x in kids.values()), deep)
    return out


def _depth(k, parent, reached):
    steps = 0
    while parent[k] in reached:
        k, steps = parent[k], steps + 1
    return steps


@pytest.mark.parametrize("chunk, few, levels, again", [(1 << 20, 1 << 17, 6, False), (5, 1 << 17, 1, False), (7, 3, 6, False), (6, 1 << 17, 6, True)])
def test_facts_are_gathered_in_stretches(spark, monkeypatch, chunk, few, levels, again):
    # elements near their parents and far from them, circles, parents that aren't listed
    for name, value in (("CHUNK", chunk), ("FEW", few), ("LEVELS", levels)):
        monkeypatch.setattr(trees, name, value, raising=False)
    draw = random.Random(chunk + levels)
    for kind, tags in (("Table", ["Table", "TR", "TBody", "TH", "TD", "Caption", "P"]), ("L", ["L", "LI", "LI", "Lbl", "LBody", "P"])):
        rows = [(k, None if k < 3 else draw.choice([draw.randrange(k), max(0, k - draw.randrange(1, 4)), draw.randrange(160)] if k % 9 == 0 else [max(0, k - draw.randrange(1, 4))]), draw.choice(tags)) for k in range(150)]
        rows += [(200, 201, kind), (201, 200, tags[1]), (202, 201, kind), (203, 202, tags[2])]
        if again:
            # a parent on a circle, and another one
            rows = [r for r in rows if r[0] not in (140, 141)] + [(140, 201, kind), (140, 300, kind), (300, 2, tags[1]), (141, 140, tags[1])]
        listed = spark.createDataFrame([(1, *r) for r in rows], "doc_id long, node long, parent long, tag string").selectExpr("*", "node AS place", "tag = 'TH' AS scope", "false AS headers", "1 AS col_span", "1 AS row_span")
        held = len(written._WRITTEN)
        found = (trees.table_facts if kind == "Table" else trees.list_facts)(listed)
        got = {r.node: (r.headerCount, r.dataCellCount, r.hasCaption, r.hasNestedTable) if kind == "Table" else (r.itemCount, r.hasLabels, r.hasBodies, r.isWellFormed, r.nestingDepth) for r in found.collect()}
        assert got == _facts(rows, kind)
        assert len(written._WRITTEN) == held + 1


def test_widths_of_rows_in_sections_and_spans(spark):
    rows = [(0, None, "Table"), (9, 0, "THead"), (3, 9, "TR"), (5, 0, "TR"), (12, 0, "TBody"), (1, 12, "TR"), (30, 12, "P"), (31, 30, "TR")]
    cells = [(40, 3, "TH", 2, 9), (41, 3, "TH", None, 0), (42, 5, "TD", 3, 2), (43, 1, "TD", 1, 1), (44, 0, "TD", 5, 1), (45, 31, "TD", 7, 1), (46, 42, "TD", 4, 1)]
    listed = spark.createDataFrame([(1, *r, None, None) for r in rows] + [(1, *r) for r in cells], "doc_id long, node long, parent long, tag string, col_span int, row_span int").selectExpr("*", "node AS place", "tag = 'TH' AS scope", "false AS headers")
    found = trees.table_facts(listed).first()
    # rows stand as 5, 3 (in 9), 1 (in 12); the cell of two rows reaches the second one, the one of nine the last
    assert (found.rowCount, found.columnCounts, found.hasConsistentColumns, found.headerCount, found.dataCellCount) == (3, [3, 6, 3], False, 2, 5)


def test_tables_are_not_put_in_document_order(spark, monkeypatch):
    # tables that don't stand in others deeply need no tour of all elements
    monkeypatch.setattr(trees, "_toured", lambda *a: pytest.fail("toured"))
    import __spark_entry__

    for name in ("table_structures", "list_structures"):
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
