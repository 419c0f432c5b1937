"""Operators against brute force on small tables with nulls, empty and long
texts, ties, repeated rows and clashing extra columns."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillscope.llm.decontaminate import drop_contaminated, find_contained
from quillscope.llm.embedding_dedup import near_duplicate_vectors
from quillscope.llm.license_scan import scan_licenses
from quillscope.llm.line_dedup import dedup_lines, duplicate_lines
from quillscope.llm.ngram_join import keep_one_of_each, ngram_components
from quillscope.llm.quality_rules import fit_quality, score_quality
from quillscope.llm.source_mix import mix_sources, take_mix
from quillscope.llm.substring_dedup import remove_repeats
from quillscope.llm.token_counts import TokenRollup, count_tokens, revised, signed
from quillscope.llm.toxicity import fit_toxicity, score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, component string, original long, removed string, below string, _spans int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, "x", 1, "y", "z", 3) for i, t, s in rows], SCHEMA)


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}ä" if i % 9 == 0 else f"W{i}" for i in range(400)]
    text = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    passage, rows = text(70), []
    for i in range(n):
        t = text(draw.choice([0, 1, 3, 40, 120, 200]))
        if i % 7 == 0:
            t = text(20) + " \n" + passage + "\t" + text(5)
        rows.append([i, t, f"s{i % 3}"])
    base = text(150).split(" ")
    for i in range(n, n + 12):
        copy = list(base)
        for _ in range(i % 4):
            copy[draw.randrange(150)] = f"x{i}"
        rows.append([i, " ".join(copy), "s0"])
    rows += [[n + 12, rows[3][1], None], [n + 13, None, "s1"], [n + 14, "", "s1"], [n + 15, "  \t\n ", None], [n + 16, text(30_000), "s2"], [n + 17, "v" * 200_000, "s2"], [n + 16, rows[-1][1], "s2"]]
    return rows + [[3, rows[3][1], "s0"]]


def test_substring_dedup(spark):
    rows = [r for r in corpus() if r[0] != 3 or r[2]]
    seen, expected = {}, {}
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - 49):
            if seen.setdefault(tuple(w[a : a + 50]), i) < i:
                gone[a : a + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        expected.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    for options in ({}, {"group_rows": 1}):
        got = {}
        for r in remove_repeats(make(spark, rows), **options).collect():
            got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_sha256, r.kept_text))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])


def components(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                same = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * same >= 75 * (len(sets[a]) + len(sets[b]) - same) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_ngram_join(spark):
    rows = [r for r in corpus() if r[0] != 76]
    expected = components(rows)
    got = ngram_components(make(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    kept = {r.doc_id for r in keep_one_of_each(make(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in expected.items() if i == c}


def test_ngram_join_settles_long_runs(spark, monkeypatch):
    from quillscope.llm import ngram_join

    monkeypatch.setattr(ngram_join, "SHORT", 2)
    sign = ngram_join._sign

    def signed(buckets):  # workers load the module anew, so the bound travels along
        run = sign(buckets)

        def with_bound(batches):
            ngram_join.HOT = 2
            return run(batches)

        return with_bound

    monkeypatch.setattr(ngram_join, "_sign", signed)
    draw = random.Random(4)
    passage = " ".join(f"p{draw.randrange(10**6)}" for _ in range(60))
    rows = []
    for i in range(30):
        own = [f"q{draw.randrange(10**6)}" for _ in range(60)]
        rows += [[2 * i, passage + " " + " ".join(own), "s"], [2 * i + 1, passage + " " + " ".join([*own[:-4], f"z{i}"]), "s"]]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(make(spark, rows)).collect()} == components(rows)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark):
    draw = random.Random(2)
    lines = ["".join(draw.choice("abcdeé𝄞 ") for _ in range(draw.randrange(28, 45))) for _ in range(60)]
    for k in range(60):
        x = list(lines[draw.randrange(30)])
        for _ in range(draw.randrange(1, 4)):
            at = draw.randrange(len(x))
            if draw.random() < 0.4:
                del x[at]
            else:
                x.insert(at, draw.choice("xyé𝄞"))
        lines.append("".join(x))
    draw.shuffle(lines)
    rows = [[i, "\n".join(lines[4 * i : 4 * i + 4]), "s"] for i in range(30)] + [[30, None, "s"], [31, "", "s"], [32, lines[0] + "\n" + lines[0], "s"], [None, lines[0], "s"], [33, "short", "s"]]
    seen, gone = [], set()
    for i, t, _ in rows:
        for p, x in enumerate((t or "").split("\n")):
            x = x.strip(" \t\r\f\x0b")
            if i is not None and len(x) >= 30:
                if any(abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for y in seen):
                    gone.add((i, p))
                seen.append(x)
    assert {(r.doc_id, r.pos) for r in duplicate_lines(make(spark, rows)).collect()} == gone
    out = {r.doc_id: r.text for r in dedup_lines(make(spark, rows)).collect()}
    for i, t, _ in rows:
        left = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        if left != t and not left.strip():
            assert i not in out
        else:
            assert out[i] == left


def test_decontaminate(spark):
    draw = random.Random(3)
    word = lambda: f"a{draw.randrange(10**6)}"
    items = [(i, " ".join(word() for _ in range(draw.randrange(1, 70)))) for i in range(40)] + [(90, None), (91, ""), (92, "Two WORDS")]
    docs = []
    for i in range(80):
        t = [word() for _ in range(draw.choice([5, 300, 3000]))]
        if i % 2 == 0:
            part = items[i // 2][1].upper().split()
            if i % 6 == 0 and len(part) > 30:
                part = part[: len(part) * 9 // 10]
            at = draw.randrange(len(t))
            t[at:at] = part
        docs.append([i, " ".join(t), "s"])
    docs += [[80, None, "s"], [81, "", "s"], [82, "two words", "s"], [5, docs[4][1], "s"]]
    expected = Counter()
    for i, t, _ in docs:
        own = shingles(t)
        for j, x in items:
            need = shingles(x)
            if need and 4 * len(need & own) >= 3 * len(need):
                expected[i, j, len(need & own), len(need)] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(map(tuple, find_contained(make(spark, docs), bench).collect())) == expected
    assert Counter(map(tuple, find_contained(make(spark, docs), bench, block_bytes=2000).collect())) == expected
    dirty = {(i, t) for i, t, _ in docs for j, x in items if shingles(x) and 4 * len(shingles(x) & shingles(t)) >= 3 * len(shingles(x))}
    docs += [[None, docs[0][1], "s"], [None, "clean words", "s"]]
    for options in ({}, {"block_bytes": 2000}):
        kept = Counter((r.doc_id, r.text) for r in drop_contaminated(make(spark, docs), bench, **options).collect())
        assert kept == Counter((i, t) for i, t, _ in docs if (i, t) not in dirty and t != docs[0][1])


def test_decontaminate_recall(spark):
    """Items of every size, a quarter of their words changed at most, in up to
    twenty pieces in documents of thousands of words: none is missed."""
    draw = random.Random(13)
    word = lambda: f"b{draw.randrange(10**6)}"
    items, docs, due = [], [], set()
    for i in range(400):
        w = [word() for _ in range(draw.randrange(5, 300))]
        items.append((i, " ".join(w)))
        n, pieces = len(w), draw.choice([1, 2, 4, 20])
        cuts = sorted({0, n, *(draw.randrange(n) for _ in range(pieces - 1))})
        t = [word() for _ in range(draw.choice([10, 500, 3000]))]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = draw.randrange(len(t))
            t[at:at] = w[max(0, a - 4) : b]
        for _ in range(draw.randrange(0, 1 + n // 25)):
            t[draw.randrange(len(t))] = "z"
        docs.append([i, " ".join(t), "s"])
        need = shingles(items[i][1])
        if 4 * len(need & shingles(docs[i][1])) >= 3 * len(need):
            due.add((i, i))
    assert len(due) > 300
    got = {(r.doc_id, r.item_id) for r in find_contained(make(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert due <= got


def test_source_mix(spark):
    rows = corpus(n=90)
    out = mix_sources(make(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes, taken, targets = Counter(), Counter(), {}
    source = {i: s for i, _, s in rows if i != 3}
    for r in out:
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        if r.doc_id != 3:
            sizes[source[r.doc_id]] += r.size
            taken[source[r.doc_id]] += r.taken
            targets[source[r.doc_id]] = r.target
            assert r.target <= 3 * r.source_size + 1e-6
    assert sum(targets.values()) == pytest.approx(sum(r.size for r in out))
    assert sorted(map(tuple, out)) == sorted(map(tuple, mix_sources(make(spark, rows).repartition(7)).collect()))
    kept = take_mix(make(spark, rows).withColumn("copies", F.lit("mine"))).collect()
    assert all(0 < r.copies <= 3 for r in kept) and len(kept) == sum(r.copies > 0 for r in out)


def test_source_mix_of_many_sources(spark):
    """Sources over several ranges, some capped, some without words."""
    draw = random.Random(14)
    rows = [[i, " ".join("w" for _ in range(draw.choice([0, 1, 5, 400 if i % 97 == 0 else 7]))), f"s{i % 230:03d}" if i % 41 else None] for i in range(1500)]
    out = {r.doc_id: r for r in mix_sources(make(spark, rows)).collect()}
    held = Counter()
    for i, t, s in rows:
        held[s] += len(t.split())
    order = sorted((s for s in held if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), sum(held.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * held[s]}
        target |= {s: 3 * held[s] if over else level * weight[s] for s in over or free}
        rest -= sum(target[s] for s in over)
        free -= over or free
    taken = Counter()
    for i, t, s in rows:
        assert out[i].target == pytest.approx(target[s]) and out[i].copies <= 3
        taken[s] += out[i].taken
    assert all(abs(taken[s] - target[s]) <= 400 for s in order)


def labelled(spark, kind):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        w = [f"{draw.choice(['mel', 'tor', 'vin'])}{draw.randrange(50)}" for _ in range(draw.randrange(20, 80))]
        if bad and kind == "toxic":
            w[3:3] = ["grumblewort"]
        if bad and kind == "quality":
            w = [x.upper() + "!!" for x in w]
        rows.append([i, " ".join(w), "s"])
        labels.append((i, int(bad)))
    rows += [[600, None, "s"], [601, "", "s"], [None, "mel tor", "s"]]
    return make(spark, rows), spark.createDataFrame([*labels, (None, 1), (3, None)], f"doc_id long, {kind} int")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifiers(spark, kind):
    docs, labels = labelled(spark, kind)
    out = score_toxicity(docs, fit_toxicity(docs, labels)) if kind == "toxic" else score_quality(docs, fit_quality(docs, labels))
    assert out.columns == [*docs.columns, f"{kind}_score".replace("toxic_", "toxicity_")]
    again = out.drop("doc_id").withColumn("doc_id", F.lit(1).cast("long"))  # a column of the score's name is replaced
    assert (score_toxicity(again, fit_toxicity(docs, labels.where("false"))) if kind == "toxic" else score_quality(again, fit_quality(docs, labels.where("false")))).columns.count(out.columns[-1]) == 1
    scores = {r[0]: r[1] for r in out.select("doc_id", out.columns[-1]).collect()}
    assert len(scores) == 503 and all(0 <= s <= 1 for s in scores.values())
    right = sum((scores[i] >= 0.5) == (i % 4 == 0) for i in range(500))
    assert right >= 490
    none = labels.where("false")
    empty = score_toxicity(docs, fit_toxicity(docs, none)) if kind == "toxic" else score_quality(docs, fit_quality(docs, none))
    assert empty.count() == 503


def test_embedding_dedup(spark):
    import numpy as np

    draw = np.random.default_rng(8)
    x = draw.standard_normal((700, 24))
    x[100:160] = x[100] + 0.02 * draw.standard_normal((60, 24))
    x[200:230] = x[200] + 0.25 * draw.standard_normal((30, 24))
    x[300] = x[301]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(700, dtype=bool)
    rows = [(i, [float(y) for y in v], 1) for i, v in enumerate(x)]
    odd = [(800, None, 1), (801, [0.0] * 24, 1), (802, [1.0, None] + [0.0] * 22, 1), (803, [float("nan")] * 24, 1), (804, [1.0, 2.0], 1), (None, rows[0][1], 1)]
    out = near_duplicate_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, id int")).collect()
    got = {r.vec_id: r for r in out}
    assert len(out) == 706
    assert sum(got[i].n_links for i in range(700)) >= 0.97 * near.sum()
    assert all(got[i].n_links <= near[i].sum() for i in range(700))
    assert all(got[i].component_id == 100 for i in range(100, 160)) and got[301].component_id == 300
    assert all(got[i].n_links == 0 and got[i].kept for i in (800, 801, 802, 803, 804, None))


def test_token_rollup(spark, tmp_path):
    import base64

    vocabulary = tmp_path / "bytes.tiktoken"
    vocabulary.write_text("".join(f"{base64.b64encode(bytes([i])).decode()} {i}\n" for i in range(256)))
    rows = [[1, "abc", "s"], [2, None, "s"], [3, "é", None], [4, "", "t"]]
    counts = count_tokens(make(spark, rows), str(vocabulary), r"\S+|\s+", "v1")
    assert {r.doc_id: r.tokens for r in counts.collect()} == {1: 3, 2: 0, 3: 2, 4: 0}
    rollup = TokenRollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0
    total = lambda: {(r.source, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}
    rollup.commit("b1", signed(counts.unionAll(counts), 1))
    rollup.commit("b1", signed(counts, 1))  # a retry takes the place of what it counted
    assert total() == {("s", "v1"): (2, 3), (None, "v1"): (1, 2), ("t", "v1"): (1, 0)}
    rollup.commit("b2", signed(counts.where("doc_id = 4"), -1))
    rollup.compact()
    rollup.commit("b2", signed(counts, 1))  # final by now
    rollup.commit("b3", revised(counts.where("doc_id = 1"), counts.where("doc_id = 1").withColumns({"tokens": F.lit(9).cast("long"), "tokenizer": F.lit("v2")})))
    rollup.compact()
    rollup.compact()
    assert total() == {("s", "v1"): (1, 0), ("s", "v2"): (1, 9), (None, "v1"): (1, 2)}
    assert len(list((tmp_path / "rollup" / "base").iterdir())) <= 2 and not any((tmp_path / "rollup" / "deltas").iterdir())
    rollup.drop()
    assert rollup.totals().count() == 0


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [[1, f"one two\n{apache}\nmore text", "s"], [2, gpl.replace("version 3", "version 2"), "s"], [3, "we license nothing here at all", "s"], [4, None, "s"], [5, "", "s"], [6, f"{apache}\n{apache}", "s"], [7, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Program.", "s"]]
    got = sorted((r.doc_id, r.line, r.license, r.exact, r.missing) for r in scan_licenses(make(spark, rows)).collect())
    assert got == [(1, 1, "apache-2.0", True, 0), (2, 0, "gpl-2.0", True, 0), (6, 0, "apache-2.0", True, 0), (6, 1, "apache-2.0", True, 0), (7, 0, "mit-full", False, 1)]


def test_empty_tables(spark):
    docs = make(spark, [[1, "a", "s"]]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (remove_repeats(docs), ngram_components(docs), keep_one_of_each(docs), dedup_lines(docs), find_contained(docs, bench), mix_sources(docs), take_mix(docs), score_toxicity(docs, fit_toxicity(docs, labels)), score_quality(docs, fit_quality(docs, labels)), scan_licenses(docs), near_duplicate_vectors(vectors)):
        assert out.count() == 0


def test_toxicity_features_in_plain_python():
    import numpy as np
    import pyarrow as pa

    from quillscope.llm import toxicity

    def features(text):
        low, out = [toxicity._LOWER[ord(c)] if ord(c) < 65536 else ord(c) for c in text or ""], set()
        for n in toxicity.SIZES:
            for i in range(len(low) - n + 1):
                h = 0
                for x in low[i : i + n]:
                    h = (h * 0x9E3779B1 + int(x)) & 0xFFFFFFFF
                h = ((h ^ h >> 15) * 0x85EBCA77) & 0xFFFFFFFF
                h = ((h ^ h >> 13) * 0xC2B2AE3D) & 0xFFFFFFFF
                out.add((h >> 12) + toxicity.SIZES.index(n) * toxicity.BUCKETS)
        return out

    draw = random.Random(15)
    texts = ["", None, "ab", "Straße ΑΒΓδ", "\U0001f600漢字かなカナ 漢字", "x" * 10, "".join(draw.choice("aé漢\U0001f600 B") for _ in range(4000))]
    for limit in (toxicity.SLICE, 1000):  # in slices, and a long text in pieces
        toxicity.SLICE, before = limit, toxicity.SLICE
        got = {}
        for base, n, row, feature in toxicity._present(pa.array(texts)):
            for r in range(n):
                got[base + r] = set(feature[row == r].tolist())
        toxicity.SLICE = before
        assert [got[i] for i in range(len(texts))] == [features(t) for t in texts]
    rows = [np.array(sorted(draw.sample(range(20), 5)), np.uint16) for _ in range(40)]
    y = np.array([float(3 in r) for r in rows])
    w, b = toxicity._fit_logistic([r.tobytes() for r in rows], np.ones(20), y, 1e-4)
    assert all((w[r].sum() + b > 0) == (t == 1) for r, t in zip(rows, y, strict=True))


def test_rules_hold_as_columns(spark):
    """The compiled expression gives what the rules give in Python."""
    import numpy as np

    from quillscope.llm.quality_rules import STATS, fit_rules, holds
    from quillscope.llm.toxicity import sigmoid

    draw = np.random.default_rng(16)
    x = draw.standard_normal((400, len(STATS)))
    y = ((x[:, 0] > 0.3) & (x[:, 4] <= 0.5)).astype(float)
    model = fit_rules(x, y, trees=15)
    total = model.bias + sum(w * holds(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, " + ", ".join(f"stat_{s} double" for s in STATS))
    got = {r[0]: r[1] for r in rows.select("i", model.column()).collect()}
    assert np.allclose([got[i] for i in range(400)], sigmoid(total))
    assert np.mean((sigmoid(total) >= 0.5) == (y == 1)) >= 0.97


def test_ngram_join_near_the_threshold(spark, monkeypatch):
    """Pairs on both sides of three quarters, in every size band, and with plans
    that leave no room, so that sets go the exact way."""
    from quillscope.llm import ngram_join

    draw = random.Random(17)
    rows = []
    for k, n in enumerate([1, 2, 4, 6, 9, 14, 22, 35, 50, 80, 119, 121, 180, 260, 400, 700, 1500, 4000]):
        w = [f"k{k}x{draw.randrange(10**8)}" for _ in range(n + 4)]
        rows.append([10 * k, " ".join(w), "s"])
        for j, share in enumerate((0.80, 0.76, 0.745, 0.70)):
            gone = round((n + 4) * (1 - share) / 2 * 0.98) if n > 20 else j
            rows.append([10 * k + 1 + j, " ".join(w[: len(w) - gone] + [f"y{draw.randrange(10**8)}" for _ in range(gone)]), "s"])
    expected = components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(make(spark, rows)).collect()} == expected
    needs = ngram_join._needs
    monkeypatch.setattr(ngram_join, "_needs", lambda *a: [x * 0 for x in needs(*a)])
    describe = ngram_join._describe

    def unsure(batches):  # workers load the module anew
        own = ngram_join._needs
        ngram_join._needs = lambda *a: [x * 0 for x in own(*a)]
        yield from describe(batches)
        ngram_join._needs = own

    monkeypatch.setattr(ngram_join, "_describe", unsure)
    monkeypatch.setattr(ngram_join, "_sign", lambda buckets: lambda batches: iter(()))  # no signature at all
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(make(spark, rows)).collect()} == expected


def test_vectors_of_other_lengths_and_poor_graphs(spark):
    import numpy as np

    draw = np.random.default_rng(18)
    x = draw.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 600, 2):  # pairs that are only just linked
        side = draw.standard_normal(32)
        side -= side @ x[i] * x[i]
        cos = draw.uniform(0.9, 0.92)
        x[i + 1] = cos * x[i] + np.sqrt(1 - cos**2) * side / np.linalg.norm(side)
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(5000 + i, [1.0, 2.0, 3.0]) for i in range(3)] + [(6000, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_duplicate_vectors(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(3000, dtype=bool)
    found = sum(got[i].n_links for i in range(3000))
    assert near.sum() >= 500 and found >= 0.9 * near.sum() and all(got[i].n_links <= near[i].sum() for i in range(3000))
    assert all((got[5000 + i].n_links, got[5000 + i].component_id) == (2, 5000) for i in range(3)) and got[6000].n_links == 0
    with pytest.raises(RuntimeError):
        near_duplicate_vectors(table.where("vec_id < 3000"), rounds=1, recall=2.0, least_recall=1.5)


def test_clashing_names_and_missing_ids(spark):
    docs = make(spark, [[1, "one line that is long enough to be compared\nyes", "s"], [None, "one line that is long enough to be compared", None], [2, "one line that is long enough to be compared\nno", "s"], [2, None, "s"]])
    odd = docs.withColumns({"_removed_lines": F.lit("mine"), "copies": F.lit("mine"), "_mix_source": F.lit("mine"), "_mix_edge": F.lit("mine")})
    out = {r.doc_id: (r.text, r._removed_lines) for r in dedup_lines(odd).where("text is not null").collect()}
    assert out[2] == ("no", "mine") and out[None][0].startswith("one")
    assert [r.n_removed for r in remove_repeats(docs).collect()] == [0] * 4
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in ngram_components(docs).collect()) == [(0, 0), (1, 1), (2, 2), (2, 2)]
    assert take_mix(odd).columns == [c for c in odd.columns if c != "copies"] + ["copies"]
    rows = {r.doc_id: r for r in mix_sources(docs).collect()}
    assert rows[None].size == 9


def test_queries_keep_their_contracts(spark, tmp_path):
    from quillscope.llm import queries

    docs, _ = labelled(spark, "toxic")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(500)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, types in {
        "op1_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op6_quality_rules": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op8_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    }.items():
        out = queries.QUERIES[name](spark, str(tmp_path))
        assert dict(out.dtypes) == types
        rows = out.collect()
        assert len(rows) == 503
        if "held_out" in types:
            assert all(r.held_out is not None and 0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if "tox" in name else 0.5)) for r in rows)
            assert [r.held_out for r in rows if r.doc_id is None] == [False]
