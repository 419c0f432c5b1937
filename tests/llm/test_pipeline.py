"""The pipeline's rows against plain Python, stage by stage."""

import hashlib
import random
from collections import defaultdict

from test_operators import WORD, components, edits, shingles

import corpus_pipeline


def without_repeated_lines(docs):
    seen, out = [], []
    for i, t, s in sorted(docs):
        kept = []
        for line in t.split("\n"):
            x = line.strip(" \t\r\f\x0b")
            again = len(x) >= 30 and any(abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2 for y in seen)
            if len(x) >= 30:
                seen.append(x)
            if not again:
                kept.append(line)
        text = "\n".join(kept)
        if text == t or WORD.search(text):
            out.append((i, text, s))
    return out


def mixed(docs):
    """Copies of each document by whole sums in order of hash."""
    sizes, by_source = {i: len(WORD.findall(t)) for i, t, _ in docs}, defaultdict(list)
    for i, _, s in docs:
        by_source[s].append(i)
    weight = {s: n % 3 + 1 for n, s in enumerate(sorted(by_source))}
    held = {s: sum(sizes[i] for i in ids) for s, ids in by_source.items()}
    target, free, rest = {}, set(by_source), sum(held.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * held[s]}
        for s in over or free:
            target[s] = 3 * held[s] if over else level * weight[s]
        rest -= sum(target[s] for s in over)
        free -= over or free
    copies = {}
    for s, ids in by_source.items():
        whole = int(target[s] // held[s]) if held[s] else 0
        due, total = target[s] - whole * held[s], 0
        for i in sorted(ids, key=lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)):
            total += sizes[i]
            copies[i] = whole + (total - sizes[i] / 2 <= due)
    return {i: n for i, n in copies.items() if n}


def test_pipeline(spark, tmp_path):
    draw = random.Random(12)
    words = [f"{draw.choice(['mel', 'tor', 'vin', 'sa'])}{draw.randrange(300)}" for _ in range(600)]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    items = [(i, line(25)) for i in range(4)]
    docs = []
    for i in range(240):
        lines = [line(draw.choice([4, 9, 14])) for _ in range(draw.randrange(1, 5))]
        if i % 5 == 0:
            lines[0] = "grumblewort hexenfluch " + lines[0] + " grumblewort"
        if i % 20 == 7:
            lines.append(items[i % 4][1])
        if i % 9 == 4:
            lines.append("the same words that stand in many of these texts")
        docs.append((i, "\n".join(lines), f"s{i % 4}"))
    base = line(80)
    docs += [(300 + k, f"{base} tail{k}", "s1") for k in range(5)]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [d for d in docs if "grumblewort" not in d[1]]
    left = without_repeated_lines(left)
    group = components(left)
    left = [d for d in left if group[d[0]][1] == d[0]]
    bad = [shingles(t) for _, t in items]
    left = [d for d in left if not any(4 * len(b & shingles(d[1])) >= 3 * len(b) for b in bad)]
    copies, texts = mixed(left), {i: t for i, t, _ in left}

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.text, r.n_chars, r.copies) for r in got} == {i: (texts[i], len(texts[i]), n) for i, n in copies.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _toxicity string, copies string, _removed_lines string"


def write(spark, folder, docs):
    spark.createDataFrame([(i, t, "en", s, 0, "a", "b", "c") for i, t, s in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").where(f"{bool(docs)}").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "an item of nine words that nobody else has")], "item_id long, text string").where(f"{bool(docs)}").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing names, and empty tables."""
    item = "an item of nine words that nobody else has"
    docs = [(1, "some words of the first document", "s"), (1, "some words of the first document", "s"), (None, "a text without number", None), (None, item, None), (2, None, "s"), (3, "", "s"), (4, "before " + item, "s"), (5, "some words of the first document", "s")]
    write(spark, tmp_path / "a", docs)
    out = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert out.columns == [c for c in SCHEMA.replace(" string", "").replace(" long", "").split(", ") if c != "copies"] + ["copies"]
    rows = out.collect()
    texts = sorted((r.doc_id or 0, r.text or "") for r in rows)
    assert (0, "a text without number") in texts and all(item not in t for _, t in texts)
    assert [i for i, _ in texts].count(1) <= 2 and 5 not in [i for i, _ in texts]
    assert all(r._toxicity == "a" and r._removed_lines == "c" and 1 <= r.copies <= 3 for r in rows)
    write(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
