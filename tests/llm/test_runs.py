"""Periodic runs against a search of every period, and against the SQL."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from quillscope.llm import queries
from quillscope.llm.periodic_runs import find_runs

SCHEMA = "doc_id long, text string, runs string, collapsed int, n_words string"


def brute(words, least=12):
    """(start, smallest period, length) of each maximal run, period by period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        i = 0
        while i < len(same):
            begin = i
            while same[i]:
                i += 1
            if i - begin + q >= max(least, 2 * q):
                out.setdefault((begin, i - begin + q), q)
            i += 1
    return sorted((s, q, n) for (s, n), q in out.items())


def texts():
    draw = random.Random(3)
    out = [None, "", " \t\n ", "one", "a " * 11, "a\tb " * 6, "x\xa0y " * 12, "word " * 40_000, " ".join(f"w{i % 700}" for i in range(9_000)), "é " * 30 + "É " * 30]
    for _ in range(150):
        n, k = draw.choice([1, 12, 30, 80]), draw.choice([1, 2, 3, 6])
        w = [f"v{draw.randrange(k)}" for _ in range(n)]
        if draw.random() < 0.6:
            p = draw.randrange(1, n + 1)
            w = [w[i % p] for i in range(n)] + w[: draw.randrange(5)]
        out.append(draw.choice([" ", "\n", " \x0b\x0c"]).join(w))
    rows = [(i, t) for i, t in enumerate(out)]
    return rows + [(None, out[30]), (3, out[40]), rows[50], rows[50]]


def test_find_runs(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], SCHEMA)
    expected = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = brute(w) if len(set(w)) * 50 > len(w) else [(0, 1, len(w))] if len(w) >= 12 else []
        dropped = {j for s, q, n in runs for j in range(s + q, s + n)}
        expected.append((i, len(w), [(s, n, q) for s, q, n in runs], b" ".join(x for j, x in enumerate(w) if j not in dropped).decode()))
    found = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(found, key=key) == sorted([e for e in expected], key=key)
    assert find_runs(docs.where("false")).count() == 0


def test_query_of_runs(spark, tmp_path):
    rows = [r for r in texts() if r[1] is None or len(r[1]) < 5_000]
    spark.createDataFrame([(i, t, "a", 1, "b") for i, t in rows], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    expected = con.sql(queries.ORACLES["op12_periodic_runs"])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got.select(expected.columns).collect()), key=key) == sorted(expected.fetchall(), key=key)
    # a tenth of the documents is changed first, by plain rules
    ids = [i for i, _ in rows]
    changed = [i for i, t in rows if i is not None and t and ids.count(i) == 1 and zlib.crc32(str(i).encode()) % 10 == 0]
    assert changed
    kept = {r.doc_id: r.collapsed_sha256 for r in got.where(F.col("doc_id").isin(changed)).collect()}
    for i in changed:
        w = dict(rows)[i].encode().split()
        g = zlib.crc32(str(i).encode()) // 10
        a = g % len(w) if w else 0
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (j - a) % p] for j in range(a, len(w))]
        dropped = {j for s, q, n in brute(w) for j in range(s + q, s + n)}
        assert kept[i] == hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in dropped)).hexdigest()
