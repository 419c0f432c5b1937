"""Searches of integer vectors against the SQL of their queries: many blocks and
rounds, ties, repeated rows, several lengths, values that don't take part."""

import random

import duckdb
import numpy as np
import pytest

from quillscope.llm import _vector_blocks as vb
from quillscope.llm import maxscore, queries

SCHEMA = "vec_id long, embedding array<float>, label int, id string, key int, v string, code string, score int, rank string"


def vectors(seed, n=700, dim=12):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(9, dim))
    rows = []
    for i in range(n):
        x = centres[i % 9] * draw.uniform(0.5, 1.5) + draw.normal(size=dim) * draw.choice([0.05, 0.3, 1.0])
        rows.append([i, [float(np.float32(c)) for c in x], int(draw.integers(0, 10))])
    for i in range(60, 140):  # copies: ties in every score
        rows[i][1] = rows[60][1]
    rows[200][1], rows[201][1], rows[202][1] = None, [None] + rows[1][1][1:], [float("nan")] + rows[1][1][1:]
    rows[203][1], rows[204][1], rows[205][2], rows[300][2] = [float("inf")] * dim, [0.0] * dim, None, None
    rows[206][1], rows[207][1], rows[400][1] = [], [], []
    for i in range(500, 520):
        rows[i][1] = rows[i][1][:5]
    rows += [[None, rows[3][1], 1], [100, rows[100][1], rows[100][2]], [100, rows[7][1], 3], [40, rows[40][1], rows[40][2]], [41, rows[41][1], rows[41][2]], [41, rows[41][1], rows[41][2]], [200, rows[8][1], 2]]
    random.Random(seed).shuffle(rows)
    return rows


def same_as_sql(spark, tmp_path, name, rows):
    spark.createDataFrame([(i, x, c, "a", 1, "b", "c", 5, "d") for i, x, c in rows], SCHEMA).coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    expected = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, str(tmp_path)).select(expected.columns)
    assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
    return expected.fetchall()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_maxscore"])
def test_search_in_many_blocks(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(vb, "BLOCK", 12 * 40)
    monkeypatch.setattr(vb, "CHUNK", 12 * 8)
    rows = vectors(1)
    if name == "op13_maxscore":
        rows = [r for r in rows if r[1] != []]
        rows += [[i, [], 0] for i in (20, 21)]
    assert len(same_as_sql(spark, tmp_path, name, rows)) > 100


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_maxscore"])
@pytest.mark.parametrize("rows", [[], [[0, [0.5, 0.25], 1]], [[i * 100, None, 1] for i in range(3)], [[i, [0.5, -0.25], i % 2] for i in range(120)]])
def test_search_in_small_tables(spark, tmp_path, name, rows):
    same_as_sql(spark, tmp_path, name, rows)


def test_rows_that_compete_stand_in_essential_layers():
    """Rows left out by the split can't reach the threshold, whatever the signs."""
    draw = np.random.default_rng(4)
    x = draw.integers(-40, 40, (300, 10))
    q = draw.integers(-30, 30, (25, 10))
    lists = np.argsort(x.T, axis=1, kind="stable")
    cuts = np.arange(maxscore.LAYERS + 1) * 300 // maxscore.LAYERS
    at = np.arange(10)[:, None]
    heads, tails = x[lists[at, np.maximum(299 - cuts, 0)], at], x[lists[at, np.minimum(cuts, 299)], at]
    scores = q @ x.T
    threshold = np.sort(scores, axis=1)[:, -5]
    read, due = maxscore._split(q.astype(float), heads.astype(float), tails.astype(float), threshold.astype(float))
    assert due.all()
    for i in range(25):
        marked = set()
        for j in range(10):
            n = cuts[read[i, j]]
            marked |= set(lists[j, 300 - n :] if q[i, j] >= 0 else lists[j, :n])
        assert set(np.flatnonzero(scores[i] >= threshold[i])) <= marked


def test_large_components_raise(spark):
    rows = spark.createDataFrame([(0, [1e30], 0), (20, [1.0], 0)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="32 bits"):
        maxscore.top_k(rows, rows.vec_id == 0).collect()


def test_links_among_vectors_with_a_common_direction(spark):
    """Pairs at 0.90 to 0.92 among vectors of mean cosine 0.7, as text embeddings
    are: found without a search of everything against everything."""
    from quillscope.llm.embedding_dedup import embedding_links

    draw = np.random.default_rng(11)
    x = draw.normal(size=(3000, 48))
    x = x / np.linalg.norm(x, axis=1)[:, None] * 0.6 + np.eye(48)[0]
    for i in range(0, 120, 2):  # pairs at a stated cosine
        a = x[i] / np.linalg.norm(x[i])
        b = draw.normal(size=48)
        b -= (b @ a) * a
        cosine = draw.uniform(0.901, 0.92)
        x[i + 1] = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    true = (unit @ unit.T >= 0.9).sum(1) - 1
    assert 0.6 < (unit[200:700] @ unit[1000:1500].T).mean() < 0.8 and true.sum() >= 120
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    links, figures = embedding_links(table)
    found = {r.id: r.n_links for r in links.collect()}
    assert all(found[i] <= true[i] for i in range(3000))
    assert sum(found.values()) >= 0.97 * true.sum()
    assert figures[48]["recall"] is None or figures[48]["recall"] >= 0.97
    _, none = embedding_links(spark.createDataFrame([(i, np.eye(40)[i % 40].tolist()) for i in range(40)], table.schema))
    assert none[40]["recall"] is None


def test_near_duplicates_send_bounded_blocks(spark, monkeypatch):
    from quillscope.llm import embedding_dedup as ed

    plans, write = [], ed.stash
    monkeypatch.setattr(ed, "stash", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, *a))
    # wanted nodes go out a few at a time, neighbours meet in several parts
    monkeypatch.setattr(ed, "QUERIES", 32)
    monkeypatch.setattr(ed, "HELD", 1 << 13, raising=False)
    monkeypatch.setattr(ed, "PART", 1 << 17, raising=False)
    draw = np.random.default_rng(6)
    x = draw.normal(size=(400, 16))
    x[200:] = x[:200] + draw.normal(size=(200, 16)) * 0.2
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (y @ y.T >= 0.9) & ~np.eye(400, dtype=bool)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    links, figures = ed.embedding_links(table, audit=32)
    assert {r.id: r.n_links for r in links.collect()} == dict(enumerate(near.sum(1)))
    assert near.sum() > 200 and figures[16]["recall"] == 1.0
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    # what is sent isn't multiplied before
    sent = [p for p in plans if "BroadcastExchange" in p]
    assert len(sent) > 1 and not any("explode" in p for p in sent)
