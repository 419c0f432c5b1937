"""Rows of one doc_id with other texts are documents of their own."""

import duckdb

from quillscope.llm import queries
from quillscope.llm.line_dedup import dedup_lines
from quillscope.llm.ngram_join import keep_one_of_each, ngram_components

SCHEMA = "doc_id long, text string, _line_owner string, _line_mark int, mark long, rep int"
LONG = "a line of this length that stands in several of the texts"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def test_lines_of_rows_that_share_an_id(spark, tmp_path):
    rows = [
        (1, LONG), (2, "a unique line that nobody else has at all\nend one"), (2, LONG + "\nend two"),
        (3, "a line of this length that stands in several of the text"), (3, "another text of the third document\n" + LONG.upper()),
        (3, "another text of the third document\n" + LONG.upper()), (4, LONG.upper()), (None, LONG), (5, None), (5, ""), (5, "end one"),
        (6, LONG.replace("length", "lengtj") + "\nq"), (6, LONG.lower().replace("several", "sevral") + "\nr"),
    ]
    docs = make(spark, rows)
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    left = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert left == sorted([
        (1, LONG), (2, "a unique line that nobody else has at all\nend one"), (2, "end two"), (3, rows[4][1]), (3, rows[5][1]), (0, LONG),
        (5, ""), (5, ""), (6, "q"), (6, "r"),
    ])
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("op9_line_dedup", "long_line_dedup"):
        expected = con.sql(queries.ORACLES[name])
        key = lambda r: tuple((x is None, x) for x in r)
        got = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(expected.columns).collect()]
        assert sorted(got, key=key) == sorted(expected.fetchall(), key=key)


def test_documents_of_rows_that_share_an_id(spark):
    base, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, base), (2, base), (2, other), (5, other + " end"), (7, base + " b"), (7, base + " c"), (7, "alone"), (8, "pair x y z w u v"), (8, "pair x y  z w u v"), (9, None), (9, ""), (None, base), (1, base)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in keep_one_of_each(make(spark, rows)).collect())
    pair = [t for i, t in kept if i == 8]
    assert len(pair) == 1 and pair[0] in ("pair x y z w u v", "pair x y  z w u v")
    assert [r for r in kept if r[0] != 8] == sorted([(1, base), (1, base), (2, other), (7, "alone"), (9, ""), (9, ""), (0, base)])
    found = sorted((r.doc_id, r.component_id) for r in ngram_components(make(spark, rows)).collect() if r.doc_id is not None)
    assert found == sorted([(1, 1), (1, 1), (2, 1), (2, 2), (5, 2), (7, 1), (7, 1), (7, 7), (8, 8), (8, 8), (9, 9), (9, 9)])


def test_totals_planned_before_a_retry(spark, tmp_path):
    """A reader that has planned its files finds them beside retries and one
    compaction."""
    from quillscope.llm.token_counts import TokenRollup, count_words, signed

    docs = spark.createDataFrame([(1, "one two", "s", "en"), (2, None, "s", "en")], "doc_id long, text string, source string, lang string")
    rollup = TokenRollup(spark, f"file://{tmp_path}/rollup")
    rollup.commit("a", signed(count_words(docs), 1))
    first = rollup.totals()
    rollup.commit("a", signed(count_words(docs.where("doc_id = 1")), 1))
    second = rollup.totals()
    rollup.commit("b", signed(count_words(docs), 1))
    rollup.compact()
    rows = lambda df: [(r.docs, r.tokens) for r in df.collect()]
    assert rows(first) == [(2, 2)] and rows(second) == [(1, 2)] and rows(rollup.totals()) == [(3, 4)]
    rollup.commit("c", signed(count_words(docs), -1))
    before = rollup.totals()
    rollup.compact()
    assert rows(before) == rows(rollup.totals()) == [(1, 2)]
