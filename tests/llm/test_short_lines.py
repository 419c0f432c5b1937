"""Repeats of lines that are too short to be compared by edits."""

from test_operators import make

from quillscope.llm.line_dedup import dedup_lines, duplicate_lines


def test_short_repeats(spark):
    rows = [[1, "All rights reserved.\none\n\n}", "s"], [2, "two\n  All rights reserved. \n\n}", "s"], [3, "All rights reserved!\n}\n}", "s"], [4, "}", "s"]]
    gone = {(2, 1), (2, 3), (3, 1), (3, 2), (4, 0)}
    assert {(r.doc_id, r.pos) for r in duplicate_lines(make(spark, rows)).collect()} == gone
    assert {r.doc_id: r.text for r in dedup_lines(make(spark, rows)).collect()} == {1: rows[0][1], 2: "two\n", 3: "All rights reserved!"}
    assert not duplicate_lines(make(spark, rows), exact_chars=30).count()
