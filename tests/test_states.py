"""Text states that are saved and restored together."""

from quillscope.operators import trees


def test_fonts_and_modes_share_one_matching(spark, monkeypatch):
    calls, matched = [], trees.matched
    monkeypatch.setattr(trees, "matched", lambda *a: calls.append(a) or matched(*a))
    ops = [("font", "A", None, None), ("save", None, None, None), ("font", "B", None, None), ("mode", None, 3, None), ("show", None, None, "hidden"), ("restore", None, None, None), ("show", None, None, "seen"), ("restore", None, None, None), ("show", None, None, "again")]
    rows = [(1, 0, i, *op) for i, op in enumerate(ops)] + [(2, 0, 0, "show", None, None, "bare")]
    found = trees.visible_fonts(spark.createDataFrame(rows, "doc_id long, page int, ord long, op string, font string, mode int, text string"))
    assert sorted(map(tuple, found.collect())) == [(1, ["A"], False), (2, [], True)]
    assert len(calls) == 1
