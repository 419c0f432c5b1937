"""The export of publications has all rows, in order."""

from quillscope.plans.queries import QUERIES


def test_all_publications_newest_first(spark, tmp_path):
    docs = [(i, f"text {i}", "en", f"s{i % 3}", 6) for i in range(250)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["all_publications_newest_first"](spark, str(tmp_path)).collect()]
    assert len(got) == 250
    # dates run from new to old, missing ones last; equal dates by title
    assert got == sorted(sorted(got, key=lambda r: (r[2], r[0])), key=lambda r: r[1] or "", reverse=True)
