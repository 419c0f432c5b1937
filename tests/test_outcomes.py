"""Outcomes, regrading, prompts and form fields as the result pages show them."""

import json


from pyspark.sql import functions as F

from quillscope.operators import lifecycle, records, reports, scoring

ROWS = "doc_id long, id string, ord int, score int, severity string"


def severity(score):
    return None if score is None else "No issues found" if score == 100 else "Minor" if score >= 70 else "Moderate" if score >= 40 else "Critical"


def categories(spark, docs):
    rows = [(d, i, n, s, severity(s)) for d, cats in docs.items() for n, (i, s) in enumerate(cats)]
    return spark.createDataFrame(rows, ROWS)


def test_outcome(spark):
    before = categories(spark, {1: [("a", 100), ("b", 60), ("c", None), ("d", 60), ("gone", 30), ("clean", 100)], 2: [("x", 20), ("y", 50), ("z", 80)], 3: [("q", 100)]})
    after = categories(spark, {1: [("a", 100), ("b", None), ("c", 50), ("d", 60), ("e", 100)], 2: [("z", 85), ("y", 30), ("x", 30), ("w", 75)], 3: [("q", None)]})
    found = lifecycle.outcome(before, after)
    assert {(r.doc_id, r.id): (r.before, r.after, r.delta, r.severity, r.disposition) for r in found.collect()} == {
        (1, "b"): (60, None, None, "No issues found", "fixed"), (1, "c"): (None, 50, None, "Moderate", "new"), (1, "d"): (60, 60, 0, "Moderate", "unchanged"), (1, "gone"): (30, None, None, "Critical", "unchanged"),
        (2, "x"): (20, 30, 10, "Critical", "improved"), (2, "y"): (50, 30, -20, "Critical", "declined"), (2, "z"): (80, 85, 5, "Minor", "improved"), (2, "w"): (None, 75, None, "Minor", "new"),
    }
    lists = {r.doc_id: (r.still_flagged, r.fixed) for r in lifecycle.outcome_order(found).collect()}
    assert lists == {1: (["gone", "c", "d"], ["b"]), 2: (["y", "x", "z", "w"], [])}


def test_severity_decides_not_the_score(spark):
    row = lambda s, score: spark.createDataFrame([(1, "a", 0, score, s)], ROWS)
    assert lifecycle.outcome(row("Minor", 100), row("No issues found", 90)).first().disposition == "fixed"
    assert lifecycle.outcome(row("No issues found", 90), row("Moderate", 100)).first().disposition == "improved"
    assert lifecycle.outcome(row("No issues found", 20), row(None, 10)).count() == 0


def test_regrade(spark):
    cat = lambda weight, score, **more: {"weight": weight, "score": score, "severity": severity(score), **more}
    reports_ = {
        1: {"overallScore": 95, "grade": "A", "categories": [cat(-1, 10)]}, 2: {"overallScore": 71, "grade": "C", "categories": [cat(0.5, 80), cat(0.5, None)]},
        3: {"overallScore": 40, "grade": "old", "categories": [cat(-1, 90), cat(0.5, 10)]}, 4: {"overallScore": 88, "grade": "B", "isScanned": True, "categories": [cat(1, 88)]},
        5: {"overallScore": 77, "grade": "x"}, 6: {"grade": "x", "categories": [cat(1, 50)]}, 7: {"overallScore": 90, "grade": "A", "categories": []},
        8: {"overallScore": 66, "grade": "D", "categories": [cat(None, None, not_assessed=True), cat(0.3, 100)], "scoreProfiles": {"strict": {"overallScore": 99, "grade": "A", "categories": [cat(1, 45)]}, "other": {"overallScore": 12, "grade": "kept"}}},
    }
    stored = spark.createDataFrame([(i, json.dumps(r)) for i, r in reports_.items()] + [(9, "no json")], "doc_id long, report_json string")
    found = {r.doc_id: (r.overall_score, r.grade, r.changed) for r in scoring.regrade(stored).collect()}
    assert found == {1: (69, "D", True), 2: (89, "B", True), 3: (40, "old", False), 4: (0, "F", True), 5: (77, "x", False), 6: (None, "x", False), 7: (90, "A", False), 8: (100, "A", True), 9: (None, None, False)}
    profiles = scoring.regrade(stored).where("doc_id = 8").first().profiles
    assert {k: tuple(v) for k, v in profiles.items()} == {"strict": (45, "F", True), "other": (12, "kept", False)}


def test_prompts(spark):
    rows = [(1, i, s, n) for i, s, n in [("alt_text", None, True), ("alt_text", None, False), ("bookmarks", None, True), ("bookmarks", 100, False), ("list_structure", 100, False), ("slide_titles", 100, False), ("sheet_names", 100, False), ("link_quality", 99, False)]]
    found = reports.manual_checks(spark.createDataFrame(rows, "doc_id long, id string, score int, not_assessed boolean"))
    assert sorted((r.id, r.manual) for r in found.collect()) == [("alt_text", "caution"), ("bookmarks", "check")]


def test_form_fields_once(spark):
    rows = [(1, 10, 5, None, False, True), (1, 10, 5, None, False, True), (1, 5, 4, "", False, False), (1, 5, 4, "", False, False), (1, 4, None, "Name", False, False), (1, 11, None, "own", False, True), (1, 12, 99, None, False, True), (1, 13, 4, "x", True, True)]
    found = records.form_fields(spark.createDataFrame(rows, "doc_id long, ref long, parent long, label string, hidden boolean, is_field boolean"))
    assert sorted((r.field, r.label or "") for r in found.collect()) == [(10, "Name"), (11, "own"), (12, "")]


def test_publications_from_pages_and_files(spark, tmp_path):
    from quillscope.sources import files

    (tmp_path / "a").mkdir()
    page = lambda rows: json.dumps({"data": {"publications": rows}})
    row = lambda i, url: {"id": i, "title": f"t{i}", "fileURL": url}
    (tmp_path / "a" / "1.json").write_text(page([row("1", "x.pdf"), row("2", "y.docx")]))
    (tmp_path / "a" / "2.json").write_text(page([row("1", "x.zip")]))
    read = files.publication_file
    # the last row of an id counts, and that one can't be audited
    assert sorted(r.id for r in read(spark, str(tmp_path / "a"), page_size=2).collect()) == ["2"]
    (tmp_path / "b.json").write_text(json.dumps([row("1", "x.pdf"), row("1", "z.pptx"), row("3", "x.txt")]))
    assert sorted(r.fileURL for r in read(spark, str(tmp_path / "b.json")).collect()) == ["x.pdf", "z.pptx"]


def test_scores_are_worked_out_once(spark):
    # a score is named several times; each name must not bring its whole expression
    assert str(scoring.regraded(F.col("r"))).count("overallScore") < 20
    assert str(scoring.weighted_score(F.col("c"))).count("not_assessed") == 1
