"""Cleaning of stored reports against a walk through plain values."""

import copy
import json
import random

from quillscope.operators.cleaning import cleaned_reports


def safe(url):
    return isinstance(url, str) and url.split(":")[0].lower() in ("http", "https") and "://" in url


def strip_links(node):
    if isinstance(node, list):
        for x in node:
            strip_links(x)
    elif isinstance(node, dict):
        if isinstance(node.get("helpLinks"), list):
            node["helpLinks"] = [x for x in node["helpLinks"] if isinstance(x, dict) and safe(x.get("url"))]
        for k, v in node.items():
            if k != "helpLinks":
                strip_links(v)


def strip_urls(node):
    if isinstance(node, list):
        for x in node:
            strip_urls(x)
    elif isinstance(node, dict):
        verdict = node.get("conformance")
        if isinstance(verdict, dict):
            for name in ("failures", "notAssessed"):
                for f in verdict.get(name) if isinstance(verdict.get(name), list) else []:
                    if isinstance(f, dict) and not safe(f.get("url")):
                        f["url"] = ""
        for k, v in node.items():
            if k != "conformance":
                strip_urls(v)


def test_cleaned_reports(spark):
    draw = random.Random(4)
    urls = ["https://a.b/c", "javascript:x", "http://d", None, 5, "", "HTTPS://x.y"]

    def value(depth):
        kind = draw.randrange(9 if depth else 4)
        if kind < 4:
            return draw.choice([None, True, 1, 2.5, "té\"x\\", "", -7])
        if kind < 6:
            return [value(depth - 1) for _ in range(draw.randrange(4))]
        keys = draw.sample(["helpLinks", "conformance", "failures", "notAssessed", "url", "a b", 'q"k', "list"], draw.randrange(6))
        out = {}
        for k in keys:
            if k == "url":
                out[k] = draw.choice(urls)
            elif k in ("helpLinks", "failures", "notAssessed") and draw.random() < 0.8:
                out[k] = [draw.choice([{"url": draw.choice(urls), "label": "x"}, {"n": 1}, "text", value(depth - 1)]) for _ in range(draw.randrange(4))]
            else:
                out[k] = value(depth - 1)
        return out

    reports = [x for x in (value(5) for _ in range(300)) if isinstance(x, (dict, list))]
    rows = [(i, json.dumps(r)) for i, r in enumerate(reports)]
    rows += [(-1, None), (-2, "no json"), (-3, "5"), (-4, '{"categories": {"a": 1}}'), (-5, '{"categories": null}'), (-6, "{}"), (-7, "[]"), (-8, '"text"')]
    found = {r.doc_id: (r.report_json, r.error) for r in cleaned_reports(spark.createDataFrame(rows, "doc_id long, report_json string")).collect()}
    assert {i: found[i][1] for i in range(-8, 0)} == {-1: "not_an_object", -2: "not_an_object", -3: "not_an_object", -4: "categories_not_a_list", -5: None, -6: None, -7: None, -8: "not_an_object"}
    assert [found[i][0] for i in (-4, -6, -7)] == [None, "{}", "[]"]
    for i, report in enumerate(reports):
        expected = copy.deepcopy(report)
        if isinstance(report, dict) and report.get("categories") is not None and not isinstance(report["categories"], list):
            continue
        strip_links(expected)
        strip_urls(expected)
        assert json.loads(found[i][0]) == expected, (report, found[i])


def test_reports_of_any_depth(spark, monkeypatch):
    # both ways give the same, and only reports that are deep take the second
    from quillscope.operators import cleaning

    calls, by_levels = [], cleaning._by_levels
    monkeypatch.setattr(cleaning, "_by_levels", lambda root: calls.append(root.count()) or by_levels(root))
    link = '{"helpLinks":[{"url":"javascript:"},{"url":"http://a"}],"conformance":{"failures":[{"z":1,"a":"%s"}]}}'
    reports = {1: link % "x", 2: "[" * 9 + link % "y" + "]" * 9, 3: '{"a":' * 5 + "[]" + "}" * 5, 4: "no report", 5: '{"n":null,"e":{},"u":"\\u0001"}'}
    found = {r.doc_id: r.report_json for r in cleaned_reports(spark.createDataFrame(list(reports.items()), "doc_id long, report_json string")).collect()}
    clean = '{"conformance":{"failures":[{"a":"%s","z":1,"url":""}]},"helpLinks":[{"url":"http://a"}]}'
    assert found == {1: clean % "x", 2: "[" * 9 + clean % "y" + "]" * 9, 3: reports[3], 4: None, 5: '{"e":{},"n":null,"u":"\\u0001"}'}
    assert calls == [1]


def test_one_file_is_dealt(spark):
    # a report or an output is slow work: one small file must not be one task
    from quillscope.operators import validator

    one = spark.createDataFrame([(1, '{"jobs":[{"validationResult":[{"passed":true,"failedRules":[{"clause":null,"ruleId":"r","count":"2"},{"clause":"c","testNumber":3,"failedChecks":4},7]}]}]}', False)], "doc_id long, output string, exit_failed boolean").coalesce(1)
    found = validator.verdicts(one)
    assert "hashpartitioning(doc_id" in found._jdf.queryExecution().toString()
    assert [(f.rule, f.clause, f["count"]) for f in found.first().failures] == [("c-3", "c", 4), ("r", "", 1), ("unknown", "", 1)]
