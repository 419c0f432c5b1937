"""Job streams, the cache sink, the paged source and validator output."""

import json
import random
from datetime import datetime, timedelta

import pytest

from quillscope.operators import validator
from quillscope.sources import paged
from quillscope.streaming import jobs, sinks

START = datetime(2024, 1, 1)


def drive(df, folder, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(folder / name)).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return query


def test_permitted_transitions(spark, tmp_path):
    statuses = ["pending", "running", "running", "complete", "running", "expired", "pending"]
    rows = [(j, i, START + timedelta(seconds=10 * i + j), s) for j in range(3) for i, s in enumerate(statuses if j < 2 else ["running", "pending", "failed", "complete"])]
    schema = "job_id long, event_id long, at timestamp, status string"
    table = spark.createDataFrame(rows, schema)
    batch = {(r.job_id, r.event_id): (r.accepted, r.state) for r in jobs.permitted(table).collect()}
    assert [batch[0, i] for i in range(7)] == [(True, "pending"), (True, "running"), (True, "running"), (True, "complete"), (False, "complete"), (True, "expired"), (False, "expired")]
    assert [batch[2, i] for i in range(4)] == [(False, ""), (True, "pending"), (True, "failed"), (False, "failed")]
    # as a stream in two parts, the second after a stop; then time goes on
    (tmp_path / "in").mkdir()
    spark.createDataFrame([r for r in rows if r[1] < 3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    stream = jobs.job_transitions(source)
    out = str(tmp_path / "out")

    def run():
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination(180)
        assert query.exception() is None

    run()
    spark.createDataFrame([r for r in rows if r[1] >= 3] + [(9, 0, START + timedelta(hours=1), "pending")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([(8, 0, START + timedelta(hours=3), "pending")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    found = spark.read.parquet(out)
    got = {(r.job_id, r.event_id): (r.accepted, r.state) for r in found.where("event_id is not null and job_id < 3").collect()}
    assert got == batch
    hung = [(r.job_id, r.state) for r in found.where("event_id is null").collect()]
    assert (9, "failed") in hung and not {0, 1, 2} & {j for j, _ in hung}


def test_cache_sink_counts_a_batch_once(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "url string, error_message string, permanent boolean, audited_at timestamp"
    at = lambda n: START + timedelta(minutes=n)
    first = spark.createDataFrame([("a", None, None, at(1)), ("b", "404", True, at(1)), ("a", "late", False, at(0))], schema)
    second = spark.createDataFrame([("b", None, None, at(2)), ("c", "timeout", False, at(2))], schema)
    state = lambda: {r.url: (r.status, r.error_message) for r in sinks.current_cache(spark, path).collect()}
    assert state() == {} and sinks.compact_cache(spark, path) is None
    sinks.write_batch(first, 0, path)
    sinks.write_batch(second.limit(1), 1, path)  # an attempt that crashed half way
    sinks.write_batch(second, 1, path)
    sinks.write_batch(second, 1, path)
    expected = {"a": ("success", None), "b": ("success", None), "c": ("error", "timeout")}
    assert state() == expected
    before = sinks.current_cache(spark, path)
    (tmp_path / "cache" / "compacted" / "upto=7").mkdir(parents=True)  # a compaction that was cut off
    assert sinks.compact_cache(spark, path) == 1 and sinks.compact_cache(spark, path) == 1
    sinks.write_batch(spark.createDataFrame([("c", None, None, at(1))], schema), 2, path)
    assert state() == expected | {"c": ("success", None)}
    assert {r.url: r.status for r in before.collect()} == {"a": "success", "b": "success", "c": "error"}
    # as a stream that is stopped and run again
    spark.createDataFrame([("d", None, None, at(9))], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        query = sinks.cache_upserts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "c2"), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert [r.url for r in sinks.current_cache(spark, str(tmp_path / "c2")).collect()] == ["d"]


@pytest.mark.parametrize("n", [0, 7, 20])
def test_paged_listing(spark, tmp_path, n):
    rows = [{"id": str(i % 15), "title": f"t{i}", "fileURL": f"f{i}.{'pdf' if i % 4 else 'zip'}", "tags": ["x"] if i % 2 else None} for i in range(n)]
    for start in range(0, n + 1, 5):
        (tmp_path / f"{start}.json").write_text(json.dumps({"data": {"publications": rows[start : start + 5]}}))
    url = f"file://{tmp_path}/{{start}}.json"
    last = {r["id"]: r for r in rows}
    expected = sorted((i, r["title"]) for i, r in last.items() if r["fileURL"].endswith("pdf"))
    assert sorted((r.id, r.title) for r in paged.listing(spark, url, 5, 3).collect()) == expected
    drive(paged.listing_stream(spark, url, 5), tmp_path, f"listed{n}")
    assert spark.table(f"listed{n}").count() == n


def plain(text, failed):
    """The verdict by a walk through plain values."""
    none = dict(passed=False, profile="ua1", failures=[], total=0, distinct=0)
    if failed and not text:
        return none | {"error": "no_output"}
    try:
        root = json.loads(text or "")
    except ValueError:
        return none | {"error": "unparseable"}
    get = lambda x, k: x.get(k) if isinstance(x, dict) else None
    report = get(root, "report") if get(root, "report") is not None else root
    listed = get(report, "jobs") if get(report, "jobs") is not None else get(root, "jobs")
    result = get(listed[0], "validationResult") if isinstance(listed, list) and listed else None
    if isinstance(result, list):
        result = result[0] if result else None
    if result is None:
        return none | {"error": "no_result"}
    text_of = lambda r, *ks: next((r[k] for k in ks if isinstance(r.get(k), str)), None)
    rules, details = [], get(result, "details") or {}
    for r in next((x for x in (details.get("ruleSummaries"), result.get("ruleSummaries"), result.get("failedRules")) if x is not None), []):
        clause = r.get("clause") if isinstance(r.get("clause"), str) else ""
        name = f"{clause}-{r['testNumber']}" if clause and r.get("testNumber") is not None else text_of(r, "specification", "ruleId", "id") or "unknown"
        count = next((r[k] for k in ("failedChecks", "count") if r.get(k) is not None), 1)
        if count > 0:
            rules.append((name, count))
    rules_total = sum(n for _, n in rules)
    total = details["failedChecks"] if isinstance(details.get("failedChecks"), int) else rules_total
    passed = any(result.get(k) is True for k in ("isCompliant", "compliant", "passed")) and not failed
    profile = text_of(result, "profileName") or (get(result, "profile") or {}).get("id") or "ua1"
    return dict(passed=passed, profile=profile, failures=sorted(rules, key=lambda r: -r[1])[:20], total=total, distinct=len(rules), error=None)


def test_validator_verdicts(spark):
    draw, rows = random.Random(8), [(0, None, True), (1, "", False), (2, "", True), (3, "no json", False), (4, "[]", False), (5, '{"jobs":[]}', False), (6, '{"jobs":[{"validationResult":[]}]}', False), (7, '{"report":null,"jobs":[{"validationResult":{"compliant":"true"}}]}', False)]
    for i in range(8, 200):
        def rule():
            return {k: v for k, v in {"clause": draw.choice(["7.1", "7.2", 5]), "testNumber": draw.choice([1, 2, None]), "specification": "ISO", "ruleId": "r1", "id": "i2", "failedChecks": draw.choice([0, 3, 9]), "count": draw.choice([2, 0]), "description": "d"}.items() if draw.random() < 0.6}
        rules = [rule() for _ in range(draw.choice([0, 1, 5, 30]))]
        result = {draw.choice(["isCompliant", "compliant", "passed"]): draw.choice([True, False])}
        if draw.random() < 0.5:
            result |= draw.choice([{"profileName": "P"}, {"profile": {"id": "Q"}}])
        place = draw.randrange(4)
        result |= [{"details": {"ruleSummaries": rules, "failedChecks": 77, "failedRules": 3}}, {"ruleSummaries": rules}, {"failedRules": rules}, {"details": {"ruleSummaries": rules}}][place]
        whole = {"jobs": [{"validationResult": draw.choice([result, [result, {"passed": True}]])}]}
        rows.append((i, json.dumps(draw.choice([whole, {"report": whole}, {"report": whole, "jobs": []}])), draw.random() < 0.2))
    outputs = spark.createDataFrame(rows, "doc_id long, output string, exit_failed boolean")
    for r in validator.verdicts(outputs).collect():
        _, text, failed = rows[r.doc_id]
        got = dict(passed=r.passed, profile=r.profile, failures=[(f.rule, f["count"]) for f in r.failures], total=r.total_failures, distinct=r.distinct_rules, error=r.error)
        assert got == plain(text, failed), (rows[r.doc_id], got)
