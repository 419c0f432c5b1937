"""Functions that the given tables can't show: paged sources, zones, address edge
cases, cards and upkeep on small rows."""

import json

from pyspark.sql import functions as F

from quillscope.functions import dates, text, urls
from quillscope.operators import plan, records, stored
from quillscope.sources import files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_paged_publications(spark, tmp_path):
    pub = lambda i, title: {"id": f"p{i}", "title": title, "fileURL": f"https://x.gov/{i}.pdf", "publicationDate": "2020-01-01"}
    pages = [[pub(1, "a"), pub(2, "b")], [pub(2, "later"), pub(3, "c")], [pub(4, "d") | {"fileURL": "https://x.gov/4.exe"}], [pub(9, "after the last page"), pub(8, "x")]]
    for n, page in enumerate(pages):
        (tmp_path / f"page{n}.json").write_text(json.dumps({"data": {"publications": page}}))
    got = {r.id: r.title for r in files.publication_file(spark, str(tmp_path), page_size=2).collect()}
    assert got == {"p1": "a", "p2": "later", "p3": "c"}
    (tmp_path / "list.json").write_text(json.dumps([pub(1, "a")]))
    assert files.publication_file(spark, str(tmp_path / "list.json")).count() == 1


def test_times(spark):
    at = lambda x: F.lit(x).cast("timestamp")
    assert one(spark, dates.local_time(at("2026-08-03 14:22:10")), dates.local_time(at("2026-01-03 02:02:01"))) == ("Aug 3, 2026, 9:22:10 AM CDT", "Jan 2, 2026, 8:02:01 PM CST")
    assert one(spark, dates.pdf_date(F.lit("D:20241301")), dates.pdf_date(F.lit(None).cast("string")), dates.pdf_date(F.lit("D:2024011512"))) == ("D:20241301", None, "2024-01-15T12:00:00.000Z")
    assert one(spark, dates.stored_utc(F.lit("")), dates.stored_utc(F.lit("2026-08-03 14:22:10"))) == (None, "2026-08-03T14:22:10Z")


def test_addresses(spark):
    public = ["2606:4700::1111", "::ffff:808:808", "8.8.8.8", "not one", "", "1::2::3", ":::"]
    private = ["::1", "[fe80::1]", "FD00::1", "::ffff:192.168.0.1", "::ffff:c0a8:1", "127.0.0.1", "0.0.0.0", "ff05::2", "::"]
    rows = spark.createDataFrame([(x, x in private) for x in public + private], "ip string, due boolean")
    assert rows.where(urls.private_ip(F.col("ip")) != F.col("due")).count() == 0
    assert one(spark, urls.private_ip(F.lit(None).cast("string"))) == (False,)


def test_cards_of_odd_findings(spark):
    rows = spark.createDataFrame([(["  loose", "fact", None, "--- H", "  a"],), ([],), (None,), (["--- Fix in Adobe Acrobat ---"],)], "f array<string>")
    got = [r[0] for r in rows.select(plan.card(F.col("f"))).collect()]
    assert got[0].main == ["fact"] and [(g.heading, list(g["items"])) for g in got[0].signals] == [("", ["loose"]), ("H", ["a"])] and got[0].signal_count == 2
    assert got[1].main == [] and got[3].fix == [] and got[3].signals == []
    assert [r[0] for r in rows.select(text.first_actionable(F.col("f"))).collect()] == ["fact", "", "", "--- Fix in Adobe Acrobat ---"]


def test_outline_and_contrast(spark):
    heads = F.transform(F.sequence(F.lit(1), F.lit(43)), lambda i: F.struct((i % 3 + 1).alias("level"), F.repeat(F.lit("t"), i * 2).alias("text")))
    lines = one(spark, text.heading_outline(heads))[0]
    assert len(lines) == 42 and lines[1] == '  H2 "tt"' and lines[-1] == "  ... and 3 more heading(s)" and max(map(len, lines)) <= 80 + 7
    assert one(spark, records.worst_contrast(F.array().cast("array<struct<ratio:double,text:string>>"))) == (None,)


def test_purge_keeps_what_is_left(spark):
    now = F.lit("2026-01-31 00:00:00").cast("timestamp")
    jobs = spark.createDataFrame([(1, "complete", "2025-12-01 00:00:00", None), (2, "complete", "2025-12-01 00:00:00", "2026-01-30 00:00:00"), (3, "running", "2025-01-01 00:00:00", None)], "id int, status string, created string, done string")
    jobs = jobs.withColumns({"created_at": F.col("created").cast("timestamp"), "completed_at": F.col("done").cast("timestamp")})
    assert {r.id for r in stored.purge(jobs, "jobs", now).collect()} == {2, 3}
    assert tuple(stored.purge_counts(jobs, "jobs", now).first()) == ("jobs", 1, 2)
