"""Column functions on tables of cases, and the cap for every score."""

from pyspark.sql import functions as F

from quillscope.functions import color, numbers, text, urls
from quillscope.operators import lifecycle, scoring


def values(spark, cases, f):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def check(spark, cases, f):
    assert values(spark, cases, f) == [y for _, y in cases]


def test_text(spark):
    check(spark, [("Click here!", "needsFix"), (" ", "needsFix"), (None, "needsFix"), ("https://a.b", "rawUrl"), ("www.x", "rawUrl"), ("ab", "needsFix"), ("Annual report", "descriptive"), (" more　", "needsFix")], text.classify_link)
    check(spark, [("report.pdf", True), ("Introduction", False), ("COVID-19", False), ("annual_report", True), ("a-b-c", True), ("Microsoft Word - x", True), ("Report 20240115120000", True), ("", False), ("Budget2024forAllDepartments", True)], text.filename_like)
    check(spark, [("Decorative border", "decorative"), ("Photo of decorative work", None), ("deadbeef" * 4, "hex"), ("image", "placeholder"), ("IMG_1.jpg", "filename"), ("éééééé", "non_ascii"), ("", None)], text.suspicious_alt)
    check(spark, [("=1+1", "'=1+1"), ("a,b", '"a,b"'), ('say "x"', '"say ""x"""'), (None, ""), ("-5,6", "\"'-5,6\""), ("plain", "plain")], text.csv_field)
    check(spark, [("• item", True), ("1. item", True), ("2) x", True), ("-x", False), (None, False)], text.manual_bullet)
    check(spark, [("a b/ü", "a%20b%2F%C3%BC"), ("it's(1)!", "it's(1)!")], text.percent_encode)


def test_color_and_urls(spark):
    check(spark, [("#ffffff", "FFFFFF"), ("12345", None), (None, None)], color.normal_hex)
    r = spark.range(1).select(color.contrast(F.lit("000000"), F.lit("FFFFFF")), color.contrast(F.lit("777777"), F.lit("FFFFFF"))).first()
    assert abs(r[0] - 21) < 1e-9 and abs(r[1] - 4.478) < 1e-3
    check(spark, [("https://a.example.com/x", "ok"), ("ftp://a.example.com", "scheme"), ("http://10.0.0.1/", "private"), ("nope", "malformed"), ("http://badexample.com", "not_listed")], lambda x: urls.url_decision(x, ("example.com",)))
    check(spark, [("10.1.1.1", True), ("8.8.8.8", False), ("172.20.0.1", True), ("224.0.0.1", True), ("999.1.1.1", False), (None, False)], urls.private_v4)


def test_cap_for_every_score(spark):
    rows = spark.range(101).select(F.col("id").cast("int").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("rank"))
    rows = rows.select("s", "rank", numbers.capped(F.col("s"), F.col("rank")).alias("c")).withColumn("again", numbers.capped(F.col("c"), F.col("rank"))).collect()
    most = {0: 100, 1: 89, 2: 79, 3: 69}
    assert all(r.c == min(r.s, most[r["rank"]]) == r.again for r in rows)
    assert [r[0] for r in spark.createDataFrame([(-2.5,), (2.5,), (0.49,)], "x double").select(numbers.half_up(F.col("x"))).collect()] == [-2, 3, 0]


def test_lcs(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 3, 2, 4]), ([1], [2]), ([1, 1, 2], [1, 2, 1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(scoring.lcs_length(F.col("a"), F.col("b"))).collect()] == [3, 0, 2]


def test_admissions_do_not_count_refusals(spark):
    times = [0, 10, 20, 30, 101, 111]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "key long, request_id long, t long").select("key", "request_id", F.timestamp_seconds("t").alias("at"))
    got = [r.admitted for r in lifecycle.admissions(df, 2, 100).orderBy("request_id").collect()]
    assert got == [True, True, False, False, True, True]
