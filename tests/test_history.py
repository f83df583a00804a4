import datetime as dt

from pyspark.sql import functions as F

from missive.operators import history as H
from missive.sources.history_store import HISTORY_SCHEMA

TS = dt.datetime(2024, 1, 5, 3, 4, 5)


def _hist(spark, texts):
    rows = [(i + 1, t, i % 2, 0.25 + 0.1 * (i % 3), 50.0 + i, "LR", "TF-IDF", 1.5, TS + dt.timedelta(minutes=i))
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def test_search_case_and_wildcards(spark):
    df = _hist(spark, ["Win CASH now", "50% off", "a_b", "path\\", "nothing"])
    ids = lambda q: sorted(r["id"] for r in H.get_history(df, 100, search_query=q).collect())
    assert ids("cash") == [1]
    assert ids("%") == [1, 2, 3, 4, 5]          # user % acts as a wildcard
    assert ids("a_b") == [3]
    assert ids("h\\") == [4]                     # trailing backslash is literal, not an error
    assert ids("") == [1, 2, 3, 4, 5]


def test_label_filter_and_limit(spark):
    df = _hist(spark, [f"m{i}" for i in range(10)])
    assert {r["is_spam"] for r in H.get_history(df, 100, label_filter="SPAM").collect()} == {1}
    assert {r["is_spam"] for r in H.get_history(df, 100, label_filter="ham").collect()} == {0}
    assert H.get_history(df, 100, label_filter="All").count() == 10
    assert H.get_history(df, 100, label_filter="other").count() == 10
    top = [r["id"] for r in H.get_history(df, 3).collect()]
    assert top == [10, 9, 8]
    assert H.get_history(df, 50).count() == 10


def test_kpis_empty_and_full(spark):
    empty = spark.createDataFrame([], HISTORY_SCHEMA)
    r = H.kpis(empty).first()
    assert (r["total_scans"], r["total_spam"], r["spam_percentage"], r["avg_confidence"], r["avg_latency"]) == (0, 0, 0.0, 0.0, 0.0)
    r = H.kpis(_hist(spark, ["a", "b", "c"])).first()
    assert (r["total_scans"], r["total_spam"], r["total_ham"]) == (3, 1, 2)
    assert r["spam_percentage"] == 33.33 and r["avg_confidence"] == 51.0


def test_trend_oldest_50_numbered(spark):
    df = _hist(spark, [f"m{i}" for i in range(60)])
    t = H.trend(df).orderBy("scan_no").collect()
    assert len(t) == 50 and t[0]["id"] == 1 and t[-1]["scan_no"] == 50
    assert len(H.trend(_hist(spark, ["x", "y"])).collect()) == 2


def test_display_formats(spark):
    r = H.display(_hist(spark, ["x"])).first()
    assert r["scanned_at"] == "Jan 05, 2024 - 03:04:05"
    assert r["probability"] == "25.0%" and r["confidence"] == "50.0%" and r["execution_time"] == "1.5 ms"
    assert r["spam_prediction"] == "Safe ✅"


def test_unparsable_timestamp_text_passes_through(spark):
    from missive.functions.display import format_scan_time
    df = spark.createDataFrame([("not a date",), ("2024-01-05T03:04:05",)], "ts string")
    got = [r["f"] for r in df.select(format_scan_time(F.col("ts")).alias("f")).collect()]
    assert got == ["not a date", "Jan 05, 2024 - 03:04:05"]
