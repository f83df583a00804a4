import datetime as dt

from missive.operators import history as H
from missive.streaming import stream as ST
from tests.conftest import SF001


def test_stream_kpis_equal_batch(spark, tmp_path):
    out, ck = str(tmp_path / "k"), str(tmp_path / "kc")
    ST.run_live_kpis(ST.history_stream_from_events(spark, SF001), out, ck).awaitTermination()
    got = ST.latest_per_key(out, spark, []).first().asDict()
    from missive.sources import tables
    want = H.kpis(tables.history(spark, SF001)).first().asDict()
    assert got == want


def test_trend_replay_and_late_rows(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    schema = "id long, is_spam int, confidence double, timestamp timestamp"
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)
    spark.createDataFrame([(1, 1, 80.0, t0), (2, 0, 60.0, t0 + dt.timedelta(minutes=70))], schema) \
        .coalesce(1).write.parquet(str(src / "b1"))
    out, ck = str(tmp_path / "o"), str(tmp_path / "c")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(src / "*"))
        ST.run_certainty_trend(stream, out, ck).awaitTermination()

    run()
    # A row far behind the watermark (window 10:00 already closed at 11:10 - 10 min).
    spark.createDataFrame([(3, 1, 10.0, t0 + dt.timedelta(minutes=5))], schema).coalesce(1).write.parquet(str(src / "b2"))
    run()
    run()   # replay with nothing new: no duplicates
    res = {r["window_start"]: (r["scans"], r["spam_count"]) for r in ST.latest_per_key(out, spark, ["window_start", "window_end"]).collect()}
    assert res == {t0: (1, 1), t0 + dt.timedelta(hours=1): (1, 0)}


class _KeywordClassifier:
    """Stand-in scorer with the Classifier.score output columns."""

    def score(self, df, text_col="text"):
        from pyspark.sql import functions as F
        spam = F.lower(F.col(text_col)).contains("cash")
        return (df.withColumn("is_spam", spam)
                .withColumn("spam_probability", F.when(spam, 0.9).otherwise(0.1))
                .withColumn("confidence_score", F.lit(80.0))
                .withColumn("model_name", F.lit("rule")).withColumn("vectorizer_name", F.lit("none")))


def test_score_stream_appends_once_and_continues_ids(spark, tmp_path):
    src, hist, ck = tmp_path / "in", str(tmp_path / "hist"), str(tmp_path / "ck")
    src.mkdir()
    spark.createDataFrame([("free cash now",), ("hello",)], "text string").coalesce(1).write.parquet(str(src / "f1"))

    def run():
        stream = spark.readStream.schema("text string").parquet(str(src / "*"))
        ST.score_stream(stream, _KeywordClassifier(), hist, ck).awaitTermination()

    run()
    run()   # replay with nothing new: nothing appended
    assert spark.read.parquet(hist).count() == 2
    spark.createDataFrame([("cash prize",)], "text string").coalesce(1).write.parquet(str(src / "f2"))
    run()
    rows = spark.read.parquet(hist).collect()
    assert sorted(r["id"] for r in rows) == [1, 2, 3]
    assert sum(r["is_spam"] for r in rows) == 2
