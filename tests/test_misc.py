"""Small sinks and aggregates: processed set round trip, batch CSV, dataset
stats on empty input, class distribution, per-model map."""

import datetime as dt

from missive.operators import history as H
from missive.operators import stats
from missive.sources import ingest
from missive.sources.history_store import HISTORY_SCHEMA


def test_processed_round_trip_drops_empty(spark, tmp_path):
    df = spark.createDataFrame([("spam", "a", "win cash"), ("ham", "b", ""), ("ham", "c", None), ("ham", "d", "nan")],
                               "label string, text string, clean_text string")
    path = str(tmp_path / "processed")
    ingest.write_processed(df, path)
    got = sorted(r["clean_text"] for r in ingest.read_processed(spark, path).collect())
    assert got == ["nan", "win cash"]           # 'nan' is text here, not a missing value
    assert ingest.processed_path("/pool", 3) == "/pool/processed/v3"


def test_batch_results_csv(spark, tmp_path):
    df = spark.createDataFrame([("1", 'say "hi", ok', True, 0.9, 80.0)],
                               "id string, text string, is_spam boolean, spam_probability double, confidence_score double")
    path = str(tmp_path / "out")
    ingest.write_batch_results(df, path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).first()
    assert back["text"] == 'say "hi", ok' and back["is_spam"] == "true"


def test_dataset_stats_empty_and_distribution(spark):
    empty = spark.createDataFrame([], "label string")
    r = stats.dataset_stats(empty).first()
    assert (r["total"], r["spam"], r["ham"], r["spam_percentage"]) == (0, 0, 0, 0.0)
    df = spark.createDataFrame([("spam",), ("ham",), ("ham",)], "label string")
    r = stats.dataset_stats(df).first()
    assert (r["total"], r["spam"], r["ham"], r["spam_percentage"]) == (3, 1, 2, 33.33)
    dist = {x["label"]: x["count"] for x in stats.class_distribution(stats.dataset_stats(df)).collect()}
    assert dist == {"ham": 2, "spam": 1}


def test_model_stats_map(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [(i + 1, "t", 0, 0.1, 50.0, m, "TF-IDF", 1.0, ts) for i, m in enumerate(["LR", "LR", "NB"])]
    df = spark.createDataFrame(rows, HISTORY_SCHEMA)
    assert H.model_stats_map(df).first()["model_stats"] == {"LR": 2, "NB": 1}
