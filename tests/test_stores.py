"""Stores keep their rows whatever goes wrong; lemmas stay with their rows; streams read folders whole."""

import pytest
from pyspark.sql import functions as F

from missive.functions import text as T
from missive.operators import history as H
from missive.operators import stats
from missive.sources import history_store as HS
from missive.sources import ingest, tables
from missive.streaming import stream as ST

SF001 = "/root/testdata/sf0.001"


def test_unreadable_history_is_not_emptied(spark, tmp_path):
    path = str(tmp_path / "history")
    HS.init_history(spark, path)
    (tmp_path / "history" / "part-00000.parquet").write_bytes(b"not parquet at all")
    for f in (tmp_path / "history").glob("part-*-*"):
        f.unlink()
    with pytest.raises(Exception):
        HS.init_history(spark, path)
        HS.next_id(spark, path)
    assert (tmp_path / "history" / "part-00000.parquet").exists()
    assert HS.read_history(spark, str(tmp_path / "none")).count() == 0


def test_pool_versions_are_never_reused(spark, tmp_path):
    root = str(tmp_path / "pool")
    rows = spark.createDataFrame([("spam", "x")], "label string, text string")
    assert ingest.update_pool(spark, root, rows)["version"] == 1
    spark.range(1).write.parquet(f"{root}/v2")   # a run that broke off before it published
    got = ingest.update_pool(spark, root, rows, "append")
    assert (got["version"], got["total_records"]) == (3, 2) and ingest.read_pool(spark, root).count() == 2


def test_one_column_file_is_rejected(spark, tmp_path):
    path = tmp_path / "one.csv"
    path.write_text("spam\nham\nspam\n")
    with pytest.raises(ValueError, match="at least 2 columns"):
        ingest.ingest_labelled(spark, str(path))


def test_lemma_map_that_changes_nothing_changes_no_row(spark):
    msgs = tables.messages(spark, "/root/testdata/sf0.01")
    lemmas = (msgs.select(F.explode(T.clean_tokens(F.col("text"))).alias("token")).distinct()
              .withColumn("lemma", F.col("token")))
    plain = stats.prepare_messages(msgs).select("doc_id", "clean_text")
    mapped = stats.prepare_messages(msgs, lemma_map=lemmas).select("doc_id", "clean_text")
    assert plain.count() > 300 and plain.exceptAll(mapped).isEmpty() and mapped.exceptAll(plain).isEmpty()


def test_streams_read_a_folder_of_files_whole(spark, tmp_path):
    spark.read.parquet(f"{SF001}/events.parquet").repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    trend = str(tmp_path / "trend")
    ST.run_certainty_trend(ST.history_stream_from_events(spark, str(tmp_path)), trend, str(tmp_path / "c")).awaitTermination()
    got = ST.latest_per_key(trend, spark, ["window_start", "window_end"]).agg(F.sum("scans")).first()[0]
    assert got == spark.read.parquet(f"{SF001}/events.parquet").count()
    kpis = str(tmp_path / "kpis")
    ST.run_live_kpis(ST.history_stream_from_events(spark, str(tmp_path)), kpis, str(tmp_path / "k")).awaitTermination()
    assert ST.latest_per_key(kpis, spark, []).first().asDict() == H.kpis(tables.history(spark, SF001)).first().asDict()
