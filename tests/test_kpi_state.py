"""KPIs merged from partial states equal those of the whole history, and a refresh reads new rows only."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from missive.operators import history as H
from missive.operators import kpi_state as KS
from missive.sources import history_store as HS

TS = dt.datetime(2024, 1, 5, 3, 4, 5)


def _append(spark, path, models, start):
    rows = [(start + i, f"t{start + i}", (start + i) % 2, 0.5, 40.0 + (start + i) / 8, m, "TF-IDF", 0.25 * i, TS)
            for i, m in enumerate(models)]
    spark.createDataFrame(rows, HS.HISTORY_SCHEMA).write.mode("append").parquet(path)
    return start + len(models)


def _same(spark, path):
    states, hist = KS.read_states(spark, path), HS.read_history(spark, path)
    assert KS.kpis(states).first().asDict() == H.kpis(hist).first().asDict()
    by = lambda df: {r["model_used"]: r["count"] for r in df.collect()}
    assert by(KS.scans_by_model(states)) == by(H.scans_by_model(hist))


def test_merged_kpis_follow_appends_replays_and_a_clear(spark, tmp_path):
    path = str(tmp_path / "history")
    HS.init_history(spark, path)
    assert KS.refresh(spark, path) == 0
    _same(spark, path)                                  # empty history: all zeros
    at = _append(spark, path, ["NB", "LR", "NB"], 1)
    at = _append(spark, path, ["SVM"], at)              # two appends, one refresh
    assert KS.refresh(spark, path) == 4
    _same(spark, path)
    assert KS.refresh(spark, path) == 4                 # nothing new: nothing counted twice
    _same(spark, path)
    at = _append(spark, path, ["LR"] * 7, at)
    assert KS.kpis(KS.read_states(spark, path)).first()["total_scans"] == 4   # not covered yet
    assert KS.refresh(spark, path) == 11
    _same(spark, path)
    HS.clear_history(spark, path)
    _same(spark, path)
    _append(spark, path, ["NB"], 1)                     # ids start over
    assert KS.refresh(spark, path) == 1
    _same(spark, path)


def test_refresh_reads_only_new_row_groups(spark, tmp_path):
    path = str(tmp_path / "history")
    HS.init_history(spark, path)
    at = _append(spark, path, ["NB"] * 50, 1)
    KS.refresh(spark, path)
    _append(spark, path, ["LR"] * 5, at)
    new = HS.read_history(spark, path).filter(F.col("id") > KS.covered(KS.read_states(spark, path)))
    plan = new._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(id,50)" in plan
    # files of old rows are never touched: without them the refresh gives the same states
    for f in (tmp_path / "history").glob("part-*.parquet"):
        if spark.read.parquet(str(f)).filter("id <= 50").count():
            f.unlink()
    assert KS.refresh(spark, path) == 55
    assert KS.kpis(KS.read_states(spark, path)).first()["total_scans"] == 55


@pytest.mark.parametrize("quota", [0.2, 0.5])
def test_boundary_cut_with_equal_classes_and_one_row(spark, quota):
    from missive.operators import split as SP
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aaaaabbbbbccccd")], "doc_id long, label string")
    out = SP.stratified_split(df, test_size=quota, bucket_digits=1)
    want = {r["label"]: r["n_test_c"] for r in SP.allocation(df.groupBy("label").agg(F.count(F.lit(1)).alias("c")), test_size=quota).collect()}
    got = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.count_if(F.col("split") == "test").alias("n")).collect()}
    assert got == want and out.count() == 15
