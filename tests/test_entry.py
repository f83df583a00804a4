import __spark_entry__ as E

from tests.conftest import SF001


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_cheap_queries_run_on_smoke_data(spark):
    qs = E.queries()
    for name in ("dataset_stats", "history_kpis", "stratified_split_counts", "trigger_hits", "embedding_mean"):
        df = qs[name](spark, SF001)
        assert df.count() >= 0 and df.columns


def test_entry_flagship(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert set(df.columns) == {"source", "total_processed", "spam_count", "ham_count", "spam_percentage"}
    assert sum(r["total_processed"] for r in rows) == spark.read.parquet(f"{SF001}/documents.parquet").count()
