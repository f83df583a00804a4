"""KPIs of the history merged from partial states (A7, A9 without reading the history again).

A refresh aggregates only the history rows after the last id that a state
covers (the ``id`` predicate reaches the Parquet scan, so older row groups are
skipped by their statistics) and appends one state row per model beside the
history. KPIs are merged from the states alone: counts and sums, one row per
model and refresh, whatever the history's size.

A refresh that breaks off leaves no state, so the next one covers its rows; a
refresh without new rows adds nothing; a cleared history starts over. Rows
must reach the history with ascending ids (K5), and one job at a time
refreshes a history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators.stats import percentage
from missive.session import read_or_none
from missive.sources.history_store import read_history, states_path

STATE_SCHEMA = ("model_used string, scans long, spam long, ham long, confidence_sum double, confidence_n long, "
                "latency_sum double, latency_n long, last_id long")


def read_states(spark: SparkSession, history_path: str) -> DataFrame:
    """All states of a history (none before its first refresh)."""
    found = read_or_none(lambda: spark.read.schema(STATE_SCHEMA).parquet(states_path(history_path)))
    return spark.createDataFrame([], STATE_SCHEMA) if found is None else found


def covered(states: DataFrame) -> int:
    """The last id that the states cover; 0 without any."""
    return int(states.agg(F.max("last_id")).first()[0] or 0)


def partial_state(rows: DataFrame, last_id: int) -> DataFrame:
    """One row per model: counts and sums of ``rows``, valid up to ``last_id``."""
    return rows.groupBy("model_used").agg(
        F.count(F.lit(1)).alias("scans"), F.count_if(F.col("is_spam") == 1).alias("spam"), F.count_if(F.col("is_spam") == 0).alias("ham"),
        F.sum("confidence").alias("confidence_sum"), F.count("confidence").alias("confidence_n"),
        F.sum("execution_time_ms").alias("latency_sum"), F.count("execution_time_ms").alias("latency_n"),
        F.lit(last_id).cast("long").alias("last_id"))


def refresh(spark: SparkSession, history_path: str) -> int:
    """Append the state of the rows since the last refresh; the number of ids now covered.

    The last id is fixed before rows are aggregated: rows that arrive meanwhile belong to the next refresh."""
    done = covered(read_states(spark, history_path))
    new = read_history(spark, history_path).filter(F.col("id") > done)
    last = new.agg(F.max("id")).first()[0]
    if last is None:
        return done
    partial_state(new.filter(F.col("id") <= last), last).coalesce(1).write.mode("append").parquet(states_path(history_path))
    return int(last)


def kpis(states: DataFrame) -> DataFrame:
    """A7 from states: the row that ``history.kpis`` gives for the covered rows."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = lambda s, n: F.when(F.sum(n) > 0, F.round(F.sum(s) / F.sum(n), 2)).otherwise(F.lit(0.0))
    agg = states.agg(total("scans").alias("total_scans"), total("spam").alias("total_spam"), total("ham").alias("total_ham"),
                     mean("confidence_sum", "confidence_n").alias("avg_confidence"), mean("latency_sum", "latency_n").alias("avg_latency"))
    return agg.select("total_scans", "total_spam", "total_ham",
                      percentage(F.col("total_spam"), F.col("total_scans")).alias("spam_percentage"), "avg_confidence", "avg_latency")


def scans_by_model(states: DataFrame) -> DataFrame:
    """A9 from states: scan count per model."""
    return states.groupBy("model_used").agg(F.sum("scans").alias("count"))
