"""The prediction history as an append-only Parquet table."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from missive.session import read_or_none
from missive.sources.ingest import with_consecutive_ids

HISTORY_SCHEMA = T_.StructType([
    T_.StructField("id", T_.LongType(), False),
    T_.StructField("email_text", T_.StringType(), False),
    T_.StructField("is_spam", T_.IntegerType(), False),
    T_.StructField("probability", T_.DoubleType(), False),
    T_.StructField("confidence", T_.DoubleType(), False),
    T_.StructField("model_used", T_.StringType(), False),
    T_.StructField("vectorizer_used", T_.StringType(), False),
    T_.StructField("execution_time_ms", T_.DoubleType(), False),
    T_.StructField("timestamp", T_.TimestampType(), False),
])


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The full history (empty frame of the fixed schema when absent)."""
    found = read_or_none(lambda: spark.read.schema(HISTORY_SCHEMA).parquet(path))
    return spark.createDataFrame([], HISTORY_SCHEMA) if found is None else found


def init_history(spark: SparkSession, path: str) -> None:
    """K6: create the table if it does not exist."""
    if read_or_none(lambda: spark.read.parquet(path).schema) is None:
        spark.createDataFrame([], HISTORY_SCHEMA).write.mode("errorifexists").parquet(path)


def states_path(path: str) -> str:
    """Where the partial KPI states of a history lie (``operators.kpi_state``)."""
    return f"{path.rstrip('/')}_kpi_states"


def clear_history(spark: SparkSession, path: str) -> None:
    """K7: delete all rows, keep the schema. Ids start from 1 again, so the states go first: a run that breaks
    off in between leaves rows without states, which the next refresh covers."""
    states = states_path(path)
    schema = read_or_none(lambda: spark.read.parquet(states).schema)
    if schema is not None:
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(states)
    spark.createDataFrame([], HISTORY_SCHEMA).write.mode("overwrite").parquet(path)


def history_rows(scored: DataFrame, text_col: str, start_id: int, per_row_ms: float) -> DataFrame:
    """K5 + P10 + D1: scored rows in the history schema with consecutive ids."""
    rows = scored.select(
        F.col(text_col).alias("email_text"),
        F.col("is_spam").cast("int").alias("is_spam"),
        F.col("spam_probability").alias("probability"),
        F.col("confidence_score").alias("confidence"),
        F.col("model_name").alias("model_used"),
        F.col("vectorizer_name").alias("vectorizer_used"),
        F.lit(float(per_row_ms)).alias("execution_time_ms"),
        F.current_timestamp().alias("timestamp"))
    rows = with_consecutive_ids(rows, "id", start_id)
    return rows.select(*[f.name for f in HISTORY_SCHEMA.fields])


def next_id(spark: SparkSession, path: str) -> int:
    m = read_history(spark, path).agg(F.max("id")).first()[0]
    return int(m or 0) + 1


def append_scored(spark: SparkSession, path: str, scored: DataFrame, text_col: str = "text",
                  elapsed_ms: float | None = None) -> int:
    """K5 + M15: one atomic append per batch (not per row).

    The scored frame is materialised once (shared folder) so its wall time
    gives the per-row latency; rows then get ids after the current maximum.
    ``elapsed_ms`` tells that ``scored`` is written already, and how long that took.
    """
    from missive.session import materialise
    began = time.time()
    done = scored if elapsed_ms is not None else materialise(scored, "scored")
    taken = elapsed_ms if elapsed_ms is not None else (time.time() - began) * 1000.0
    n = done.count()
    per_row = round(taken / n, 2) if n else 0.0
    rows = history_rows(done, text_col, next_id(spark, path), per_row)
    rows.write.mode("append").parquet(path)
    return n
