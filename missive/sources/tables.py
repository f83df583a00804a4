"""Driver tables and the derived views shared by queries and tests.

Each loader reads one Parquet table; Catalyst prunes columns and pushes
filters into the scan, so callers select only what they need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


TEXT_TABLES = ("documents", "pages", "conversations", "benchmark")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


#: A scan of less than this for each core is spread over the cores.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy text work at least one task per core.

    A scan of few, large row groups yields fewer partitions than the cluster
    has cores; regex cleaning then runs on a handful of tasks. Only in that
    case are rows spread round-robin (decided by file sizes, no job). A large
    input already has far more scan partitions than cores and is left as is.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(target) if size < target * SPREAD_BYTES else df


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled messages: documents joined to labels; quality 0 means spam.

    ``doc_id`` is unique in both tables, so this is a 1:1 equi-join. At scale
    both sides shuffle on ``doc_id`` (AQE turns it into a broadcast join when
    the labelled side is measured small at runtime).
    """
    docs = spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text", "lang", "source"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = (docs.join(labels, "doc_id", "inner")
              .withColumn("label", F.when(F.col("quality") == 0, F.lit("spam")).otherwise(F.lit("ham"))))
    return joined   # never spread the join: asking for its partitions would run its shuffles


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in prediction history built from ``events`` (fixed expressions of value)."""
    return shape_history(table(spark, sf_dir, "events"))


def utc_instant(ntz):
    """Naive wall-clock time -> the instant at which UTC shows that wall clock."""
    return F.concat(ntz.cast("string"), F.lit("Z")).cast("timestamp")


def utc_wall_clock(instant):
    """Inverse of ``utc_instant``: the UTC wall clock of an instant, as naive time."""
    # casting an instant to naive time renders it in the session zone: undo that offset first
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("timestamp_ntz")


def shape_history(ev: DataFrame, zoned_time: bool = False) -> DataFrame:
    """events -> history columns (works on batch and streaming frames).

    ``zoned_time`` reads the naive event time as a UTC instant (stream
    watermarks need instants); the wall clock is parsed with an explicit 'Z',
    so the result does not depend on the session time zone or its DST gaps."""
    value = F.col("value")
    ts = utc_instant(F.col("ts")) if zoned_time else F.col("ts")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("props").alias("email_text"),
        (F.col("event_type") == "error").cast("int").alias("is_spam"),
        (value / (value + F.lit(1.0))).alias("probability"),
        value.alias("confidence"),
        F.col("event_type").alias("model_used"),
        F.when(value >= 50.0, F.lit("Word2Vec")).otherwise(F.lit("TF-IDF")).alias("vectorizer_used"),
        (value * F.lit(2.0)).alias("execution_time_ms"),
        ts.alias("timestamp"),
    )


def rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled messages plus a deterministic rule prediction (money or '!' marker)."""
    return messages(spark, sf_dir).withColumn(
        "y_pred", F.when(F.col("text").rlike("[$£€!]"), F.lit("spam")).otherwise(F.lit("ham")))


def batch_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a batch of (id, text) items to score."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("text"), F.col("role"))
