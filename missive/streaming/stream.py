"""Structured Streaming jobs (ST1-ST3).

ST1 scores a stream of message files and appends to the history; ST2 keeps
live KPIs over the history stream; ST3 is a tumbling-window certainty trend
with a watermark (rows later than the watermark are dropped).

Sinks are replay-safe: ``foreachBatch`` writes each micro-batch into its own
``batch_id`` partition with dynamic partition overwrite, so re-running a
batch from the checkpoint replaces its output instead of duplicating it.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.streaming import StreamingQuery

from missive.operators import history as H
from missive.session import materialise, read_or_none
from missive.sources.history_store import HISTORY_SCHEMA, history_rows


def _write_batch_partition(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(path))


def latest_per_key(path: str, spark: SparkSession, keys: list[str]) -> DataFrame:
    """Read an update-mode output: for every key keep the row of the last batch."""
    df = spark.read.parquet(path)
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    if not keys:
        last = df.agg(F.max("batch_id").alias("_b"))
        return df.join(last, df["batch_id"] == last["_b"]).select(*cols)
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_v"))
    return agg.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols])


# ---------------------------------------------------------------------------
# ST1
# ---------------------------------------------------------------------------

def _id_path(history_path: str, batch_id: int) -> str:
    return f"{history_path.rstrip('/')}_last_ids/batch_{batch_id}"


def _last_id(spark: SparkSession, history_path: str, batch_id: int) -> int:
    """The last id before this batch; a history without a note of it is searched once."""
    noted = read_or_none(lambda: spark.read.parquet(_id_path(history_path, batch_id - 1)))
    if noted is not None:
        return int(noted.first()["last"])
    prior = read_or_none(lambda: spark.read.parquet(history_path))
    last = prior.filter(F.col("batch_id") < batch_id).agg(F.max("id")).first()[0] if prior is not None else None
    return int(last or 0)


def score_stream(messages: DataFrame, classifier, history_path: str, checkpoint: str,
                 text_col: str = "text", available_now: bool = True) -> StreamingQuery:
    """Score each micro-batch with the active classifier and append it to the
    history (ids after the rows of earlier batches; replay-safe).

    The last id of each batch is kept beside the history, so that a batch reads
    one row to go on from, not the whole history. Latency is the scoring
    write's time per row."""
    spark = messages.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = _last_id(spark, history_path, batch_id)
        began = time.time()
        scored = materialise(classifier.score(batch, text_col).select(
            text_col, "is_spam", "spam_probability", "confidence_score", "model_name", "vectorizer_name"), "stream-scored")
        taken = (time.time() - began) * 1000.0
        n = scored.count()
        rows = history_rows(scored, text_col, before + 1, round(taken / n, 2) if n else 0.0)
        _write_batch_partition(rows, history_path, batch_id)
        spark.createDataFrame([(before + n,)], "last long").coalesce(1).write.mode("overwrite") \
            .parquet(_id_path(history_path, batch_id))

    writer = messages.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


# ---------------------------------------------------------------------------
# ST2
# ---------------------------------------------------------------------------

def live_kpis(history_stream: DataFrame) -> DataFrame:
    """Streaming global KPIs (complete mode)."""
    return H.kpis(history_stream)


def run_live_kpis(history_stream: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch_partition(batch, out_path, batch_id)
    return (live_kpis(history_stream).writeStream.outputMode("complete").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# ---------------------------------------------------------------------------
# ST3
# ---------------------------------------------------------------------------

def certainty_trend(history_stream: DataFrame, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Tumbling-window certainty / spam counts; rows behind the watermark are dropped."""
    return H.windowed_trend(history_stream.withWatermark("timestamp", watermark), window)


def run_certainty_trend(history_stream: DataFrame, out_path: str, checkpoint: str,
                        window: str = "1 hour", watermark: str = "10 minutes") -> StreamingQuery:
    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch_partition(batch, out_path, batch_id)
    return (certainty_trend(history_stream, window, watermark).writeStream.outputMode("update")
            .foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def table_glob(sf_dir: str, name: str) -> str:
    """A pattern for one table's path: the file source then takes a single file as well as a folder."""
    return f"{sf_dir.rstrip('/')}/{name}.parque[t]"


def history_stream_from_events(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """The ``events`` table (a file or a folder of files) as a stream shaped as the history.

    Without ``max_files`` one trigger takes all files, so that no file of a stored table counts as late."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    ev = reader.parquet(table_glob(sf_dir, "events"))
    from missive.sources.tables import shape_history
    return shape_history(ev, zoned_time=True)


HISTORY_STREAM_SCHEMA: T_.StructType = HISTORY_SCHEMA
