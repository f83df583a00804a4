"""Dataset-level aggregates over labelled messages."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.functions import text as T


def standardise_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """P1 + P2: standardise the label column and keep only spam/ham rows."""
    return (df.withColumn(label_col, T.standardise_label(F.col(label_col)))
            .filter(T.is_valid_label(F.col(label_col))))


def prepare_messages(df: DataFrame, text_col: str = "text",
                     stop_words: Iterable[str] | None = T.DEFAULT_STOP_WORDS,
                     lemma_map: DataFrame | None = None, key_col: str = "doc_id") -> DataFrame:
    """Drop null label/text, add ``clean_text``, drop rows empty after cleaning.

    With a lemma map, rows are told apart by ``key_col`` (unique)."""
    out = df.na.drop(subset=["label", text_col])
    if lemma_map is None:
        cleaned = T.clean_text(F.col(text_col), stop_words)
    else:
        from missive.functions.lemma import lemmatize_column
        out = lemmatize_column(out.withColumn("_tokens", T.clean_tokens(F.col(text_col), stop_words)),
                               "_tokens", lemma_map, "_lemmas", key_col=key_col)
        cleaned = F.array_join("_lemmas", " ")
    # The cleaned text is produced by a one-row generator: a filter on generator
    # output cannot be pushed below it, so Catalyst cannot copy the regex chain
    # into the scan (before joins / repartitioning) and evaluate it twice.
    out = out.select("*", F.explode(F.array(cleaned)).alias("clean_text"))
    if lemma_map is not None:
        out = out.drop("_tokens", "_lemmas")
    return out.filter(F.col("clean_text") != "")


def percentage(part, total, digits: int = 2):
    """round(part / total * 100, digits); 0.0 when total is 0."""
    return F.when(total > 0, F.round(part / total * F.lit(100.0), digits)).otherwise(F.lit(0.0))


def dataset_stats(df: DataFrame, label_col: str = "label") -> DataFrame:
    """A1: one row of total / spam / ham / spam_percentage (zeros for no data)."""
    agg = df.agg(F.count_if(F.col(label_col) == "spam").alias("spam"),
                 F.count_if(F.col(label_col) == "ham").alias("ham"))
    total = F.col("spam") + F.col("ham")
    return agg.select(total.alias("total"), "spam", "ham",
                      percentage(F.col("spam"), total).alias("spam_percentage"))


def class_distribution(stats: DataFrame) -> DataFrame:
    """A10: (label, count) rows for a chart, from a stats row."""
    return stats.select(F.explode(F.array(
        F.struct(F.lit("ham").alias("label"), F.col("ham").alias("count")),
        F.struct(F.lit("spam").alias("label"), F.col("spam").alias("count")))).alias("r")).select("r.*")


def token_counts_by_label(prepared: DataFrame, label_col: str = "label") -> DataFrame:
    """Occurrences of every cleaned token per label (partial aggregation map-side)."""
    return (prepared.select(label_col, F.explode(T.split_clean_text(F.col("clean_text"))).alias("token"))
            .groupBy(label_col, "token").agg(F.count(F.lit(1)).alias("n")))


def trigger_hits(df: DataFrame, text_col: str, group_cols: Sequence[str] = (),
                 triggers: Sequence[str] = T.DEFAULT_TRIGGERS) -> DataFrame:
    """Hits and distinct rows per (group, trigger) over whole texts."""
    hits = df.select(*group_cols, F.explode(T.trigger_matches(F.col(text_col), triggers)).alias("trigger"))
    return hits.groupBy(*group_cols, "trigger").agg(F.count(F.lit(1)).alias("hits"))
