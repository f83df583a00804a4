"""Reports over the prediction history (P7-P10, A7, A9, O1, O2, O4, D2, ST3 batch form).

The history is an append-only table; every report is one DataFrame plan so
Catalyst prunes columns and pushes the ``is_spam`` predicate into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missive.functions import display as D
from missive.operators.stats import percentage

DEFAULT_LIMIT = 100
TREND_ROWS = 50


def like_pattern(query: str) -> str:
    """P7: '%q%' with the user's own % and _ kept as wildcards; every backslash
    is doubled so it matches literally (a trailing one would be an error)."""
    return "%" + query.replace("\\", "\\\\") + "%"


def filter_history(df: DataFrame, search_query: str | None = None,
                   label_filter: str | None = None) -> DataFrame:
    """P7 + P8: case-insensitive substring search and spam/ham filter."""
    if search_query:
        df = df.filter(F.col("email_text").ilike(like_pattern(search_query)))
    if label_filter:
        lab = label_filter.lower()
        if lab == "spam":
            df = df.filter(F.col("is_spam") == 1)
        elif lab == "ham":
            df = df.filter(F.col("is_spam") == 0)
    return df


def get_history(df: DataFrame, limit: int = DEFAULT_LIMIT, search_query: str | None = None,
                label_filter: str | None = None) -> DataFrame:
    """P7 + P8 + O1: newest first, top ``limit`` (a TakeOrderedAndProject)."""
    return filter_history(df, search_query, label_filter).orderBy(F.col("id").desc()).limit(limit)


def kpis(df: DataFrame) -> DataFrame:
    """One row of KPIs; all zeros on an empty history."""
    agg = df.agg(
        F.count(F.lit(1)).alias("total_scans"),
        F.count_if(F.col("is_spam") == 1).alias("total_spam"),
        F.count_if(F.col("is_spam") == 0).alias("total_ham"),
        F.avg("confidence").alias("_avg_conf"),
        F.avg("execution_time_ms").alias("_avg_lat"))
    return agg.select(
        "total_scans", "total_spam", "total_ham",
        percentage(F.col("total_spam"), F.col("total_scans")).alias("spam_percentage"),
        F.round(F.coalesce(F.col("_avg_conf"), F.lit(0.0)), 2).alias("avg_confidence"),
        F.round(F.coalesce(F.col("_avg_lat"), F.lit(0.0)), 2).alias("avg_latency"))


def scans_by_model(df: DataFrame) -> DataFrame:
    """Scan count per model."""
    return df.groupBy("model_used").agg(F.count(F.lit(1)).alias("count"))


def model_stats_map(df: DataFrame) -> DataFrame:
    """A9 as the KPI map (model count is small: one entry per trained model)."""
    by_model = scans_by_model(df)
    return by_model.agg(F.map_from_entries(F.collect_list(F.struct("model_used", "count"))).alias("model_stats"))


def trend(df: DataFrame, rows: int = TREND_ROWS, newest: bool = False) -> DataFrame:
    """O2 + O4: the oldest (or newest) ``rows`` scans with a 1-based scan number.

    The window runs after the limit, over at most ``rows`` rows, so the single
    partition it needs is bounded.
    """
    order = F.col("id").desc() if newest else F.col("id").asc()
    top = df.select("id", "is_spam", "confidence", "timestamp").orderBy(order).limit(rows)
    return (top.withColumn("scan_no", F.row_number().over(Window.orderBy("id")).cast("long"))
            .withColumn("label", D.flag_label(F.col("is_spam"), D.TREND_SPAM_DISPLAY, D.TREND_HAM_DISPLAY)))


def windowed_trend(df: DataFrame, window: str = "1 hour") -> DataFrame:
    """ST3 batch form: tumbling-window certainty and spam counts."""
    return (df.groupBy(F.window("timestamp", window).alias("w"))
            .agg(F.count(F.lit(1)).alias("scans"),
                 F.count_if(F.col("is_spam") == 1).alias("spam_count"),
                 F.round(F.avg("confidence"), 4).alias("avg_confidence"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "scans", "spam_count", "avg_confidence"))


def display(df: DataFrame) -> DataFrame:
    """P10 + P12 + D2: the history table as shown to a user."""
    return df.select(
        F.col("id").cast("string").alias("id"),
        D.format_scan_time(F.col("timestamp")).alias("scanned_at"),
        "email_text",
        D.flag_label(F.col("is_spam")).alias("spam_prediction"),
        D.percent_of_fraction(F.col("probability"), 1).alias("probability"),
        D.percent_text(F.col("confidence")).alias("confidence"),
        "model_used",
        D.ms_text(F.col("execution_time_ms")).alias("execution_time"))
