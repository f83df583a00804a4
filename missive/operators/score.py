"""Scoring post-processing and batch summaries.

One rule decides the class everywhere (evaluation and scoring): spam when the
unrounded spam probability is >= 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions import display as D
from missive.operators.stats import percentage

THRESHOLD = 0.5


def is_spam(p: Column) -> Column:
    return p >= F.lit(THRESHOLD)


def confidence(p: Column) -> Column:
    """round(|p - 0.5| * 2 * 100, 2) from the unrounded probability."""
    return F.round(F.abs(p - F.lit(0.5)) * F.lit(2.0) * F.lit(100.0), 2)


def postprocess(df: DataFrame, p_col: str = "p", clean_col: str | None = "clean_text") -> DataFrame:
    """M13 + M14: is_spam / spam_probability / confidence_score; rows whose text is
    empty after cleaning score as ham with p = 0 and full confidence."""
    p = F.col(p_col)
    empty = (F.col(clean_col) == "") if clean_col else F.lit(False)
    return df.select(
        "*",
        F.when(empty, F.lit(False)).otherwise(is_spam(p)).alias("is_spam"),
        F.when(empty, F.lit(0.0)).otherwise(F.round(p, 4)).alias("spam_probability"),
        F.when(empty, F.lit(100.0)).otherwise(confidence(p)).alias("confidence_score"))


def split_valid(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); text must be present and at least 1 character."""
    ok = F.col(text_col).isNotNull() & (F.length(F.col(text_col)) >= 1)
    return df.filter(ok), df.filter(~ok | F.col(text_col).isNull())


def batch_summary(preds: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Total / spam / ham / spam % over scored rows."""
    aggs = [F.count(F.lit(1)).alias("total_processed"),
            F.count_if(F.col("is_spam")).alias("spam_count")]
    agg = preds.groupBy(*group_cols).agg(*aggs) if group_cols else preds.agg(*aggs)
    return agg.select(*group_cols, "total_processed", "spam_count",
                      (F.col("total_processed") - F.col("spam_count")).alias("ham_count"),
                      percentage(F.col("spam_count"), F.col("total_processed")).alias("spam_percentage"))


def batch_display(preds: DataFrame) -> DataFrame:
    """P10 + P12: result table as shown and downloaded."""
    return preds.select(
        "id", "text", "is_spam", "spam_probability", "confidence_score",
        D.flag_label(F.col("is_spam"), D.SPAM_DISPLAY, D.BATCH_HAM_DISPLAY).alias("prediction"),
        D.percent_of_fraction(F.col("spam_probability"), 1).alias("probability_pct"),
        D.percent_text(F.col("confidence_score")).alias("confidence_pct"))
