"""Evaluation algebra.

All metrics come from one aggregation pass that counts the four cells of the
2x2 matrix (rows ham then spam, positive class spam); precision, recall and F1
use zero_division = 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.functions import display as D

METRICS = ("accuracy", "precision", "recall", "f1_score")
POSITIVE, NEGATIVE = "spam", "ham"


def confusion_counts(df: DataFrame, y_true: str = "label", y_pred: str = "y_pred",
                     group_cols: Sequence[str] = ()) -> DataFrame:
    """A2: tn, fp, fn, tp per group (empty cells are 0, never missing)."""
    t, p = F.col(y_true), F.col(y_pred)
    cells = [
        F.count_if((t == NEGATIVE) & (p == NEGATIVE)).alias("tn"),
        F.count_if((t == NEGATIVE) & (p == POSITIVE)).alias("fp"),
        F.count_if((t == POSITIVE) & (p == NEGATIVE)).alias("fn"),
        F.count_if((t == POSITIVE) & (p == POSITIVE)).alias("tp"),
    ]
    return df.groupBy(*group_cols).agg(*cells) if group_cols else df.agg(*cells)


def _safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def with_metrics(counts: DataFrame) -> DataFrame:
    """A3-A6 + packed matrix from tn/fp/fn/tp columns."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        "*",
        _safe_ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _safe_ratio(tp, tp + fp).alias("precision"),
        _safe_ratio(tp, tp + fn).alias("recall"),
        _safe_ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1_score"),
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"),
    )


def evaluate(df: DataFrame, y_true: str = "label", y_pred: str = "y_pred",
             group_cols: Sequence[str] = ()) -> DataFrame:
    return with_metrics(confusion_counts(df, y_true, y_pred, group_cols))


def matrix_text(df: DataFrame) -> Column:
    """"[[tn,fp],[fn,tp]]" for reports."""
    return F.concat(F.lit("[["), F.col("tn").cast("string"), F.lit(","), F.col("fp").cast("string"),
                    F.lit("],["), F.col("fn").cast("string"), F.lit(","), F.col("tp").cast("string"),
                    F.lit("]]"))


def best_model(metrics: DataFrame, ordinal_col: str = "grid_ordinal") -> DataFrame:
    """Highest F1; ties go to the first model in grid order."""
    return metrics.orderBy(F.col("f1_score").desc(), F.col(ordinal_col).asc()).limit(1)


def rank_by_f1(metrics: DataFrame, ordinal_col: str = "grid_ordinal") -> DataFrame:
    """O3: models sorted by F1 descending (grid order breaks ties)."""
    return metrics.orderBy(F.col("f1_score").desc(), F.col(ordinal_col).asc())


def metrics_long(metrics: DataFrame, id_cols: Sequence[str] = ("model_name", "vectorizer_name")) -> DataFrame:
    """R1 + P13: one row per (model, metric) with the composite label and score x 100."""
    long = metrics.select(*id_cols, *METRICS).unpivot(list(id_cols), list(METRICS), "metric", "score")
    return long.select(*id_cols, "metric", "score",
                       D.composite_model_label(F.col(id_cols[0]), F.col(id_cols[1])).alias("model_node"),
                       (F.col("score") * F.lit(100.0)).alias("score_pct"))


def metrics_table(metrics: DataFrame) -> DataFrame:
    """O3 + P12: the comparison table with percent strings."""
    return rank_by_f1(metrics).select(
        "model_name", "vectorizer_name",
        *[D.percent_of_fraction(F.col(m), 2).alias(m) for m in METRICS])
