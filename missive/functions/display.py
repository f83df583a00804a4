"""Report projections: flags to labels, percent / ms strings, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed display values.
SPAM_DISPLAY = "Spam 🚨"
HISTORY_HAM_DISPLAY = "Safe ✅"
BATCH_HAM_DISPLAY = "Safe (Ham) ✅"
TREND_SPAM_DISPLAY = "Spam"
TREND_HAM_DISPLAY = "Safe (Ham)"
DATE_PATTERN = "MMM dd, yyyy - HH:mm:ss"   # strftime "%b %d, %Y - %H:%M:%S"


def flag_to_int(col: Column) -> Column:
    """P10: boolean -> 0/1 as stored in the history."""
    return col.cast("int")


def flag_label(col: Column, spam: str = SPAM_DISPLAY, ham: str = HISTORY_HAM_DISPLAY) -> Column:
    """P10: 0/1 (or boolean) -> display label."""
    return F.when(col.cast("int") == 1, F.lit(spam)).otherwise(F.lit(ham))


def number_text(col: Column) -> Column:
    """A double printed the way Python prints a float (shortest round-trip form)."""
    return col.cast("double").cast("string")


def percent_of_fraction(col: Column, digits: int = 1) -> Column:
    """f"{round(x * 100, digits)}%"."""
    return F.concat(number_text(F.round(col * F.lit(100.0), digits)), F.lit("%"))


def percent_text(col: Column) -> Column:
    """f"{x}%" for a value already in percent."""
    return F.concat(number_text(col), F.lit("%"))


def ms_text(col: Column) -> Column:
    """f"{x} ms"."""
    return F.concat(number_text(col), F.lit(" ms"))


def composite_model_label(model: Column, vectorizer: Column) -> Column:
    """P13: "model (vectorizer)"."""
    return F.concat(model, F.lit(" ("), vectorizer, F.lit(")"))


def format_scan_time(col: Column) -> Column:
    """Timestamp (or ISO text) -> "Mon dd, yyyy - HH:mm:ss"; unparsable text passes through."""
    as_text = col.cast("string")
    parsed = as_text.try_cast("timestamp_ntz")   # wall clock kept as is: no session-zone shift
    return F.coalesce(F.date_format(parsed, DATE_PATTERN), as_text)
