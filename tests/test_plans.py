"""Scale checks on physical plans: no Python evaluation in text ETL and no
single-partition exchange in grouped reports (global aggregates and the
O1/O2 top-k reports are the only places a single partition is expected)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF001

GROUPED = ["clean_text", "html_strip", "messages_clean", "token_counts_by_label", "trigger_hits",
           "history_by_model", "history_windowed_trend", "embedding_mean", "batch_summary", "pool_append"]


def _plan(spark, name):
    df = E.queries()[name](spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", GROUPED)
def test_no_python_and_no_single_partition(spark, name):
    plan = _plan(spark, name)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "SinglePartition" not in plan


def test_scans_prune_columns_and_push_filters(spark):
    plan = E.queries()["history_label_filter"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan
    assert "user_id" not in plan   # unused column never read
