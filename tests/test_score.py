from missive.operators import score as SC


def test_postprocess_fixture_values(spark):
    rows = [(0.5, "x"), (0.49999, "x"), (1.0, "x"), (0.0, "x"), (0.87654, "x"), (0.9, "")]
    df = spark.createDataFrame(rows, "p double, clean_text string")
    got = [(r["is_spam"], r["spam_probability"], r["confidence_score"]) for r in SC.postprocess(df).collect()]
    assert got == [(True, 0.5, 0.0), (False, 0.5, 0.0), (True, 1.0, 100.0), (False, 0.0, 100.0),
                   (True, 0.8765, 75.31), (False, 0.0, 100.0)]


def test_batch_summary_and_rejects(spark):
    items = spark.createDataFrame([("1", "a"), ("2", ""), ("3", None)], "id string, text string")
    ok, bad = SC.split_valid(items)
    assert ok.count() == 1 and bad.count() == 2
    preds = spark.createDataFrame([(True,), (False,), (True,), (True,)], "is_spam boolean")
    r = SC.batch_summary(preds).first()
    assert (r["total_processed"], r["spam_count"], r["ham_count"], r["spam_percentage"]) == (4, 3, 1, 75.0)
