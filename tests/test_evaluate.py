import pytest

from missive.operators import evaluate as EV

# Published 2x2 matrices (rows ham then spam) with their reported metrics.
GOLDEN = [
    ("Logistic Regression", "TF-IDF", 947, 17, 11, 138, 0.97484, 0.89032, 0.92617, 0.90789),
    ("Naive Bayes", "TF-IDF", 964, 0, 35, 114, 0.96855, 1.00000, 0.76510, 0.86692),
    ("Support Vector Machine", "TF-IDF", 963, 1, 12, 137, 0.98832, 0.99275, 0.91946, 0.95470),
    ("Random Forest", "TF-IDF", 962, 2, 14, 135, 0.98562, 0.98540, 0.90604, 0.94406),
    ("Logistic Regression", "Word2Vec", 899, 65, 20, 129, 0.92363, 0.66495, 0.86577, 0.75219),
    ("Naive Bayes", "Word2Vec", 556, 408, 28, 121, 0.60827, 0.22873, 0.81208, 0.35693),
    ("Support Vector Machine", "Word2Vec", 925, 39, 22, 127, 0.94519, 0.76506, 0.85235, 0.80635),
    ("Random Forest", "Word2Vec", 942, 22, 23, 126, 0.95957, 0.85135, 0.84564, 0.84848),
]


def _counts(spark):
    rows = [(m, v, i + 1, tn, fp, fn, tp) for i, (m, v, tn, fp, fn, tp, *_ ) in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, "model_name string, vectorizer_name string, grid_ordinal long, "
                                       "tn long, fp long, fn long, tp long")


def test_golden_metrics_and_winner(spark):
    m = EV.with_metrics(_counts(spark))
    got = {(r["model_name"], r["vectorizer_name"]): r for r in m.collect()}
    for name, vec, tn, fp, fn, tp, acc, p, r, f1 in GOLDEN:
        row = got[(name, vec)]
        assert row["accuracy"] == pytest.approx(acc, abs=5e-6)
        assert row["precision"] == pytest.approx(p, abs=5e-6)
        assert row["recall"] == pytest.approx(r, abs=5e-6)
        assert row["f1_score"] == pytest.approx(f1, abs=5e-6)
        assert row["confusion_matrix"] == [[tn, fp], [fn, tp]]
    best = EV.best_model(m).first()
    assert (best["model_name"], best["vectorizer_name"]) == ("Support Vector Machine", "TF-IDF")


def test_zero_division_and_one_class(spark):
    df = spark.createDataFrame([("ham", "ham"), ("spam", "ham"), ("ham", "ham")], "label string, y_pred string")
    r = EV.evaluate(df).first()
    assert (r["precision"], r["f1_score"]) == (0.0, 0.0)
    assert r["confusion_matrix"] == [[2, 0], [1, 0]]
    only_ham = spark.createDataFrame([("ham", "spam")], "label string, y_pred string")
    r2 = EV.evaluate(only_ham).first()
    assert r2["recall"] == 0.0 and r2["confusion_matrix"] == [[0, 1], [0, 0]]


def test_f1_tie_goes_to_first_in_grid(spark):
    df = spark.createDataFrame([("b", 2, 0.5), ("a", 1, 0.5), ("c", 3, 0.4)], "model_name string, grid_ordinal long, f1_score double")
    assert EV.best_model(df).first()["model_name"] == "a"


def test_unpivot_shape(spark):
    long = EV.metrics_long(EV.with_metrics(_counts(spark)))
    assert long.count() == 32
    r = long.filter("metric = 'f1_score' AND model_name = 'Naive Bayes' AND vectorizer_name = 'TF-IDF'").first()
    assert r["model_node"] == "Naive Bayes (TF-IDF)" and r["score_pct"] == pytest.approx(86.692, abs=1e-3)
