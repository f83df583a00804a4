import pytest
from pyspark.sql import functions as F

from missive.operators import evaluate as EV
from missive.operators import ml as ML

SPAM = ["win a cash prize now", "claim your free prize winner", "cash bonus winner claim today", "free cash offer win"]
HAM = ["meeting moved to monday", "lunch with the team today", "report draft for review", "see you at the meeting"]


def _labelled(spark, n=120):
    rows = []
    for i in range(n):
        if i % 4 == 0:
            rows.append((i, "spam", SPAM[i % len(SPAM)] + f" ref{i}"))
        else:
            rows.append((i, "ham", HAM[i % len(HAM)] + f" note{i}"))
    return spark.createDataFrame(rows, "doc_id long, label string, text string")


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    model_dir = str(tmp_path_factory.mktemp("models"))
    split_df = ML.prepare_split(_labelled(spark))
    res = ML.train_grid(split_df, [(ML.TFIDF, ML.LR), (ML.TFIDF, ML.NB)], model_dir)
    return split_df, res, model_dir


def test_split_and_learnability(trained):
    split_df, res, _ = trained
    counts = {(r["label"], r["split"]): r["n"] for r in split_df.groupBy("label", "split").count()
              .withColumnRenamed("count", "n").collect()}
    assert counts == {("ham", "train"): 72, ("ham", "test"): 18, ("spam", "train"): 24, ("spam", "test"): 6}
    f1 = {r["model_name"]: r["f1_score"] for r in res.metrics.collect()}
    assert f1[ML.LR] >= 0.9 and f1[ML.NB] >= 0.9


def test_save_load_same_scores(spark, trained):
    _, res, model_dir = trained
    active = ML.read_active(spark, model_dir)
    assert active["model_filename"] in ("logistic_regression_tf_idf", "naive_bayes_tf_idf")
    loaded = ML.Classifier.load(spark, model_dir)
    fresh = ML.Classifier(active["model_name"], ML.TFIDF, res.vectorisers, res.models[(ML.TFIDF, active["model_name"])])
    items = spark.createDataFrame([("1", "free cash prize winner"), ("2", "lunch meeting today"), ("3", "!!!")],
                                  "id string, text string")
    a = {r["id"]: (r["is_spam"], r["spam_probability"]) for r in loaded.score(items).collect()}
    b = {r["id"]: (r["is_spam"], r["spam_probability"]) for r in fresh.score(items).collect()}
    assert a == b
    assert a["1"][0] is True and a["2"][0] is False


def test_metadata_written(spark, trained):
    _, res, model_dir = trained
    all_models = spark.read.json(f"{model_dir}/all_models")
    assert all_models.count() == 2 and "confusion_matrix" in all_models.columns
    best = EV.best_model(res.metrics).first()
    assert ML.read_active(spark, model_dir)["model_name"] == best["model_name"]


def test_empty_text_scores_as_ham(spark, trained):
    _, res, _ = trained
    clf = ML.Classifier(ML.LR, ML.TFIDF, res.vectorisers, res.models[(ML.TFIDF, ML.LR)])
    r = clf.score(spark.createDataFrame([("9", "the is a")], "id string, text string")).first()
    assert (r["is_spam"], r["spam_probability"], r["confidence_score"]) == (False, 0.0, 100.0)


def test_history_append_ids_and_clear(spark, tmp_path):
    from missive.sources import history_store as HS
    path = str(tmp_path / "hist")
    HS.init_history(spark, path)
    items = spark.createDataFrame([("a", "free cash"), ("b", "meeting")], "id string, text string")
    scored = items.withColumn("is_spam", F.lit(True)).withColumn("spam_probability", F.lit(0.9)) \
        .withColumn("confidence_score", F.lit(80.0)).withColumn("model_name", F.lit("LR")) \
        .withColumn("vectorizer_name", F.lit("TF-IDF"))
    assert HS.append_scored(spark, path, scored) == 2
    assert HS.append_scored(spark, path, scored) == 2
    ids = sorted(r["id"] for r in HS.read_history(spark, path).collect())
    assert ids == [1, 2, 3, 4]
    HS.clear_history(spark, path)
    assert HS.read_history(spark, path).count() == 0


def test_metrics_read_back_and_batch_analysis(spark, trained, tmp_path):
    from missive.sources import ingest
    from missive.sources.history_store import read_history
    _, res, model_dir = trained
    m = ingest.read_model_metrics(spark, model_dir)
    assert m.count() == 2 and m.filter("confusion_matrix IS NULL").count() == 0
    clf = ML.Classifier.load(spark, model_dir)
    items = spark.createDataFrame([("a", "free cash prize"), ("b", "lunch meeting"), ("c", "")], "id string, text string")
    hist = str(tmp_path / "hist")
    preds, summary = ML.analyze_batch(spark, clf, items, hist)
    assert preds.count() == 2
    s = summary.first()
    assert s["total_processed"] == 2 and s["spam_count"] + s["ham_count"] == 2
    assert sorted(r["id"] for r in read_history(spark, hist).collect()) == [1, 2]


def test_retrain_versions_and_pointer(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert ML.active_model_dir(spark, root) is None
    d1 = ML.retrain(spark, root, _labelled(spark, 60), grid=[(ML.TFIDF, ML.NB)])
    d2 = ML.retrain(spark, root, _labelled(spark, 80), grid=[(ML.TFIDF, ML.NB)])
    assert d1.endswith("/v1") and d2.endswith("/v2") and ML.active_model_dir(spark, root) == d2
    clf = ML.Classifier.load(spark, ML.active_model_dir(spark, root))
    assert clf.model_name == ML.NB and clf.vectorizer_name == ML.TFIDF


def test_load_or_train_trains_once(spark, tmp_path):
    model_dir = str(tmp_path / "m")
    clf = ML.load_or_train(spark, model_dir, _labelled(spark, 60), grid=[(ML.TFIDF, ML.NB)])
    assert (clf.model_name, clf.vectorizer_name) == (ML.NB, ML.TFIDF)
    again = ML.load_or_train(spark, model_dir, None, grid=[(ML.TFIDF, ML.NB)])   # no training: labelled unused
    assert again.model_name == ML.NB


def test_batch_keeps_input_order_and_time(spark, trained):
    _, _, model_dir = trained
    clf = ML.Classifier.load(spark, model_dir)
    items = spark.createDataFrame([("z", "free cash prize"), ("a", "lunch meeting"), ("m", "the is a"), ("b", "cash win")],
                                  "id string, text string")
    preds, _ = ML.analyze_batch(spark, clf, items)
    rows = preds.orderBy("position").collect()
    assert [r["id"] for r in rows] == ["z", "a", "m", "b"] and [r["position"] for r in rows] == [1, 2, 3, 4]
    assert rows[2]["prediction_time_ms"] == 0.0 and rows[0]["prediction_time_ms"] > 0.0


def test_lemmas_are_stored_and_used_in_scoring(spark, tmp_path):
    model_dir = str(tmp_path / "lemma-model")
    lemmas = spark.createDataFrame([("prizes", "prize"), ("meetings", "meeting")], "token string, lemma string")
    clf = ML.load_or_train(spark, model_dir, _labelled(spark, 60), [(ML.TFIDF, ML.NB)], lemmas)
    items = spark.createDataFrame([("free prizes",), ("free prize",), (None,)], "text string")
    got = {r["text"]: (r["clean_text"], r["spam_probability"]) for r in clf.score(items).collect()}
    assert got["free prizes"] == got["free prize"] and got["free prizes"][0] == "free prize"
    assert got[None][0] == ""


def test_training_keeps_no_frame_and_small_blocks(spark, monkeypatch):
    """A partition of the learners' rows is bounded, also where the scan has few; no frame of texts or features is cached."""
    from pyspark.sql import DataFrame
    one = spark.range(20_000, numPartitions=1)
    assert ML.sized_for_iteration(one, 20_000).rdd.getNumPartitions() == 3
    assert ML.sized_for_iteration(spark.range(100, numPartitions=7), 100).rdd.getNumPartitions() == 1
    kept = []
    for name in ("persist", "cache"):
        monkeypatch.setattr(type(one), name, lambda df, *a: kept.append(df.columns) or df)
    seen, fit = {}, ML.fit_model
    monkeypatch.setattr(ML, "fit_model", lambda m, v, rows, n: seen.setdefault(m, (rows.columns, rows.rdd.getNumPartitions())) and fit(m, v, rows, n))
    monkeypatch.setattr(ML, "ROWS_PER_TRAIN_PARTITION", 10)
    rows = [(i, "spam" if i % 2 else "ham", ("cash prize winner claim " if i % 2 else "lunch meeting report notes ") + chr(97 + i % 26) * 3) for i in range(80)]
    res = ML.train_grid(ML.prepare_split(spark.createDataFrame(rows, "doc_id long, label string, text string")), [(ML.TFIDF, ML.LR), (ML.TFIDF, ML.SVM), (ML.TFIDF, ML.NB)])
    assert {r["f1_score"] for r in res.metrics.collect()} == {1.0} and not kept
    assert set(seen) == {ML.LR, ML.SVM, ML.NB} and all(s == (["y", "weight", "features"], 7) for s in seen.values())
