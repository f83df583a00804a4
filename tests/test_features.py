import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from missive.operators import features as FE

CORPUS = ["free prize claim now", "meeting lunch today", "free free cash prize", "lunch today maybe", "x"]


def _brute_tfidf(train, docs, max_features):
    def terms(t):
        toks = [w for w in t.split() if len(w) >= 2]
        return toks + [f"{a} {b}" for a, b in zip(toks, toks[1:])]
    counts = Counter(term for t in train for term in terms(t))
    top = sorted(counts, key=lambda k: (-counts[k], k))[:max_features]
    n = len(train)
    df_ = {k: sum(1 for t in train if k in terms(t)) for k in top}
    idf = {k: math.log((1 + n) / (1 + df_[k])) + 1 for k in top}
    out = {}
    for i, t in enumerate(docs):
        tf = Counter(x for x in terms(t) if x in idf)
        w = {k: (1 + math.log(c)) * idf[k] for k, c in tf.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for k, v in w.items():
            out[(i, k)] = v / norm
    return out


def test_tfidf_matches_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, clean_text string")
    model = FE.TfidfModel.fit(df, max_features=6)
    got = {(r["doc_id"], r["term"]): r["weight"] for r in model.weights_long(df, ["doc_id"]).collect()}
    want = _brute_tfidf(CORPUS, CORPUS, 6)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_materialised_vectors_are_unit_or_zero(spark):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, clean_text string")
    model = FE.TfidfModel.fit(df, max_features=6)
    vecs = model.materialise(df)
    for r in vecs.collect():
        norm = math.sqrt(sum(x * x for x in r["features"].toArray()))
        assert norm == pytest.approx(1.0) or norm == 0.0


def test_word2vec_mean_ignores_unknown_words(spark):
    train = spark.createDataFrame([(0, "alpha beta gamma"), (1, "beta gamma delta")], "doc_id long, clean_text string")
    model = FE.fit_word2vec(train, vector_size=8, epochs=2)
    vecs = {r["word"]: r["vector"].toArray() for r in model.getVectors().collect()}
    probe = spark.createDataFrame([(0, "alpha unknownword"), (1, "zzz qqq"), (2, "")], "doc_id long, clean_text string")
    got = {r["doc_id"]: r["features"].toArray() for r in FE.mean_vectors(model, probe).collect()}
    assert got[0] == pytest.approx(vecs["alpha"], rel=1e-5)
    assert all(x == 0.0 for x in got[1]) and all(x == 0.0 for x in got[2])


def test_embedding_mean(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (0, [5.0, 6.0])], "label int, embedding array<float>")
    got = {(r["label"], r["dim"]): r["mean_value"] for r in FE.embedding_mean(df).collect()}
    assert got == {(1, 0): 2.0, (1, 1): 3.0, (0, 0): 5.0, (0, 1): 6.0}


def test_word2vec_join_path_equals_map_path(spark, monkeypatch):
    train = spark.createDataFrame([(0, "alpha beta gamma"), (1, "beta gamma delta")], "doc_id long, clean_text string")
    model = FE.fit_word2vec(train, vector_size=8, epochs=2)
    probe = spark.createDataFrame([(0, "alpha unknownword beta"), (1, "zzz"), (2, "")], "doc_id long, clean_text string")
    a = {r["doc_id"]: r["features"].toArray() for r in FE.mean_vectors(model, probe).collect()}
    monkeypatch.setattr(FE, "MAX_BROADCAST_VOCAB", 1)
    b = {r["doc_id"]: r["features"].toArray() for r in FE.mean_vectors(model, probe, key_col="doc_id").collect()}
    no_key = FE.mean_vectors(model, probe.withColumnRenamed("doc_id", "id"))   # any frame, no key column
    c = {r["id"]: r["features"].toArray() for r in no_key.collect()}
    assert no_key.columns == ["id", "clean_text", "features"]
    for k in a:
        assert b[k] == pytest.approx(a[k], rel=1e-5, abs=1e-7)
        assert c[k] == pytest.approx(a[k], rel=1e-5, abs=1e-7)
