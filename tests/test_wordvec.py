import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.operators import features as FE
from missive.operators import ml as ML
from missive.operators import wordvec as WV


CONCEPTS = [("car", "auto"), ("road", "street"), ("shop", "store"), ("bread", "loaf"), ("oven", "stove"), ("house", "home")]


def _texts(n=400, seed=2):
    """Walks around a ring of concepts; the two names of a concept never meet but keep the same company."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        at = rng.randrange(len(CONCEPTS))
        texts.append(" ".join([rng.choice(CONCEPTS[(at + j) % len(CONCEPTS)]) for j in range(rng.randrange(2, 6))] + [f"once{i}"]))
    return texts + ["", "alone", "same same same"]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, clean_text string")


def _counts(texts, window):
    c = Counter()
    for t in texts:
        w = t.split()
        for i, a in enumerate(w):
            for j in range(max(0, i - window), min(len(w), i + window + 1)):
                if i != j:
                    c[a, w[j]] += 1
    return c


@pytest.mark.parametrize("window", [1, 5])
def test_pairs_and_ppmi_match_brute_force(spark, window):
    texts = _texts(60)
    rows = _frame(spark, texts).select(F.filter(F.split("clean_text", " "), lambda x: x != "").alias("w"))
    pairs = WV.pair_counts(rows, "w", window)
    want = _counts(texts, window)
    got = {(r["a"], r["b"]): r["n"] for r in pairs.collect()}
    assert got == dict(want)
    total, row = sum(want.values()), Counter()
    for (a, _), n in want.items():
        row[a] += n
    weights = {(r["a"], r["b"]): r["weight"] for r in WV.ppmi(pairs).collect()}
    exact = {(a, b): math.log(n * total / (row[a] * row[b])) for (a, b), n in want.items()}
    assert weights.keys() == {k for k, v in exact.items() if v > 0}
    assert all(abs(weights[k] - exact[k]) < 1e-9 for k in weights)


def test_min_count(spark):
    texts = _texts(60)
    rows = _frame(spark, texts).select(F.filter(F.split("clean_text", " "), lambda x: x != "").alias("w"))
    often = {w for w, n in Counter(w for t in texts for w in t.split()).items() if n >= 3}
    got = {(r["a"], r["b"]): r["n"] for r in WV.frequent_pairs(WV.pair_counts(rows, "w"), rows, "w", 3).collect()}
    assert got == {k: n for k, n in _counts(texts, 5).items() if k[0] in often and k[1] in often}


def test_leading_vectors_match_dense_eigenvectors(spark):
    rng = np.random.default_rng(4)
    n = 30
    m = np.where(rng.random((n, n)) < 0.4, rng.random((n, n)), 0.0)
    m = m + m.T + np.diag(np.r_[[30.0, 20.0, 12.0], np.zeros(n - 3)])
    frame = spark.createDataFrame([(f"w{i}", f"w{j}", float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "a string, b string, weight double")
    rows = {r["word"]: r["v"] for r in WV.leading_vectors(frame, size=6, iterations=25).collect()}
    v = np.array([rows[f"w{i}"] for i in range(n)])
    values, vectors = np.linalg.eigh(m)
    for k in range(3):
        want = vectors[:, -1 - k] * math.sqrt(values[-1 - k])
        assert min(np.abs(v[:, k] - want).max(), np.abs(v[:, k] + want).max()) < 1e-6


def test_more_dimensions_than_words_and_no_words(spark):
    rows = {r["word"]: r["vector"].toArray() for r in WV.fit_word_vectors(_frame(spark, ["x y", "y z x"]), size=8).table.collect()}
    assert set(rows) == {"x", "y", "z"} and all(np.isfinite(v).all() and len(v) == 8 for v in rows.values())
    assert WV.fit_word_vectors(_frame(spark, ["", "alone"]), size=4).table.count() == 0


def test_synonyms_are_neighbours_and_vectors_feed_the_grid(spark, tmp_path):
    train = _frame(spark, _texts())
    vectors = WV.fit_word_vectors(train, size=12, min_count=1)
    assert vectors.table.filter("word like 'once%'").count() == 400   # words of one occurrence have vectors
    near = {}
    often = WV.fit_word_vectors(train, size=8, window=1, min_count=5)   # words of one occurrence are mere noise as neighbours
    assert often.table.count() == 12
    for r in WV.nearest(often, ["car", "loaf", "nowhere"], 1).collect():
        near.setdefault(r["word"], []).append(r["neighbour"])
    assert set(near) == {"car", "loaf"} and (near["car"], near["loaf"]) == (["auto"], ["bread"])
    vectors.save(f"file://{tmp_path}/v")
    again = WV.WordVectors.load(spark, f"file://{tmp_path}/v")
    df = spark.createDataFrame([(1, "car nowhere auto"), (2, "nowhere"), (3, ""), (4, None)], "doc_id long, clean_text string")
    got = {r["doc_id"]: r["features"].toArray() for r in FE.mean_vectors(again, df, key_col="doc_id").collect()}
    known = {r["word"]: r["vector"].toArray() for r in vectors.table.filter("word in ('car', 'auto')").collect()}
    assert np.allclose(got[1], (known["car"] + known["auto"]) / 2) and all(not got[i].any() and len(got[i]) == 12 for i in (2, 3, 4))
    without_key = FE.mean_vectors(again, df.drop("doc_id")).collect()
    assert len(without_key) == 4 and all(len(r["features"]) == 12 for r in without_key)


def test_grid_with_table_vectors(spark, tmp_path):
    rows = [(i, "spam" if i % 2 else "ham", ("cash prize winner claim " if i % 2 else "lunch meeting report notes ") + f"w{i}") for i in range(80)]
    split = ML.prepare_split(spark.createDataFrame(rows, "doc_id long, label string, text string"))
    model_dir = f"file://{tmp_path}/m"
    res = ML.train_grid(split, [(ML.W2V, ML.LR)], model_dir, word_vectors="ppmi")
    assert res.metrics.first()["f1_score"] > 0.9
    clf = ML.Classifier.load(spark, model_dir)
    assert isinstance(clf.vectorisers.w2v, WV.WordVectors)
    got = {r["text"]: r["is_spam"] for r in clf.score(spark.createDataFrame([("claim a cash prize",), ("lunch meeting",)], "text string")).collect()}
    assert got == {"claim a cash prize": True, "lunch meeting": False}


def test_blocks_of_a_few_words_give_the_weights_and_vectors_of_one(spark, monkeypatch):
    """Pairs are shuffled as packed numbers, by blocks; no pair is joined with a word or a vector."""
    rows = _frame(spark, _texts(150)).select(F.filter(F.split("clean_text", " "), lambda x: x != "").alias("w"))
    want = {(r["a"], r["b"]): r["weight"] for r in WV.ppmi(WV.pair_counts(rows, "w")).collect()}
    whole = {r["word"]: r["vector"].toArray() for r in WV.fit_word_vectors(_frame(spark, _texts(150)), size=6).table.collect()}
    for name, value in (("PAIR_WORDS", 60), ("BUCKET_WORDS", 40), ("BLOCK_PAIRS", 400), ("SLICE_BYTES", 700)):
        monkeypatch.setattr(WV, name, value)
    found = WV.pair_weights(rows, "w")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().replace("Join Inner, (word", "")   # places of the parts' words only
    got = found.collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): pytest.approx(r["weight"], abs=1e-9) for r in got} == want
    assert set(whole) == {a for a, _ in want}
    parts = {r["word"]: r["vector"].toArray() for r in WV.fit_word_vectors(_frame(spark, _texts(150)), size=6).table.collect()}
    again = {r["word"]: r["v"] for r in WV.leading_vectors(found.localCheckpoint(), size=6).collect()}
    assert set(parts) == set(again) == set(whole)
    words = sorted(whole)
    gram = lambda v: np.array([v[w] for w in words]) @ np.array([v[w] for w in words]).T  # noqa: E731   (directions of one eigenvalue may turn)
    for v in (parts, again):
        assert np.abs(gram(v) - gram(whole)).max() < 1e-4 * np.abs(gram(whole)).max()


def test_matrix_products_match_dense_ones_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    m = np.triu(np.where(rng.random((50, 50)) < 0.3, rng.random((50, 50)), 0.0))
    m = m + m.T + np.diag(np.r_[[40.0, 25.0], np.zeros(48)])
    monkeypatch.setattr(WV, "BUCKET_WORDS", 20)
    monkeypatch.setattr(WV, "SLICE_BYTES", 300)
    frame = spark.createDataFrame([(f"w{i}", f"w{j}", float(m[i, j])) for i in range(50) for j in range(50) if m[i, j]], "a string, b string, weight double")
    rows = {r["word"]: r["v"] for r in WV.leading_vectors(frame, size=4, iterations=20).collect()}
    values, vectors = np.linalg.eigh(m)
    for k in range(2):
        v, want = np.array([rows[f"w{i}"][k] for i in range(50)]), vectors[:, -1 - k] * math.sqrt(values[-1 - k])
        assert min(np.abs(v - want).max(), np.abs(v + want).max()) < 1e-6
