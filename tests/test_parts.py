import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.functions import lemma as L
from missive.operators import features as FE
from missive.operators import parts as P
from missive.operators import wordvec as WV


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(P, "PART_WORDS", 40)


def _texts(n=120, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["red", "blue", "cats", "dogs", "men", f"once{i}"]) for _ in range(rng.randrange(0, 9))) for i in range(n)] + ["", "red", "red red red"]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, clean_text string")


def test_skip_gram_is_a_table_trained_in_parts(spark):
    """Every word has a vector, names of one thing are alike, and no model is on the driver."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(p) for p in rng.choice(([("car", "auto"), ("road", "street"), ("wheel", "tyre")],
                                                        [("bread", "loaf"), ("oven", "stove"), ("cake", "bun")]))) for _ in range(3000)] + ["once", ""]
    model = FE.fit_word2vec(_frame(spark, texts), vector_size=16, num_partitions=3)
    assert isinstance(model, WV.WordVectors)
    got = {r["word"]: r["vector"].toArray() for r in model.getVectors().collect()}
    assert set(got) == {w for t in texts for w in t.split()} and all(np.isfinite(v).all() and v.any() for v in got.values())
    unit = {w: v / np.linalg.norm(v) for w, v in got.items()}
    assert unit["car"] @ unit["auto"] > unit["car"] @ unit["loaf"] + 0.2 and unit["bread"] @ unit["loaf"] > unit["bread"] @ unit["street"] + 0.2
    often = FE.fit_word2vec(_frame(spark, texts), vector_size=4, epochs=1, min_count=2, num_partitions=2)
    assert {r["word"] for r in often.getVectors().collect()} == set(got) - {"once"}


def test_means_by_part(spark, small_parts):
    """rows of many parts, copies, empty and null texts, repeated and null keys."""
    vectors = spark.createDataFrame([("red", [1.0, 2.0]), ("cats", [3.0, -4.0]), ("dogs", [1.0, 0.0]), ("dogs", [0.0, 5.0])], "word string, v array<double>")
    from pyspark.ml.functions import array_to_vector
    table = WV.WordVectors(vectors.select("word", array_to_vector("v").alias("vector")), 2)
    known = {"red": [(1.0, 2.0)], "cats": [(3.0, -4.0)], "dogs": [(1.0, 0.0), (0.0, 5.0)]}   # each vector of a word counts
    texts = [*_texts(), None]
    df = spark.createDataFrame([(None if i % 7 == 0 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, clean_text string")
    got = Counter((r["clean_text"], tuple(r["features"].toArray())) for r in FE.mean_vectors(table, df, key_col="doc_id").collect())
    mean = lambda t: tuple(round(sum(x) / len(x), 12) for x in zip(*([x for w in (t or "").split() for x in known.get(w, [])] or [(0.0, 0.0)])))
    assert got == Counter((t, mean(t)) for t in texts)


def test_lemmas_by_part(spark, small_parts):
    """lemmas of many parts; no occurrence is shuffled by itself."""
    texts = _texts()
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(texts)] + [(None, ["cats"])], "id long, tokens array<string>") \
        .withColumn("tokens", F.split(F.array_join("tokens", " "), " ")).withColumn("tokens", F.filter("tokens", lambda x: x != ""))   # no null inside
    lex = spark.createDataFrame([("cat",), ("dog",), ("man",), ("dogs",)], "lemma string")
    out = L.lemmatize(df, lexicon=lex, key_col="id")
    want = {"cats": "cat", "dogs": "dog"}   # "men" alone is no noun with an ending
    assert {r["id"]: (r["tokens"], r["lemmas"]) for r in out.collect()} == {
        **{i: (t.split(), [want.get(w, w) for w in t.split()]) for i, t in enumerate(texts)}, None: (["cats"], [])}
    assert "posexplode" not in out._jdf.queryExecution().toString()


def test_pair_weights_equal_ppmi_of_pair_counts(spark, small_parts):
    """totals that travel with the pairs give the weights of the three joins."""
    rows = _frame(spark, _texts()).select(F.filter(F.split("clean_text", " "), lambda x: x != "").alias("w"))
    for window in (1, 5):
        want = {(r["a"], r["b"]): r["weight"] for r in WV.ppmi(WV.pair_counts(rows, "w", window)).collect()}
        found = WV.pair_weights(rows, "w", window).collect()
        assert len(found) == len(want) and {(r["a"], r["b"]): pytest.approx(r["weight"], abs=1e-9) for r in found} == want


def test_bigram_counts_by_part(spark, small_parts):
    """Bigrams are counted in as many tasks as the words need."""
    texts = [*_texts(), None, "single", "x y"]
    counts = FE.bigram_counts(_frame(spark, texts))
    words = [[w for w in (t or "").split() if len(w) > 1] for t in texts]
    assert {r["bigram"]: r["n"] for r in counts.collect()} == Counter(f"{a} {b}" for w in words for a, b in zip(w, w[1:]))


def test_large_texts_train_in_fewer_parts_and_vectors_are_moved_once(spark, small_parts, monkeypatch):
    """Parts grow beyond some dozens, vectors of a round are in its shuffle only, means of float32 vectors stay exact."""
    from missive.operators import skipgram as SG
    monkeypatch.setattr(SG, "FEW_PARTS", 3)
    monkeypatch.setattr(SG, "TRAIN_WORDS", 400)
    assert [SG.parts_of(n) for n in (0, 40, 100, 120, 1000, 2000)] == [1, 1, 3, 3, 3, 5]
    tables, write = [], SG.materialise
    monkeypatch.setattr(SG, "materialise", lambda df, name: tables.append(name) or write(df, name))
    texts = _texts(300)
    model = SG.fit(_frame(spark, texts), F.filter(F.split("clean_text", " "), lambda x: x != ""), 6, 2, 1, 4, 1)
    assert tables == ["skipgram-vectors"] and model.single
    known = {r["word"]: r["vector"].toArray() for r in model.getVectors().collect()}
    assert set(known) == {w for t in texts for w in t.split()} and all((v == v.astype(np.float32)).all() and v.any() for v in known.values())
    got = {r["doc_id"]: r["features"].toArray() for r in FE.mean_vectors(model, _frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], np.mean([known[w] for w in t.split()] or [np.zeros(6)], axis=0), rtol=0, atol=1e-11)
