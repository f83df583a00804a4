import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from missive.operators import forest as FO
from missive.operators import ml as ML


def _rows(spark, n, seed=1, size=40):
    """Sparse rows; spam where columns 3 and 7 are both there, and a tenth of the labels at random."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        at = sorted({int(j) for j in rng.integers(0, size, 8)} | ({3, 7} if i % 3 == 0 else set()))
        y = float({3, 7} <= set(at)) if rng.random() > 0.1 else float(rng.integers(0, 2))
        out.append((i, y, 1.0, Vectors.sparse(size, at, rng.random(len(at)).tolist())))
    return spark.createDataFrame(out, ["doc_id", "y", "weight", "features"]).withColumn("y", F.col("y").cast("double"))


def _jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_follow_the_nodes(spark):
    """Passes over the rows are as many for deep trees as for shallow ones."""
    few, jobs_few = _jobs(spark, "forest-few", lambda: ML.fit_model(ML.RF, ML.TFIDF, _rows(spark, 12), 12))
    many, jobs_many = _jobs(spark, "forest-many", lambda: ML.fit_model(ML.RF, ML.TFIDF, _rows(spark, 600), 600))
    assert jobs_many <= jobs_few + 2


@pytest.fixture(scope="module")
def forest(spark):
    train = _rows(spark, 900).repartition(3)
    return FO.Forest.fit(train, 20, 30, 42, node_entries=2000, block_entries=1500), train


def test_large_nodes_are_split_over_blocks(spark, forest):
    model, _ = forest
    assert all(model.splits) and model.buckets > 1
    test = _rows(spark, 300, seed=2)
    found = ML.spam_probability(model, test).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(300)) and set(found[0].asDict()) == {"doc_id", "y", "weight", "features", "p"}
    right = np.mean([(r["p"] >= 0.5) == ({3, 7} <= set(r["features"].indices.tolist())) for r in found])
    assert right >= 0.95
    small = FO.Forest.fit(_rows(spark, 900), 20, 30, 42).probability(test)   # every tree is grown in one task
    alike = small.select("doc_id", F.col("p").alias("q")).join(ML.spam_probability(model, test), "doc_id")
    assert alike.agg(F.avg(F.abs(F.col("p") - F.col("q")))).first()[0] < 0.1


def test_saved_forest_scores_alike(spark, forest, tmp_path):
    model, _ = forest
    ML.save_model(model, f"{tmp_path}/rf")
    test = _rows(spark, 50, seed=3)
    again = ML.load_model(ML.RF, f"{tmp_path}/rf")
    assert {r["doc_id"]: r["p"] for r in again.probability(test).collect()} == {r["doc_id"]: r["p"] for r in model.probability(test).collect()}


def test_hot_subtrees_go_to_several_tasks(spark, forest, monkeypatch):
    model, _ = forest
    test = _rows(spark, 60, seed=4)
    whole = {r["doc_id"]: r["p"] for r in model.probability(test).collect()}
    monkeypatch.setattr(FO, "NODE_ENTRIES", 50)
    spread = model.probability(test.repartition(6))
    assert {r["doc_id"]: r["p"] for r in spread.collect()} == whole
    assert model.probability(test.limit(0)).count() == 0


def test_dense_and_negative_values(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 9))
    rows = [(float(v[2] > -0.3), 1.0, Vectors.dense(v)) for v in x]
    df = spark.createDataFrame(rows, ["y", "weight", "features"]).repartition(3)
    for entries in (FO.NODE_ENTRIES, 400):
        model = FO.Forest.fit(df, 15, 30, 42, node_entries=entries, block_entries=900)
        assert ML.spam_probability(model, df).filter((F.col("p") >= 0.5) == (F.col("y") == 1)).count() >= 285


def test_one_class_and_empty_vectors(spark):
    one = spark.createDataFrame([(0.0, 1.0, Vectors.sparse(4, [1], [0.5]))] * 10, ["y", "weight", "features"])
    assert {r["p"] for r in ML.spam_probability(FO.Forest.fit(one, 5, 30, 42), one).collect()} == {0.0}
    blank = spark.createDataFrame([(float(i % 2), 1.0, Vectors.sparse(4, [], [])) for i in range(40)], ["y", "weight", "features"])
    p = [r["p"] for r in ML.spam_probability(FO.Forest.fit(blank, 50, 30, 42), blank).collect()]
    assert len(set(p)) == 1 and 0.3 < p[0] < 0.7
    with pytest.raises(ValueError):
        FO.Forest.fit(one.limit(0), 5, 30, 42)


def test_sums_and_splits_are_those_of_dense_rows():
    rng = np.random.default_rng(6)
    n, size = 60, 7
    dense = np.where(rng.random((n, size)) < 0.4, rng.integers(0, 6, (n, size)), 2)
    zero = np.full(size, 2)
    y, w = rng.integers(0, 2, n).astype(np.uint8), rng.integers(1, 4, n).astype(np.float64)
    held = [np.flatnonzero(r != 2) for r in dense]
    ends = np.r_[0, np.cumsum([len(h) for h in held])].astype(np.int64)
    at, x = np.concatenate(held).astype(np.uint16), np.concatenate([r[h] for r, h in zip(dense, held)]).astype(np.uint8)
    block = FO._Block(0, y.tobytes(), w.tobytes(), ends.tobytes(), at.tobytes(), x.tobytes(), zero).by_column()
    splits = [[0, 1, 2, 1], [0, 4, 0, 2], [1, 5, 3, 3]]
    slot = np.zeros(n, int)
    for s, f, t, right in splits:
        slot[(slot == s) & (dense[:, f] > t)] = right
    assert block.slots(splits).tolist() == slot.tolist()
    both = np.stack([w * (y == 0), w * (y == 1)], axis=-1)
    sums, total = block.sums(slot == 2, both, np.arange(size))
    inside = slot == 2
    want = np.array([[both[inside & (dense[:, f] == b)].sum(axis=0) for b in range(FO.BINS)] for f in range(size)])
    assert np.allclose(sums, want) and np.allclose(total, both[inside].sum(axis=0))

    def gini(r):
        a, b = both[r].sum(axis=0)
        return 0.0 if a + b == 0 else (a + b) * (1 - (a * a + b * b) / (a + b) ** 2)

    gains = {(f, t): gini(inside) - gini(inside & (dense[:, f] <= t)) - gini(inside & (dense[:, f] > t)) for f in range(size) for t in range(6)}
    f, t, _ = FO._split(sums, total)
    assert math.isclose(gains[f, t], max(gains.values()), abs_tol=1e-9)
    grown = FO._grow(y, w, ends, at, x, zero, size, 30, np.random.default_rng(0))
    nodes = dict(zip(("feature", "bin", "left", "right", "p"), grown))
    p = FO._walk(nodes, ends, at, x, zero)
    alike = {}
    for row, q in zip(map(tuple, dense), p):
        assert alike.setdefault(row, q) == q
    lone = [i for i, r in enumerate(map(tuple, dense)) if sum(r == tuple(o) for o in dense) == 1]
    assert all(p[i] == y[i] for i in lone) and len(lone) > 30
