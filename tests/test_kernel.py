import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from missive.operators import ml as ML
from missive.operators.kernel import FourierMap, scale_gamma


def _rings(spark, n=600, seed=1):
    """A ring of spam around a disc of ham: no line separates them."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        spam = i % 2 == 0
        r = (2.0 if spam else 0.7) + rng.normal(0, 0.15)
        a = rng.uniform(0, 2 * math.pi)
        rows.append((float(spam), 1.0, Vectors.dense([r * math.cos(a), r * math.sin(a)])))
    return spark.createDataFrame(rows, ["y", "weight", "features"])


def _accuracy(model, df):
    return ML.spam_probability(model, df).select(F.avg(((F.col("p") >= 0.5).cast("double") == F.col("y")).cast("double"))).first()[0]


def test_rbf_separates_rings_that_no_line_does(spark, tmp_path):
    train, test = _rings(spark), _rings(spark, 400, 2)
    rbf, linear = ML.PlattSVM.fit(train, "rbf"), ML.PlattSVM.fit(train, "linear")
    assert _accuracy(rbf, test) > 0.95
    assert _accuracy(linear, test) < 0.7
    rbf.save(f"file://{tmp_path}/m")
    again = ML.PlattSVM.load(f"file://{tmp_path}/m")
    assert again.feature_map == rbf.feature_map
    probabilities = [[r["p"] for r in ML.spam_probability(m, test).collect()] for m in (rbf, again)]
    assert probabilities[0] == probabilities[1]
    linear.save(f"file://{tmp_path}/l")
    assert ML.PlattSVM.load(f"file://{tmp_path}/l").feature_map is None


def test_kernel_error_is_bounded(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (40, 6))
    x[:, 3] = 0.0
    sparse = [Vectors.sparse(6, [(j, float(v)) for j, v in enumerate(r) if v]) for r in x]
    dense = [Vectors.dense(r.tolist()) for r in x]
    gamma = 0.2
    exact = np.exp(-gamma * ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    errors = []
    for size in (256, 4096):
        fm = FourierMap(6, gamma, size)
        z = {}
        for name, vectors in (("sparse", sparse), ("dense", dense)):
            df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], ["i", "features"])
            z[name] = np.array([r["features"].toArray() for r in fm.transform(df).orderBy("i").collect()])
        assert np.array_equal(z["sparse"], z["dense"])
        errors.append(np.abs(z["dense"] @ z["dense"].T - exact).max())
        assert errors[-1] < 5 / math.sqrt(size)   # five standard errors
    assert errors[1] < errors[0]


def test_gamma_is_that_of_the_whole_matrix(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1, 2, (50, 4)) * (rng.random((50, 4)) < 0.5)
    df = spark.createDataFrame([(Vectors.dense(r.tolist()) if i % 2 else Vectors.sparse(4, [(j, float(v)) for j, v in enumerate(r) if v]),)
                                for i, r in enumerate(x)], ["features"])
    assert scale_gamma(df) == pytest.approx(1 / (4 * x.var()), rel=1e-9)
    assert FourierMap.fit(df).columns == 4
    assert scale_gamma(df.limit(0)) == 1.0


def test_rows_without_a_key_column_and_unknown_kernels(spark):
    train = _rings(spark, 60)
    with pytest.raises(ValueError):
        ML.PlattSVM.fit(train, "cubic")
    same = spark.createDataFrame([(float(i % 2), 1.0, Vectors.dense([1.0, 2.0])) for i in range(20)], ["y", "weight", "features"])
    p = [r["p"] for r in ML.spam_probability(ML.PlattSVM.fit(same), same).collect()]   # equal rows fill one fold
    assert all(0.4 < x < 0.6 for x in p)
