"""RBF kernel features (M6): a random Fourier map in front of a linear learner.

``exp(-gamma * |x - y|^2)`` is the expectation of ``z(x) . z(y)`` for
``z(x) = sqrt(2 / size) * cos(W x + b)`` with normal W (variance 2 * gamma) and
uniform b, so a linear SVM on ``z`` is an RBF-kernel SVM up to an error that
falls with ``1 / sqrt(size)``. A kernel matrix, which grows with the square of
the rows, is never built, and rows stay independent: the map is one Arrow
batch pass without a shuffle.

Each input column's slice of W comes from a generator seeded by (seed, column),
so the map is four numbers, the same on every worker and after a reload, and a
worker makes only the columns its rows use (at most inputs * size * 8 bytes).
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators.parts import lists
from missive.session import read_or_none

#: Random features of the map: the kernel's error is about 1 / sqrt(this).
SIZE = 512
SEED = 42


def scale_gamma(df: DataFrame, features_col: str = "features") -> float:
    """1 / (columns * variance of all entries), the usual default width of an RBF kernel.

    One pass; per-column sums come to the driver (columns numbers)."""
    if df.isEmpty():
        return 1.0
    row = df.select(Summarizer.metrics("mean", "normL2", "count").summary(F.col(features_col)).alias("s")).first()["s"]
    mean, norm2, n = row["mean"].toArray(), row["normL2"].toArray(), row["count"]
    variance = float((norm2 ** 2).sum() / (n * len(mean)) - mean.mean() ** 2) if len(mean) else 0.0
    return 1.0 / (len(mean) * variance) if variance > 0 else 1.0


@dataclass
class FourierMap:
    """A seeded random Fourier map of the RBF kernel with the given ``gamma``."""
    columns: int
    gamma: float
    size: int = SIZE
    seed: int = SEED

    @classmethod
    def fit(cls, df: DataFrame, features_col: str = "features", gamma: float | None = None, size: int = SIZE,
            seed: int = SEED) -> "FourierMap":
        first = df.select(F.unwrap_udt(features_col).alias("v")).select(F.coalesce("v.size", F.size("v.values"))).first()
        return cls(int(first[0]) if first else 0, gamma or scale_gamma(df, features_col), size, seed)

    def column(self, j: int) -> np.ndarray:
        """The slice of W for input column ``j``."""
        return np.random.default_rng((self.seed, j)).normal(0.0, math.sqrt(2.0 * self.gamma), self.size)

    def shifts(self) -> np.ndarray:
        return np.random.default_rng((self.seed, self.columns)).uniform(0.0, 2.0 * math.pi, self.size)

    def mapped(self, features: Column) -> Column:
        """The mapped vector (dense) of a vector column, sparse or dense."""
        scale, slices, shifts = math.sqrt(2.0 / self.size), {}, self.shifts()
        column = self.column

        @F.arrow_udf("array<double>")
        def fourier(indices: pa.Array, values: pa.Array) -> pa.Array:
            out = np.empty((len(values), len(shifts)))   # a batch is held once, and goes out as it is
            for k in range(len(values)):
                at, x, angle = indices[k].as_py(), values[k].as_py(), out[k]
                angle[:] = shifts
                for j, v in zip(range(len(x)) if at is None else at, x):
                    if v:
                        if j not in slices:
                            slices[j] = column(j)
                        angle += v * slices[j]
                np.cos(angle, out=angle)
                angle *= scale
            return lists(out)

        v = F.unwrap_udt(features)
        return array_to_vector(fourier(v.getField("indices"), v.getField("values")))

    def transform(self, df: DataFrame, features_col: str = "features", out_col: str = "features") -> DataFrame:
        return df.withColumn(out_col, self.mapped(F.col(features_col)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FourierMap | None":
        """The saved map; None where a model was saved without one."""
        found = read_or_none(lambda: spark.read.text(path))
        return None if found is None else cls(**json.loads(found.first()["value"]))
