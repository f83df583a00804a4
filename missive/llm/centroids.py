"""Operator 12: centroid clustering with an incremental distance matrix.

Vectors become integers, so all products and sums are exact. The state, one
row a vector, holds the vector, its squared norm and its dot product with
every centroid, and is written between the rounds. A round does not compute
distances anew: for each centroid it adds the products with those components
of the centroid that changed (none, if the centroid stayed), and takes the
argmin of ``norm + |c|^2 - 2 * dot``. The centroids start from zero, so the
first round is the same step. New centroids are sums by cluster and component:
partial sums before a shuffle of ``k * dims`` rows a task. Only the centroids
(``k * dims`` integers) and the inertia (``k`` numbers) come to the driver.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component are left out; so are those with a component of 2**21 or
more (their squared distances may not fit 64 bits); with fewer vectors than
``k`` there are as many centroids as vectors; an empty table gives an empty
result; of equal distances the smaller centroid wins; repeated rows are
vectors of their own, and equal hashes (repeated ids) start in the order of
their components; a null ``vec_id`` is hashed as an empty one; an empty
cluster's centroid stays; only the two named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from missive.llm.common import quoted
from missive.session import materialise

#: Components must be smaller than this, so that distances of scaled vectors fit 64 bits.
LARGEST = float(1 << 21)


def integer_vectors(rows: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """vec_id, v: the kept vectors as integers ``floor(scale * x)``."""
    e = quoted(embedding)
    fine = e.isNotNull() & (F.size(e) == dims) & F.forall(
        e, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(LARGEST), F.lit(False)) & ~F.isnan(x.cast("double")))
    v = F.when(fine, F.transform(e, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))
    return rows.select(quoted(vec_id).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull())


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The vectors of the ``k`` smallest hashes of ``salt`` and id, in hash order."""
    hashed = vectors.select("v", F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256).alias("h"))
    return [r["v"] for r in hashed.orderBy("h", "v").limit(k).collect()]   # k vectors


def _update(state: DataFrame, old: np.ndarray, new: np.ndarray, name: str) -> DataFrame:
    """The state after the centroids moved from ``old`` to ``new``: vec_id, v, norm, dots, cluster, distance."""
    moved = [(j, np.flatnonzero(d), d[np.flatnonzero(d)]) for j, d in enumerate(new - old) if d.any()]
    lengths = (new * new).sum(axis=1)
    k, dims = new.shape

    def step(batches):
        for batch in batches:
            ids = batch.column(0)
            n = len(ids)
            v = batch.column(1).flatten().to_numpy().reshape(n, dims)
            norm = batch.column(2).to_numpy()
            dots = batch.column(3).flatten().to_numpy().reshape(n, k).copy()
            for j, at, change in moved:
                dots[:, j] += v[:, at] @ change
            distance = norm[:, None] + lengths - 2 * dots
            cluster = distance.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1), batch.column(2), _lists(dots), pa.array(cluster.astype(np.int32)),
                 pa.array(distance[np.arange(n), cluster])], ["vec_id", "v", "norm", "dots", "cluster", "distance"])

    schema = T_.StructType([state.schema["vec_id"], T_.StructField("v", T_.ArrayType(T_.LongType())),
                            T_.StructField("norm", T_.LongType()), T_.StructField("dots", T_.ArrayType(T_.LongType())),
                            T_.StructField("cluster", T_.IntegerType()), T_.StructField("distance", T_.LongType())])
    return materialise(state.select("vec_id", "v", "norm", "dots").mapInArrow(step, schema), name)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, k = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(matrix.reshape(-1)))


def _means(state: DataFrame, old: np.ndarray) -> np.ndarray:
    """Componentwise floor of sum / count of every cluster with a vector; others stay."""
    sums = (state.select("cluster", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim")
            .agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n")).collect())   # k * dims rows
    new = old.copy()
    for r in sums:
        new[r["cluster"], r["dim"]] = r["total"] // r["n"]
    return new


def centroid_clusters(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = 64,
                      k: int = 16, rounds: int = 3, scale: int = 64, salt: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, norm, dots, cluster, distance) after ``rounds`` rounds and a last assignment, and the final centroids."""
    spark = rows.sparkSession
    vectors = materialise(integer_vectors(rows, vec_id, embedding, dims, scale), "centroid-vectors")
    start = first_centroids(vectors, k, salt)
    now = np.array(start, np.int64).reshape(len(start), dims)
    old = np.zeros_like(now)
    state = vectors.select("vec_id", "v", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("norm"),
                           F.array_repeat(F.lit(0).cast("long"), len(start)).alias("dots"))
    if not start:
        return state.withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), now
    for r in range(rounds + 1):
        state = _update(state, old, now, f"centroid-state-{r}")
        if r < rounds:
            old, now = now, _means(state, now)
    return state, now


def with_inertia(state: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = state.sparkSession
    sums = {r["cluster"]: r["total"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    whole = sum(sums.values())
    rows = [(j, sums[j], whole, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j in sorted(sums)]
    side = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (state.select("vec_id", "cluster", "distance").join(F.broadcast(side), "cluster")   # at most k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
