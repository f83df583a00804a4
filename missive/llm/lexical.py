"""Operator 11: ranked lexical search by hashed max-sketches.

The index has two written tables. The forward table holds each document's
distinct terms and their counts. The sketch table folds the impacts of a
document's terms (the part of a term's score that does not depend on the
query) into two halves of ``width`` coordinates: a term's hash names one
coordinate in each half, and a coordinate keeps the largest impact that falls
into it, rounded up. ``width`` is the power of two from ``SLOTS`` times the
number of distinct terms on, so long documents are not saturated.

A query term can score no more than its weight times the smaller of its two
coordinates, so one gather over a block of sketches, for all queries of a
block, gives upper bounds of whole scores (``_bounds``). Search then goes down
the bounds: each query's highest-bound documents are scored exactly from the
forward table, the k-th best score becomes the query's threshold, and the next
round takes only bounds that reach it. The last round takes all that do, so no
document that could be among the best is missed; sketches decide only which
documents are scored, never a score.

Queries come in blocks of bounded size, each broadcast; documents are never
broadcast, and only k thresholds a query of a block come to the driver.

Defined cases: a null, empty or term-less text is indexed, is not counted in
N, and is never found; a query without known terms finds nothing; no
documents or no queries give an empty result; equal scores rank by ascending
``doc_id``, null last; rows that repeat a ``doc_id`` rank as documents of
their own; rows that repeat an ``item_id`` are queries of their own, each with
ranks from 1; texts may be of any length (a sketch holds 2 bytes a slot, 16
to 32 slots a distinct term, most of them zeros that Parquet packs); only the
named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from missive.llm.common import BROADCAST_ROWS, LOWER, UPPER, bitmaps_of, in_bitmaps, quoted, small_batches
from missive.session import materialise

#: A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII (fixed value).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Slots of each half of a sketch for each distinct term, at least; and the fewest slots.
SLOTS = 8
LEAST_WIDTH = 64
#: Impacts are below 1,000,000; a sketch keeps them rounded up to a multiple of this in 16 bits.
UNIT = 16
#: A block of queries has about this many queries and distinct terms at most.
BLOCK_QUERIES = 1024
BLOCK_TERMS = 1 << 18
#: Documents scored for each query in the rounds before the last, as multiples of k.
ROUNDS = (1, 16)
#: Numbers of a matrix of sketches that is looked up at once.
LOOKUP = 1 << 21

_TO_LOWER = str.maketrans(UPPER, LOWER)


@dataclass
class Index:
    forward: DataFrame    # row, doc_id, n, terms, tfs
    sketches: DataFrame   # row, width, sketch
    n_docs: int           # documents with a term
    n_terms: int          # their terms, with repeats


def _terms_of(text: str | None, find=re.compile(TERM).findall) -> Counter:
    counts: Counter = Counter()
    for word, n in Counter(find(text or "")).items():
        counts[word.lower() if word.isascii() else word.translate(_TO_LOWER)] += n
    return counts


def count_terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, terms, tfs: the distinct terms of each text with their counts."""
    kind = rows.schema[key].dataType
    schema = T_.StructType([T_.StructField("key", kind), T_.StructField("n", T_.LongType()),
                            T_.StructField("terms", T_.ArrayType(T_.StringType())),
                            T_.StructField("tfs", T_.ArrayType(T_.LongType()))])

    def count(batches):
        for batch in batches:
            counts = [_terms_of(t) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c.total() for c in counts], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(counts)), pa.string())),
                 pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(c.values() for c in counts)), pa.int64()))],
                ["key", "n", "terms", "tfs"])

    return rows.select(quoted(key), quoted(text)).mapInArrow(count, schema)


def _impacts(tf: np.ndarray, n, n_docs: int, n_terms: int) -> np.ndarray:
    m = 100 - 75 + (75 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _slots(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The coordinates of terms: one from the low bits of their hashes, one, in the second half, from the high bits."""
    return hashes & (width - 1), width + ((hashes >> 32) & (width - 1))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Read every row once, write the forward and the sketch table."""
    small_batches(docs.sparkSession)
    forward = materialise(count_terms(docs, doc_id, text).withColumnRenamed("key", "doc_id")
                          .withColumn("row", F.monotonically_increasing_id()), "lexical-forward")
    n_docs, n_terms = forward.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def fold(batches):
        for batch in batches:
            rows, ns, hashes, tfs = (batch.column(i) for i in range(4))
            widths, sketches = [], []
            for i, n in enumerate(ns.to_pylist()):
                h, tf = hashes[i].values.to_numpy(), tfs[i].values.to_numpy()
                width = max(LEAST_WIDTH, 1 << (SLOTS * len(h) - 1).bit_length())
                sketch = np.zeros(2 * width, np.uint16)
                impact = -(-_impacts(tf, n, n_docs, n_terms) // UNIT)
                for at in _slots(h, width):
                    np.maximum.at(sketch, at, impact)
                widths.append(width)
                sketches.append(sketch.tobytes())
            yield pa.RecordBatch.from_arrays([rows, pa.array(widths, pa.int64()), pa.array(sketches, pa.binary())],
                                             ["row", "width", "sketch"])

    hashed = forward.filter("n > 0").select("row", "n", F.transform("terms", lambda t: F.xxhash64(t)).alias("hashes"), "tfs")
    sketches = materialise(hashed.mapInArrow(fold, "row long, width long, sketch binary"), "lexical-sketches")
    return Index(forward, sketches, n_docs, n_terms)


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

def weighted_queries(index: Index, queries: DataFrame, item_id: str, text: str) -> DataFrame:
    """query, item_id, weights: array of (term, hash, weight times occurrences) of the terms that some document has."""
    counted = materialise(count_terms(queries, item_id, text).withColumnRenamed("key", "item_id")
                          .withColumn("query", F.monotonically_increasing_id()), "lexical-queries")
    terms = counted.select("query", "item_id", F.explode(F.arrays_zip("terms", "tfs")).alias("t")) \
        .select("query", "item_id", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    wanted = materialise(terms.select("term").distinct(), "lexical-terms")
    held = index.forward.select(F.explode("terms").alias("term"))
    if wanted.count() <= BROADCAST_ROWS:   # else all terms are counted and the counts are joined
        held = held.join(F.broadcast(wanted), "term")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(wanted, "term", "left_semi")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * index.n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    return (terms.join(df, "term")
            .groupBy("query", "item_id")
            .agg(F.collect_list(F.struct("term", F.xxhash64("term").alias("hash"),
                                         (weight * F.col("times")).cast("long").alias("weight"))).alias("weights")))


def _bounds(batches, plan):
    """For chunks of sketches: their row numbers and the (queries, rows) matrix of upper bounds."""
    for batch in batches:
        rows, widths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        sketches = batch.column(2)
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            for part in np.array_split(at, min(len(at), -(-len(at) * 2 * int(width) // LOOKUP))):
                block = np.frombuffer(b"".join(sketches[i].as_py() for i in part.tolist()), np.uint16)
                slots = np.ascontiguousarray(block.reshape(len(part), 2 * int(width)).T)
                bounds = np.empty((len(plan), len(part)))
                for q, (_, h, w) in enumerate(plan):
                    low, high = _slots(h, int(width))
                    bounds[q] = UNIT * (w @ np.minimum(slots[low], slots[high]).astype(np.float64))
                yield rows[part], bounds


def _highest(index: Index, plan, take: int, floors) -> DataFrame:
    """query, row, bound: each task's ``take`` highest bounds of each query that reach its floor."""
    def best(batches):
        q = len(plan.value)
        bounds, rows = np.zeros((q, 0)), np.zeros((q, 0), np.int64)
        least = np.asarray(floors, np.float64)[:, None]
        for some, b in _bounds(batches, plan.value):
            bounds = np.concatenate([bounds, np.where(b >= least, b, 0)], axis=1)
            rows = np.concatenate([rows, np.broadcast_to(some, b.shape)], axis=1)
            if bounds.shape[1] > take:
                keep = np.argpartition(-bounds, take - 1, axis=1)[:, :take]
                bounds, rows = np.take_along_axis(bounds, keep, 1), np.take_along_axis(rows, keep, 1)
        yield _pairs(plan.value, bounds, rows, bounds > 0)

    pairs = index.sketches.mapInArrow(best, "query long, row long, bound long")
    order = Window.partitionBy("query").orderBy(F.col("bound").desc(), "row")
    return pairs.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= take).drop("at")


def _reaching(index: Index, plan, floors) -> DataFrame:
    """query, row, bound: all whose bound reaches the floor of the query."""
    def reach(batches):
        least = np.maximum(np.asarray(floors, np.float64), 1)[:, None]
        for some, b in _bounds(batches, plan.value):
            yield _pairs(plan.value, b, np.broadcast_to(some, b.shape), b >= least)

    return index.sketches.mapInArrow(reach, "query long, row long, bound long")


def _pairs(plan, bounds, rows, wanted) -> pa.RecordBatch:
    q, at = np.nonzero(wanted)
    ids = np.array([p[0] for p in plan], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[q]), pa.array(rows[q, at]), pa.array(bounds[q, at].astype(np.int64))], ["query", "row", "bound"])


def _exact(index: Index, weights, pairs: DataFrame) -> DataFrame:
    """query, row, doc_id, score: exact scores above 0 of (query, row) pairs, from the documents' term counts."""
    n_docs, n_terms = index.n_docs, index.n_terms

    def score(batches):
        for batch in batches:
            out_q, out_i, out_s = [], [], []
            for i, (n, terms, tfs, asked) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)))):
                impact = dict(zip(terms, _impacts(np.array(tfs, np.int64), n, n_docs, n_terms).tolist()))
                for q in asked:
                    s = sum(w * impact.get(t, 0) for t, w in weights.value[q])
                    if s > 0:
                        out_q.append(q)
                        out_i.append(i)
                        out_s.append(s)
            at = pa.array(out_i, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                                              pa.array(out_s, pa.int64())], ["query", "row", "doc_id", "score"])

    pairs = materialise(pairs.select("query", "row"), "lexical-pairs")
    asked = pairs.groupBy("row").agg(F.collect_list("query").alias("asked"))   # a row's list: one block's queries at most
    if pairs.count() <= BROADCAST_ROWS:
        found = index.forward.join(F.broadcast(asked), "row")
    else:   # only documents that may be asked for are shuffled
        asked = materialise(asked, "lexical-asked")
        h = F.xxhash64("row").alias("h")
        bitmaps, bits = bitmaps_of(asked.select(h), asked.count())
        found = in_bitmaps(index.forward.select("*", h), "h", bitmaps, bits).join(asked, "row")
    schema = T_.StructType([T_.StructField("query", T_.LongType()), T_.StructField("row", T_.LongType()),
                            T_.StructField("doc_id", index.forward.schema["doc_id"].dataType),
                            T_.StructField("score", T_.LongType())])
    return found.select("row", "doc_id", "n", "terms", "tfs", "asked").mapInArrow(score, schema)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search_block(index: Index, rows: list, k: int) -> DataFrame:
    spark = index.forward.sparkSession
    sc = spark.sparkContext
    plan = sc.broadcast([(r["query"], np.array([t["hash"] for t in r["weights"]], np.int64),
                          np.array([t["weight"] for t in r["weights"]], np.float64)) for r in rows])
    weights = sc.broadcast({r["query"]: [(t["term"], t["weight"]) for t in r["weights"]] for r in rows})
    floors = [1] * len(rows)
    for many in ROUNDS:
        found = _ranked(_exact(index, weights, _highest(index, plan, many * k, floors)), k)
        last = {r["query"]: r["least"] for r in found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
                .filter(F.col("n") == k).collect()}   # one number a query of the block
        floors = [max(f, last.get(r["query"], 1)) for f, r in zip(floors, rows)]
    return materialise(_ranked(_exact(index, weights, _reaching(index, plan, floors)), k), "lexical-found")


def search(index: Index, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: each query's ``k`` best documents."""
    spark = index.forward.sparkSession
    small_batches(spark)
    weighted = materialise(weighted_queries(index, queries, item_id, text), "lexical-weighted")
    size = weighted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("weights")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // BLOCK_QUERIES), -(-size[1] // BLOCK_TERMS))
    out = None
    for b in range(blocks):
        block = weighted.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        rows = block.select("query", "weights").collect()   # bounded by the size of a block
        if rows:
            found = _search_block(index, rows, k).join(block.select("query", "item_id"), "query")
            out = found if out is None else out.unionByName(found)
    if out is None:
        schema = T_.StructType([T_.StructField("item_id", queries.schema[item_id].dataType), T_.StructField("rank", T_.IntegerType()),
                                T_.StructField("doc_id", index.forward.schema["doc_id"].dataType), T_.StructField("score", T_.LongType())])
        return spark.createDataFrame([], schema)
    return out.select("item_id", "rank", "doc_id", "score")
