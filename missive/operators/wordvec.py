"""Word vectors without a model on the driver (F6): PPMI and block power iteration.

Words that stand within ``window`` places of each other are counted as pairs,
the counts become positive pointwise mutual information
``max(0, ln(n_ab * N / (n_a * n_b)))``, and the word vectors are the leading
eigenvectors of that symmetric matrix, scaled by the roots of their
eigenvalues. Everything that grows with the vocabulary is a table. Words are
dealt to buckets and have a place there, so that a pair is two numbers: pairs
are counted in parts of the texts, shuffled packed by the buckets of both words
(a block of the matrix), summed and weighted there. The product of the matrix
with vectors is one task for each block and slice of the columns, and only
``size * size`` numbers (the Gram matrix of a block) come to the driver.

Each iteration is written under the shared checkpoint folder, so a lost
executor costs one iteration at most. ``min_count`` may be 1: there is no
vocabulary to hold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.functions import text as T
from missive.operators import parts as P
from missive.session import materialise

SIZE = 100
WINDOW = 5
MIN_COUNT = 1
ITERATIONS = 6
#: Eigenvalues below this share of the largest are rounding error.
RANK = 1e-6
#: Words of a part whose pairs are counted together, words of a bucket, and counts or entries of a block (both at most about).
PAIR_WORDS, BUCKET_WORDS, BLOCK_PAIRS = 500_000, 120_000, 3_000_000
#: Vectors of a shuffled piece, bytes of the vectors of a bucket that a task multiplies, entries that it multiplies at once,
#: and entries of a stored piece of the matrix.
PIECE, SLICE_BYTES, AT_ONCE, STORED = 8192, 40 << 20, 4096, 500_000


def pair_counts(rows: DataFrame, words_col: str, window: int = WINDOW) -> DataFrame:
    """a, b, n: how often two words stand at most ``window`` places apart, in both orders.

    Counted as unordered pairs, which halves the shuffle, and mirrored after."""
    w, n = F.col(words_col), F.size(words_col)
    near = [F.zip_with(F.slice(w, F.lit(1), F.greatest(n - d, F.lit(0))), F.slice(w, F.lit(d + 1), F.greatest(n - d, F.lit(0))),
                       lambda x, y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))) for d in range(1, window + 1)]
    counts = (rows.select(F.explode(F.concat(*near)).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")))
    both = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", (2 * F.col("n")).alias("n")))) \
        .otherwise(F.array(F.struct("a", "b", "n"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    return counts.select(F.explode(both).alias("p")).select("p.a", "p.b", "p.n")


def frequent_pairs(pairs: DataFrame, rows: DataFrame, words_col: str, min_count: int) -> DataFrame:
    """The pairs of words that occur ``min_count`` times or more (places of rarer words stay taken)."""
    if min_count <= 1:
        return pairs
    often = (rows.select(F.explode(words_col).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("times"))
             .filter(F.col("times") >= min_count))
    often = materialise(often.select("word"), "frequent-words")
    return pairs.join(often.withColumnRenamed("word", "a"), "a", "left_semi").join(often.withColumnRenamed("word", "b"), "b", "left_semi") \
        .select("a", "b", "n")


def ppmi(pairs: DataFrame) -> DataFrame:
    """a, b, weight: the positive part of the pairs' pointwise mutual information. ``pairs`` should be a written table."""
    totals = materialise(pairs.groupBy("a").agg(F.sum("n").alias("n_a")), "word-totals")
    whole = totals.agg(F.sum("n_a")).first()[0] or 0
    other = totals.select(F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    weight = F.log(F.col("n") * F.lit(float(whole)) / (F.col("n_a").cast("double") * F.col("n_b")))
    return pairs.join(totals, "a").join(other, "b").select("a", "b", weight.alias("weight")).filter("weight > 0")


def _placed_words(totals: DataFrame, buckets: int) -> DataFrame:
    """bucket, at, word, n: the words of ``totals`` (word, n) dealt to buckets, numbered there in their order."""
    def number(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word")
        return pa.table({"bucket": rows["_part"], "at": pa.array(np.arange(rows.num_rows, dtype=np.int32)), "word": rows["word"], "n": rows["n"]})

    dealt = totals.select("word", "n", _bucket(F.col("word"), buckets).alias("_part"))
    return materialise(P.by_part(dealt, buckets).applyInArrow(number, "bucket int, at int, word string, n long"), "word-places")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _buckets_for(words: int, entries: int) -> int:
    """Buckets of so many words, of which each two share so many entries that a task can hold theirs."""
    return max(1, math.ceil(words / BUCKET_WORDS), math.ceil(math.sqrt(entries / BLOCK_PAIRS)))


def _ints(values: np.ndarray) -> bytes:
    """Numbers below 2**31 for a shuffle: byte by byte, as high ones are alike."""
    planes = np.ascontiguousarray(values.astype(np.int32).view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _of_ints(sent: bytes) -> np.ndarray:
    n = int.from_bytes(sent[:8], "little")
    planes = np.frombuffer(pa.decompress(sent[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _pair_counter(window: int, buckets: int):
    """Counts the pairs of a part's texts, by block: places in the lower and the higher bucket, and how often."""
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        words, lengths = P.flat_words(rows)
        coded = words.dictionary_encode()
        place = P.places(coded.dictionary, known["word"])
        bucket, at = (known[c].to_numpy()[place].astype(np.int64) for c in ("bucket", "at"))
        order = np.argsort(bucket << 32 | at)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        bucket, at = bucket[order], at[order]   # by rank
        codes, row, keys = rank[coded.indices.to_numpy()], np.repeat(np.arange(len(lengths)), lengths), []
        for d in range(1, window + 1):
            x, y = (v[row[:-d] == row[d:]] for v in (codes[:-d], codes[d:]))
            keys.append(np.minimum(x, y) * len(order) + np.maximum(x, y))
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        low, high = np.divmod(found, max(len(order), 1))
        block = bucket[low] * buckets + bucket[high]
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(order) else np.zeros(0, np.int64)
        out = [{"_part": int(block[k[0]]), "low": _ints(np.diff(at[low[k]], prepend=0)), "high": _ints(at[high[k]]), "n": _ints(n[k])} for k in np.split(order, starts[1:]) if len(k)]
        return pa.Table.from_pylist(out, pa.schema([("_part", pa.int32()), *((c, pa.binary()) for c in ("low", "high", "n"))]))
    return run


def _weigher(buckets: int, whole: float, text: bool):
    """Sums a block's counts and gives the positive weights: as rows of words, or as entries of the matrix by place."""
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows_of_words([], [], np.zeros(0)) if text else _entries_table([])
        i, j = divmod(rows["_part"][0].as_py(), buckets)
        held = {b: k for k, b in enumerate(known["bucket"].to_pylist())}
        totals = [np.frombuffer(known["n"][held[b]].as_py(), np.int64) for b in (i, j)]
        low = np.concatenate([np.cumsum(_of_ints(v.as_py()), dtype=np.int64) for v in rows["low"]])
        high, n = (np.concatenate([_of_ints(v.as_py()) for v in rows[c]]).astype(np.int64) for c in ("high", "n"))
        key = low * len(totals[1]) + high
        order = np.argsort(key, kind="stable")   # merges what each part has sorted
        key, n = key[order], n[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n, (low, high) = np.add.reduceat(n, starts), np.divmod(key[starts], len(totals[1]))
        same = (low == high) if i == j else np.zeros(len(low), bool)
        weight = np.log(np.where(same, 2 * n, n) * whole / (totals[0][low].astype(np.float64) * totals[1][high]))
        on = weight > 0
        low, high, same, weight = low[on], high[on], same[on], weight[on]
        if text:
            names = [known["words"][held[b]].values for b in (i, j)]
            a, b = names[0].take(pa.array(low)), names[1].take(pa.array(high))
            other = pa.array(~same)
            return _rows_of_words([a, b.filter(other)], [b, a.filter(other)], np.r_[weight, weight[~same]])
        if i == j:
            return _entries_table([(i, j, np.r_[low, high[~same]], np.r_[high, low[~same]], np.r_[weight, weight[~same]])])
        return _entries_table([(i, j, low, high, weight), (j, i, high, low, weight)])
    return run


def _rows_of_words(a: list, b: list, weight: np.ndarray) -> pa.Table:
    return pa.table({c: pa.chunked_array(v, pa.string()) for c, v in (("a", a), ("b", b))} | {"weight": pa.array(weight)})


#: Entries of the matrix in bucket ``i`` (rows) and ``j`` (columns), by row: different rows, how many each has, columns, weights.
_ENTRIES = "i int, j int, rows binary, lengths binary, columns binary, w binary"


def _entries_table(blocks: list) -> pa.Table:
    out = []
    for i, j, low, high, weight in blocks:
        order = np.lexsort((high, low))
        for a in range(0, len(order), STORED):
            k = order[a:a + STORED]
            rows, lengths = np.unique(low[k], return_counts=True)
            out.append({"i": i, "j": j, "rows": rows.astype(np.int32).tobytes(), "lengths": lengths.astype(np.int32).tobytes(),
                        "columns": high[k].astype(np.int32).tobytes(), "w": weight[k].astype(np.float64).tobytes()})
    return pa.Table.from_pylist(out, pa.schema([("i", pa.int32()), ("j", pa.int32()), *((c, pa.binary()) for c in ("rows", "lengths", "columns", "w"))]))


def _bucket_lists(words: DataFrame, text: bool) -> DataFrame:
    """One row a bucket: its words' totals and, if asked for, the words, by place."""
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        names = [rows["word"].to_pylist()] if text else [[]]
        return pa.table({"bucket": rows["bucket"][:1], "n": pa.array([rows["n"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "words": pa.array(names, pa.list_(pa.string()))})

    return words.withColumn("_part", F.col("bucket")).groupBy("_part").applyInArrow(run, "bucket int, n binary, words array<string>")


def _weighted_pairs(rows: DataFrame, words_col: str, window: int, text: bool) -> tuple[DataFrame, DataFrame, int]:
    """The positive weights of the pairs (rows of words, or entries of the matrix), the placed words and the number of buckets.

    A word's total is its number of neighbours, which its places tell without the pairs."""
    dealt, parts = P.dealt(rows.select(words_col), F.col(words_col), "pair-rows", part_words=PAIR_WORDS)
    at, n, w = F.col("at"), F.size("_words"), F.lit(window)
    near = F.least(at, w) + F.least(n - 1 - at, w)
    totals = materialise(dealt.select("_words", F.posexplode("_words").alias("at", "word")).select("word", near.cast("long").alias("n"))
                         .groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"), "word-totals")
    found, whole = totals.agg(F.count(F.lit(1)), F.sum("n")).first()
    buckets = _buckets_for(found, whole or 0)
    words = _placed_words(totals, buckets)
    counted = P.look_up(dealt.filter(n > 1), parts, words.select("word", "bucket", "at"), _pair_counter(window, buckets), "_part int, low binary, high binary, n binary")
    lists = materialise(_bucket_lists(words, text), "word-lists")
    bucket, others = F.col("bucket"), F.sequence(F.lit(0), F.lit(buckets - 1))
    blocks = F.array_distinct(F.transform(others, lambda o: F.least(bucket, o) * buckets + F.greatest(bucket, o)))
    sides = lists.withColumn("_part", F.explode(blocks)).withColumn("_part", F.col("_part").cast("int"))
    weighed = P.by_part(counted, buckets * buckets).cogroup(P.by_part(sides, buckets * buckets))
    return weighed.applyInArrow(_weigher(buckets, float(whole or 0), text), "a string, b string, weight double" if text else _ENTRIES), words, buckets


def pair_weights(rows: DataFrame, words_col: str, window: int = WINDOW) -> DataFrame:
    """``ppmi(pair_counts(rows, words_col, window))`` with one shuffle of the pairs, as numbers and packed."""
    return _weighted_pairs(rows, words_col, window, True)[0]


def _as_entries(matrix: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """A matrix (a, b, weight) as entries by place, the placed words and the number of buckets."""
    def entries(rows: pa.Table, known: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _entries_table([])
        i, j = divmod(rows["_part"][0].as_py(), buckets)
        held = {b: k for k, b in enumerate(known["bucket"].to_pylist())}
        low, high = (P.places(P.joined(rows[c], pa.string()), known["words"][held[b]].values) for c, b in (("a", i), ("b", j)))
        return _entries_table([(i, j, low, high, rows["weight"].to_numpy())])

    totals = materialise(matrix.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n")), "word-totals")
    found, whole = totals.agg(F.count(F.lit(1)), F.sum("n")).first()
    buckets = _buckets_for(found, whole or 0)
    words = _placed_words(totals, buckets)
    lists, others = materialise(_bucket_lists(words, True), "word-lists"), F.sequence(F.lit(0), F.lit(buckets - 1))
    blocks = F.array_distinct(F.concat(F.transform(others, lambda o: F.col("bucket") * buckets + o), F.transform(others, lambda o: o * buckets + F.col("bucket"))))
    sides = lists.withColumn("_part", F.explode(blocks)).withColumn("_part", F.col("_part").cast("int"))
    dealt = matrix.withColumn("_part", (_bucket(F.col("a"), buckets) * buckets + _bucket(F.col("b"), buckets)).cast("int"))
    made = P.by_part(dealt, buckets * buckets).cogroup(P.by_part(sides, buckets * buckets)).applyInArrow(entries, _ENTRIES)
    return materialise(made, "word-entries"), words, buckets


def _products(rows: DataFrame, left: str, right: str, size: int) -> np.ndarray:
    """The sum over pieces of the products of two blocks of vectors, the first one turned (size * size numbers)."""
    def sums(batches):
        total = np.zeros((size, size))
        for batch in batches:
            for x, y in zip(*(batch.column(k) for k in (0, 1))):
                total += np.frombuffer(x.as_py()).reshape(-1, size).T @ np.frombuffer(y.as_py()).reshape(-1, size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.reshape(-1))], ["at", "x"])

    parts = rows.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(sums, "at long, x double")
    out = np.zeros(size * size)
    for r in parts.groupBy("at").agg(F.sum("x").alias("x")).collect():   # size * size rows
        out[r["at"]] = r["x"]
    return out.reshape(size, size)


def _turned(block: DataFrame, matrix: np.ndarray) -> DataFrame:
    """A block of vectors (bucket, piece, x) times a size * size matrix."""
    size = len(matrix)

    def turn(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch["x"][k].as_py()).reshape(-1, size) @ matrix
                yield pa.record_batch({"bucket": batch["bucket"].slice(k, 1), "piece": batch["piece"].slice(k, 1), "x": pa.array([x.tobytes()], pa.binary())})

    return block.select("bucket", "piece", "x").mapInArrow(turn, "bucket int, piece int, x binary")


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes a block with this Gram matrix orthonormal; directions without length become zero."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    fine = values > max(values.max(), 0.0) * RANK ** 2
    return vectors * np.where(fine, 1.0 / np.sqrt(np.where(fine, values, 1.0)), 0.0)


def _sliced(size: int, slices: list, kind: type):
    """Pieces of all columns as one row for each slice of the columns."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.frombuffer(batch["x"][k].as_py()).reshape(-1, size)
                for s, (a, e) in enumerate(slices):
                    yield pa.record_batch({"bucket": batch["bucket"].slice(k, 1), "piece": batch["piece"].slice(k, 1), "slice": pa.array([s], pa.int32()),
                                           "x": pa.array([x[:, a:e].astype(kind).tobytes()], pa.binary())})
    return run


def _multiplier(slices: list, kind: type):
    """The entries of a block times a slice of the vectors of its columns, as pieces of its rows."""
    def run(entries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = []
        if entries.num_rows and vectors.num_rows:
            s = vectors["slice"][0].as_py()
            width = slices[s][1] - slices[s][0]
            x = np.zeros(((max(vectors["piece"].to_pylist()) + 1) * PIECE, width), kind)
            for piece, v in zip(vectors["piece"].to_pylist(), vectors["x"]):
                v = np.frombuffer(v.as_py(), kind).reshape(-1, width)
                x[piece * PIECE:piece * PIECE + len(v)] = v
            rows, lengths, columns, w = ([np.frombuffer(v.as_py(), t) for v in entries[c]] for c, t in (("rows", np.int32), ("lengths", np.int32), ("columns", np.int32), ("w", np.float64)))
            y = np.zeros(((max(int(r[-1]) for r in rows) // PIECE + 1) * PIECE, width))
            for k in sorted(range(len(rows)), key=lambda k: (rows[k][0], columns[k][0])):   # the order in which pieces come does not count
                row, weight = np.repeat(rows[k], lengths[k]), w[k].astype(kind)
                for a in range(0, len(row), AT_ONCE):
                    r = row[a:a + AT_ONCE]
                    part = x[columns[k][a:a + AT_ONCE]]
                    part *= weight[a:a + AT_ONCE, None]
                    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
                    y[r[starts]] += np.add.reduceat(part, starts)
            i, j = entries["i"][0].as_py(), entries["j"][0].as_py()
            out = [{"bucket": i, "piece": p, "slice": s, "j": j, "y": y[p * PIECE:(p + 1) * PIECE].astype(kind).tobytes()} for p in range(len(y) // PIECE)]
        return pa.Table.from_pylist(out, pa.schema([*((c, pa.int32()) for c in ("bucket", "piece", "slice", "j")), ("y", pa.binary())]))
    return run


def _summed(size: int, slices: list, kind: type):
    """The products of all blocks of a piece as one, with all columns."""
    def run(rows: pa.Table) -> pa.Table:
        total = np.zeros((PIECE, size))
        order = np.argsort(rows["j"].to_numpy(), kind="stable")   # sums in the order of the blocks
        for k in order.tolist():
            a, e = slices[rows["slice"][k].as_py()]
            total[:, a:e] += np.frombuffer(rows["y"][k].as_py(), kind).reshape(PIECE, e - a)
        return pa.table({"bucket": rows["bucket"][:1], "piece": rows["piece"][:1], "x": pa.array([total.tobytes()], pa.binary())})
    return run


def _times(entries: DataFrame, block: DataFrame, buckets: int, size: int, largest: int, kind: type = np.float64) -> DataFrame:
    """bucket, piece, x: the matrix times the block. A task holds the entries of one block and a slice of the vectors of its columns.

    ``largest`` is the size of the largest bucket, ``kind`` the type of the numbers that are moved and multiplied."""
    width = max(1, min(size, SLICE_BYTES // (np.dtype(kind).itemsize * largest)))
    width = math.ceil(size / math.ceil(size / width))   # slices alike
    slices = [(a, min(a + width, size)) for a in range(0, size, width)]
    n, tasks = len(slices), buckets * buckets * len(slices)
    sent = block.select("bucket", "piece", "x").mapInArrow(_sliced(size, slices, kind), "bucket int, piece int, slice int, x binary") \
        .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))) \
        .withColumn("_part", ((F.col("_i") * buckets + F.col("bucket")) * n + F.col("slice")).cast("int")).drop("_i")
    held = entries.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
        .withColumn("_part", ((F.col("i") * buckets + F.col("j")) * n + F.col("_s")).cast("int")).drop("_s")
    made = P.by_part(held, tasks).cogroup(P.by_part(sent, tasks)).applyInArrow(_multiplier(slices, kind), "bucket int, piece int, slice int, j int, y binary")
    return made.groupBy("bucket", "piece").applyInArrow(_summed(size, slices, kind), "bucket int, piece int, x binary")


def _leading(entries: DataFrame, words: DataFrame, buckets: int, size: int, iterations: int, seed: int) -> DataFrame:
    def present(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                rows = np.frombuffer(batch["rows"][k].as_py(), np.int32)
                yield pa.record_batch({"bucket": pa.array(np.full(len(rows), batch["i"][k].as_py(), np.int32)), "at": pa.array(rows)})

    def packed(rows: pa.Table) -> pa.Table:
        x = np.zeros((PIECE, size))
        x[rows["at"].to_numpy() % PIECE] = P.matrix(rows["v"], size)
        return pa.table({"bucket": rows["bucket"][:1], "piece": rows["piece"][:1], "x": pa.array([x.tobytes()], pa.binary())})

    def named(names: pa.Table, rows: pa.Table) -> pa.Table:
        if not names.num_rows or not rows.num_rows:
            return pa.table({"word": pa.array([], pa.string()), "v": pa.array([], pa.list_(pa.float64()))})
        x = np.frombuffer(rows["x"][0].as_py()).reshape(-1, size)
        return pa.table({"word": names["word"], "v": P.lists(np.ascontiguousarray(x[names["at"].to_numpy() % PIECE]))})

    there = entries.select("i", "rows").mapInArrow(present, "bucket int, at int").distinct()
    words = materialise(words.join(there, ["bucket", "at"]).select("bucket", "at", "word", F.floor(F.col("at") / PIECE).cast("int").alias("piece")), "word-rows")
    largest = (words.agg(F.max("at")).first()[0] or 0) + 1
    start = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.xxhash64(F.col("word"), i, F.lit(seed)).cast("double") / F.lit(2.0 ** 63))
    block = materialise(words.withColumn("v", start).groupBy("bucket", "piece").applyInArrow(packed, "bucket int, piece int, x binary"), "word-block")
    for k in range(iterations):
        block = _turned(block, _orthonormal(_products(block, "x", "x", size)))
        # all but the last iteration only turn the block: what float32 rounds there, the next one turns back
        block = materialise(_times(entries, block, buckets, size, largest, np.float32 if k + 1 < iterations else np.float64), "word-block")
    basis = materialise(_turned(block, _orthonormal(_products(block, "x", "x", size))), "word-basis")
    image = _times(entries, basis, buckets, size, largest).withColumnRenamed("x", "m")
    core = _products(basis.join(image, ["bucket", "piece"]), "x", "m", size)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)] < 0, -1.0, 1.0)
    found = _turned(basis, vectors * np.sqrt(np.where(values > RANK * values.max(initial=0.0), np.maximum(values, 0.0), 0.0)))
    return words.groupBy("bucket", "piece").cogroup(found.groupBy("bucket", "piece")).applyInArrow(named, "word string, v array<double>")


def leading_vectors(matrix: DataFrame, size: int = SIZE, iterations: int = ITERATIONS, seed: int = 42) -> DataFrame:
    """word, v: rows of the leading eigenvectors (by eigenvalue, largest first) times the roots of their eigenvalues.

    ``matrix`` (a, b, weight) is symmetric with positive weights, as a written
    table. The start is a hash of word, place and seed, so a rerun starts alike.
    Directions whose eigenvalue is negative or rounding error are zero."""
    return _leading(*_as_entries(matrix), size, iterations, seed)


@dataclass
class WordVectors:
    """A written table of word vectors: word, vector (``VectorUDT``); ``single`` says that float32 holds every number exactly."""
    table: DataFrame
    size: int
    single: bool = False

    def getVectors(self) -> DataFrame:
        return self.table

    def getVectorSize(self) -> int:
        return self.size

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "WordVectors":
        table = spark.read.parquet(path)
        first = table.select(F.size(vector_to_array("vector"))).first()
        return cls(table, int(first[0]) if first else SIZE)


def fit_word_vectors(train: DataFrame, clean_col: str = "clean_text", size: int = SIZE, window: int = WINDOW,
                     min_count: int = MIN_COUNT, iterations: int = ITERATIONS, seed: int = 42) -> WordVectors:
    """F6 at any vocabulary size: the vectors of the words of the training rows."""
    rows = materialise(train.select(T.split_clean_text(F.col(clean_col)).alias("_words")), "word-rows")
    if min_count <= 1:
        entries, words, buckets = _weighted_pairs(rows, "_words", window, False)
        vectors = _leading(materialise(entries, "word-entries"), words, buckets, size, iterations, seed)
    else:
        pairs = materialise(frequent_pairs(pair_counts(rows, "_words", window), rows, "_words", min_count), "word-pairs")
        vectors = leading_vectors(materialise(ppmi(pairs), "word-ppmi"), size, iterations, seed)
    return WordVectors(materialise(vectors.select("word", array_to_vector("v").alias("vector")), "word-vectors"), size)


def nearest(vectors: WordVectors, words: list[str], k: int = 10) -> DataFrame:
    """word, rank, neighbour, cosine: the ``k`` nearest words of each of a few given ones (they are broadcast)."""
    unit = vectors.table.select("word", vector_to_array("vector").alias("v")) \
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).filter("norm > 0")
    asked = unit.filter(F.col("word").isin(words)).select("word", "v", "norm")
    one = F.broadcast(asked.agg(F.collect_list(F.struct("word", "v", "norm")).alias("asked")))   # the given words
    pairs = unit.select(F.col("word").alias("neighbour"), F.col("v").alias("u"), F.col("norm").alias("u_norm")).join(one) \
        .withColumn("q", F.explode("asked")).filter("q.word <> neighbour")
    dot = F.aggregate(F.zip_with("u", "q.v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.select(F.col("q.word").alias("word"), "neighbour", (dot / (F.col("u_norm") * F.col("q.norm"))).alias("cosine"))
    order = Window.partitionBy("word").orderBy(F.col("cosine").desc(), "neighbour")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("word", "rank", "neighbour", "cosine")
