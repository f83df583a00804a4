"""Skip-gram word vectors with negative sampling as Spark jobs (F6): no vocabulary and no vector on the driver.

The training texts are dealt to parts of at most ``TRAIN_WORDS`` words. Each round a
task trains on its part for some of the epochs, with the vectors of the part's
own words; the vectors of a word are then averaged over the parts that hold it,
weighted by its occurrences there, and go back to those parts. Rows are words
of a part, so the memory of a task does not follow the vocabulary, and the
driver sees counts only. What is shuffled is the different words of all parts,
of which large parts have fewer; the last round sends input vectors only.

A word's first vector is a hash of the word and the seed, its output vector
zero. Within a task, a step takes ``STEP`` places of the text at once:
windows shrink at random as in word2vec, and ``NEGATIVES`` words for each pair
are drawn from the part's counts to the power 0.75 and shared by the step.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.operators import parts as P
from missive.operators.wordvec import WordVectors
from missive.session import materialise

NEGATIVES = 5
#: Places of the text, and shared negative words, of one step.
STEP, SHARED = 128, 128
RATE, LAST_RATE = 0.025, 0.0001
#: Pairs of one step that move a word with their full weight; of more, the mean counts this often.
FULL_PAIRS = 16
#: Rounds of training between which vectors are averaged (one part needs one).
ROUNDS = 2
#: Words of a sentence: longer texts are cut, so that parts stay even.
SENTENCE = 1000
#: Words of a part: parts of ``P.PART_WORDS`` up to ``FEW_PARTS`` of them, which keep cores busy, then larger ones up to this.
TRAIN_WORDS, FEW_PARTS = 1_000_000, 24
#: Averaging tasks for each part: one holds about as many vectors as a third of a part.
MIXERS = 3


def first_vectors(words: list[str], size: int, seed: int) -> np.ndarray:
    """Uniform numbers in (-0.5, 0.5) / size from a hash of the word: alike in every task and rerun."""
    x = np.array([int.from_bytes(hashlib.blake2b(f"{seed}:{w}".encode(), digest_size=8).digest(), "little") for w in words], np.uint64).reshape(-1, 1)
    x = x + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float32) / np.float32(2 ** 24) - np.float32(0.5)) / np.float32(size)


def _move(vectors: np.ndarray, at: np.ndarray, change: np.ndarray, weight: np.ndarray, rate: float) -> None:
    """Add the changes of equal words as one; a word of many pairs moves by their mean, and no word by more than 1."""
    order = np.argsort(at, kind="stable")
    sorted_at = at[order]
    starts = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]])
    moved = np.add.reduceat(change[order], starts)
    moved *= (rate * np.minimum(1.0, FULL_PAIRS / np.maximum(np.add.reduceat(weight[order], starts), 1e-9))).astype(np.float32)[:, None]
    far = np.sqrt(np.einsum("ij,ij->i", moved, moved))
    vectors[sorted_at[starts]] += moved * np.minimum(1.0, 1.0 / np.maximum(far, 1e-9)).astype(np.float32)[:, None]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def train(codes: np.ndarray, text_of: np.ndarray, v: np.ndarray, u: np.ndarray, epochs: range, of: int, window: int, rng) -> None:
    """Move input vectors ``v`` and output vectors ``u`` over the texts for the epochs given, of ``of`` in all."""
    n = len(codes)
    odds = np.cumsum(np.bincount(codes, minlength=len(v)) ** 0.75)
    place = np.arange(STEP + window)
    apart = np.abs(place[:, None] - place)
    apart[(apart == 0) | (np.minimum(place[:, None], place) >= STEP)] = window + 1   # a pair belongs to the step of its first place
    for epoch in epochs:
        reach = rng.integers(1, window + 1, n)
        for a in range(0, n, STEP):
            e = min(a + STEP + window, n)
            m, here, text = e - a, codes[a:e], text_of[a:e]
            on = ((apart[:m, :m] <= reach[a:e, None]) & (text[:, None] == text)).astype(np.float32)   # word i predicts word j
            centre = on.sum(axis=1)
            drawn = np.searchsorted(odds, rng.random(SHARED) * odds[-1], side="right")
            share = centre * np.float32(NEGATIVES / SHARED)
            x, y = v[here], u[np.concatenate([here, drawn])]
            g = _sigmoid(x @ y.T)
            g[:, :m] = on * (1 - g[:, :m])
            g[:, m:] *= -share[:, None]
            rate = max(LAST_RATE, RATE * (1.0 - (epoch + a / n) / of))
            _move(v, here, g @ y, centre * (1 + NEGATIVES), rate)
            _move(u, np.concatenate([here, drawn]), g.T @ x, np.concatenate([on.sum(axis=0), np.full(SHARED, share.sum(), np.float32)]), rate)


def parts_of(words: int) -> int:
    """How many parts train on so many words."""
    small, large = math.ceil(words / P.PART_WORDS), math.ceil(words / max(TRAIN_WORDS, P.PART_WORDS))
    return max(1, min(small, max(FEW_PARTS, large)))


def _placed(known: pa.Table, column: str, at: np.ndarray, size: int) -> np.ndarray:
    """A column of vectors in the order of a part's words (``at`` has the place of each entry), filled batch by batch."""
    out, a = np.zeros((len(at), size), np.float32), 0
    for chunk in known[column].chunks:
        out[at[a:a + len(chunk)]] = chunk.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        a += len(chunk)
    return out


def _trainer(size: int, window: int, epochs: range, of: int, seed: int, begun: bool):
    """Trains on a part's texts: from the words' first vectors, or from ``known`` ones of an earlier round."""
    last = epochs.stop >= of

    def run(rows: pa.Table, known: pa.Table | None) -> pa.Table:
        rows = rows.sort_by("_at")
        words, lengths = P.flat_words(rows)
        coded = words.dictionary_encode()
        codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if known is None:
            v, u = first_vectors(names.to_pylist(), size, seed), np.zeros((len(names), size), np.float32)
        else:
            at = P.places(P.joined(known["word"], names.type), names)   # each word of the part is there once
            v, u = (_placed(known, c, at, size) for c in ("v", "u"))
        part = rows["_part"][0].as_py()
        train(codes, np.repeat(np.arange(len(lengths)), lengths), v, u, epochs, of, window, np.random.default_rng((seed, part, epochs.start)))
        out = {"_part": pa.array(np.full(len(names), part, np.int32)), "word": names,
               "n": pa.array(np.bincount(codes, minlength=len(names)).astype(np.int64)), "v": P.lists(v)}
        return pa.table(out if last else out | {"u": P.lists(u)})

    def first(rows: pa.Table) -> pa.Table:
        return run(rows, None)

    def later(rows: pa.Table, known: pa.Table) -> pa.Table:
        return run(rows, known)

    return later if begun else first


def _mixer(size: int, last: bool):
    """The mean vectors of each word over its parts, weighted by occurrences: one row a word, or one for each part."""
    def run(rows: pa.Table) -> pa.Table:
        coded = pa.concat_arrays(rows["word"].chunks).dictionary_encode()
        codes, n = coded.indices.to_numpy(zero_copy_only=False), rows["n"].to_numpy().astype(np.float64)
        parts = rows["_part_of"].to_numpy()
        order = np.lexsort((parts, codes))   # sums in the order of the parts
        starts = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1]])
        whole = np.add.reduceat(n[order], starts)[:, None]
        mean = {c: np.add.reduceat(P.matrix(rows[c], size)[order] * n[order, None], starts) / whole for c in (("v",) if last else ("v", "u"))}
        if last:
            return pa.table({"word": coded.dictionary, "vector": P.lists(mean["v"].astype(np.float32).astype(np.float64))})
        return pa.table({"_part": pa.array(parts), "word": coded.cast(pa.string()), **{c: P.lists(m.astype(np.float32)[codes]) for c, m in mean.items()}})
    return run


def fit(train_rows: DataFrame, words: Column, size: int, window: int, min_count: int, epochs: int, seed: int,
        parts: int | None = None) -> WordVectors:
    """The vectors of all words of the training rows that occur ``min_count`` times or more, as a table."""
    from pyspark.ml.functions import array_to_vector
    texts = train_rows.select(words.alias("_all"))
    last = F.floor((F.size("_all") - 1) / F.lit(SENTENCE)).cast("int")
    texts = texts.filter(F.size("_all") > 0).select(F.explode(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.slice("_all", i * SENTENCE + 1, SENTENCE))).alias("_words"))
    rows, load = P.written(texts, F.col("_words"), "skipgram-texts")
    parts = parts or parts_of(load())
    rows = P.in_parts(rows, parts)
    if min_count > 1:
        often = rows.select(F.explode("_words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_count)
        kept = P.look_up(rows, parts, often.select("word"), _kept, rows.schema)
        rows = materialise(kept.filter(F.size("_words") > 0), "skipgram-frequent")
    rounds = 1 if parts == 1 else min(ROUNDS, max(epochs, 1))
    known = None
    for k in range(rounds):
        groups = P.by_part(rows, parts) if known is None else P.by_part(rows, parts).cogroup(P.by_part(known, parts))
        step = _trainer(size, window, range(epochs * k // rounds, epochs * (k + 1) // rounds), epochs, seed, known is not None)
        last = k + 1 == rounds
        trained = groups.applyInArrow(step, "_part int, word string, n long, v array<float>" + ("" if last else ", u array<float>"))
        # vectors of a round exist once, as the files of its shuffle: they are not written besides
        by_word = P.by_part(trained.withColumn("_part_of", F.col("_part")).withColumn("_part", F.pmod(F.xxhash64("word"), F.lit(parts * MIXERS)).cast("int")), parts * MIXERS)
        known = by_word.applyInArrow(_mixer(size, last), "word string, vector array<double>" if last else "_part int, word string, v array<float>, u array<float>")
    return WordVectors(materialise(known.select("word", array_to_vector("vector").alias("vector")), "skipgram-vectors"), size, single=True)


def _kept(rows: pa.Table, often: pa.Table) -> pa.Table:
    """The rows with their frequent words only."""
    words, lengths = P.flat_words(rows)
    on = P.places(words, often["word"]) >= 0
    left = np.r_[0, np.cumsum(on)][np.r_[0, np.cumsum(lengths)]]
    kept = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(on)))
    return rows.set_column(rows.schema.get_field_index("_words"), "_words", kept)
