"""Operator 3: language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (drawn from a generator seeded by
its code point). A three-letter gram is the product of its letters' vectors,
rotated by their distance from the gram's end; a text is the sum of its grams.
A language's prototype is the sum over labelled texts, counted in integers, so
that reruns agree; the mean of the prototypes, which all languages share, is
taken off, and a text goes to the prototype of the largest cosine.

Prototypes are fitted on at most about ``PER_LANGUAGE`` labelled texts of each
language, chosen by a hash of the row (a bounded sample; the bound is this
parameter). The prototypes, one vector a language, are the only thing that
passes through the driver: ``MAX_LANGUAGES`` bounds it.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
so is every text if nothing could be learned; rows without a label are never
learned from; a null doc_id is not held out; an empty table gives an empty
result; whole texts are read, long ones in slices; equal cosines go to the
language that sorts first.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded, small_batches

DIMENSIONS = 512
PER_LANGUAGE = 4000
MAX_LANGUAGES = 10_000
#: Distinct grams that are turned into vectors at a time.
SLICE = 4096
#: Characters of a text that are cut into grams at a time.
PART = 1 << 20
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(8192)
def _vector(code: int, turn: int, dimensions: int) -> np.ndarray:
    own = np.random.default_rng([7, code]).integers(0, 2, dimensions, np.int8) * 2 - 1
    return np.roll(own.astype(np.int8), turn)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct three-letter grams of a part (packed code points; 0 for any run of other characters), with counts."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    codes = np.concatenate([np.zeros(1, np.uint64), codes, np.zeros(1, np.uint64)])
    codes = codes[(codes != 0) | np.concatenate([[True], codes[:-1] != 0])]
    if len(codes) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = np.uint64(21)
    return np.unique((codes[:-2] << (s + s)) | (codes[1:-1] << s) | codes[2:], return_counts=True)


def text_vector(text: str, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """The text's vector of integers (as floats), or None if it has no letter."""
    total, found = np.zeros(dimensions, np.float64), False
    for at in range(0, len(text), PART):
        grams, counts = _grams(text[max(0, at - 2):at + PART])
        for k in range(0, len(grams), SLICE):
            found = True
            part = grams[k:k + SLICE]
            product = None
            for turn, shift in ((2, 42), (1, 21), (0, 0)):
                codes, where = np.unique((part >> np.uint64(shift)) & np.uint64(0x1FFFFF), return_inverse=True)
                table = np.stack([_vector(int(c), turn, dimensions) for c in codes])
                product = table[where] if product is None else np.multiply(product, table[where], out=product)
            total += counts[k:k + SLICE].astype(np.float32) @ product.astype(np.float32)
    return total if found else None


def _learnable(docs: DataFrame, per_language: int, may_learn: Column) -> DataFrame:
    rows = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__n"))
    share = F.lit(float(per_language)) / F.col("__n")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(bounded(counts.withColumn("__share", share), "llm-lang-counts"), "lang").filter(chance < F.col("__share")).select("lang", "text")


def fit_prototypes(rows: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language -> summed vector, from rows (lang, text); summed in map tasks, then by (language, dimension)."""
    small_batches(rows.sparkSession)

    def run(frames):
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, text in zip(f["lang"], f["text"]):
                v = text_vector(text, dimensions)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pd.DataFrame({"lang": list(sums), "v": [x.astype(np.int64) for x in sums.values()]})

    parts = rows.mapInPandas(run, "lang string, v array<long>")
    summed = (parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
              .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
              .select("lang", F.col("v.x").alias("v")))
    found = summed.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array(r["v"], np.float64) for r in found}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                       dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (cosine, 0 to 1).

    Learns from rows that are not held out; a prediction reads nothing but the text.
    """
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    sums = fit_prototypes(_learnable(rows, per_language, ~held_out(F.col("doc_id"))), dimensions)
    names = sorted(sums)
    units = np.stack([sums[n] / max(1.0, np.linalg.norm(sums[n])) for n in names]) if names else np.zeros((0, dimensions))
    centre = units.mean(axis=0) if len(names) > 1 else np.zeros(dimensions)
    units = units - centre
    units = (units / np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((names, units, centre))

    def run(frames):
        names, units, centre = shared.value
        for f in frames:
            pred, score = [], []
            for t in f["text"]:
                v = text_vector(t, dimensions) if t and names else None
                if v is None:
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                v = v / max(np.linalg.norm(v), 1e-12) - centre
                cos = units @ (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)
                best = int(np.argmax(cos))
                pred.append(names[best])
                score.append(float(min(1.0, max(0.0, cos[best]))))
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "lang_pred": pred, "score": score})

    out = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    return out.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
