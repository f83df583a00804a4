"""Operator 4: quality classifier by an interpolated modified Kneser-Ney model.

The model counts character five-grams of trusted text (documents labelled as
good). Map tasks sum the counts of their own texts; the sums are joined and
aggregated by gram, so every step of the estimate (continuation counts,
context totals, discounts, interpolation from one character up to five) is a
shuffle join or aggregation on the grams themselves, sharded over all tasks.
That gives the log probability of every gram that occurs anywhere in the
corpus. Scoring reads each whole text again and adds them up, in units of 1/``UNITS``
bit, so that sums do not depend on their order; the gram table, under a 64-bit hash
of each gram's code points, is broadcast in shards of at most ``SHARD`` grams
(a fixed bound: a larger model has more shards, one after another, whose sums
are added per text).

A document is rejected when its bits per character lie above its language's
limit. A fifth of the trusted documents is kept out of the counts; limits are
quantiles of their scores: q50 + ``SLACK`` * (q95 - q50). Languages with fewer
than ``MIN_CALIBRATION`` such documents take the limit of all languages. Any
text may exceed its limit by ``ALLOWANCE`` bits in all, as the average of a few
characters says little.

Characters are folded to lower case, white space to a blank; every other code
point stands for itself, in every script. The lowest level spreads its mass
over the corpus' alphabet, at least ``ALPHABET`` characters.

Defined cases: texts that are null or empty have no score and are rejected; a
null language is a language of its own; without any trusted text nothing but
those is rejected; an empty table gives an empty result; repeated rows score
alike; extra columns pass through ``keep_good`` unchanged; texts of any
length are read whole, in parts.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import bounded, keep_rows, row_key, small_batches
from missive.session import materialise

ORDER = 5
#: Characters that the lowest level reckons with at least.
ALPHABET = 1 << 12
SHARD = 1 << 22
SLACK = 4.0
ALLOWANCE = 64.0
MIN_CALIBRATION = 30
#: Bits per character are compared in steps of 1/STEPS.
STEPS = 50
#: Bits are added up as whole numbers of 1/UNITS.
UNITS = 1 << 16
#: Distinct grams a map task holds before it sums them up again.
HELD = 1 << 20
#: Characters of texts that are turned into grams at a time.
PART = 1 << 21

def _codes(text: str, lead: bool) -> np.ndarray:
    """Code points of a folded text; ``lead``: it starts here, and gets a lead of zeros (else its first characters are one)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where((codes >= 9) & (codes <= 13), np.uint32(32), np.maximum(codes, np.uint32(1)))
    return np.concatenate([np.zeros(ORDER - 1, np.uint32), codes]) if lead else codes


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of grams given as ``ORDER`` arrays of code points; never 0."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out ^= c
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.maximum(out, np.uint64(1))


def _keys(codes: np.ndarray) -> np.ndarray:
    """Hashes of the five-grams of a text, one for each character after the lead."""
    n = len(codes) - ORDER + 1
    return _hash([codes[k:n + k] for k in range(ORDER)])


def _parts(text: str):
    """Code points of a whole text, in parts that overlap by the lead."""
    text = text.lower()
    for at in range(0, len(text), PART):
        yield _codes(text[max(0, at - ORDER + 1):at + PART], at == 0)


def _distinct(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, code points and count of the different five-grams of some texts."""
    parts = [p for t in texts if t for p in _parts(t)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    key, first, n = np.unique(np.concatenate([_keys(p) for p in parts]), return_index=True, return_counts=True)
    starts = np.cumsum([0] + [len(p) - ORDER + 1 for p in parts])
    owner = np.searchsorted(starts, first, "right") - 1   # grams do not run over from one part into the next
    at = first + owner * (ORDER - 1)
    codes = np.concatenate(parts)
    return key, np.stack([codes[at + k] for k in range(ORDER)], axis=1), n


def _sum_up(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, grams, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], grams[order[first]], np.add.reduceat(n, first)


def _rows(held: list[tuple]) -> pd.DataFrame:
    _, grams, n = _sum_up(held)
    text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pd.DataFrame({"gram": [text[i:i + ORDER] for i in range(0, len(text), ORDER)], "n": n})


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, n): five-grams of all texts with their count in trusted texts; ``rows`` has text and trusted."""
    small_batches(rows.sparkSession)

    def run(frames):
        held, size = [], 0
        for f in frames:
            for trusted in (True, False):
                key, grams, n = _distinct(f["text"][(f["trusted"] == trusted) & f["text"].notna()])
                if len(key):
                    held.append((key, grams, n if trusted else np.zeros_like(n)))
                    size += len(key)
            if size > 2 * HELD:
                held = [_sum_up(held)]
                size = len(held[0][0])
                if size > HELD:
                    yield _rows(held)
                    held, size = [], 0
        if held:
            yield _rows(held)

    parts = rows.select("text", "trusted").mapInPandas(run, "gram string, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    n = {r["n"]: r["count"] for r in counts.filter("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9  # too few counts to estimate from
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(d, 0.05), i + 0.95)) for i, d in
                 enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(gram, units): minus the base-2 log probability of a gram's last character after the others, for every gram, in 1/UNITS."""
    counts = {ORDER: grams.filter("n > 0").select("gram", "n")}
    wanted = {ORDER: grams.select("gram")}
    suffix = F.expr("substring(gram, 2)")
    for n in range(ORDER - 1, 0, -1):  # a shorter gram counts the different characters that it follows
        counts[n] = materialise(counts[n + 1].select(suffix.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "llm-kn-count")
        wanted[n] = wanted[n + 1].select(suffix.alias("gram")).distinct()
    wanted[1] = materialise(wanted[1], "llm-kn-alphabet")
    alphabet = max(ALPHABET, wanted[1].count())
    lower = None
    for n in range(1, ORDER + 1):
        d1, d2, d3 = _discounts(counts[n])
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        context = F.substring("gram", 1, n - 1)
        ones, twos = F.count(F.when(F.col("n") == 1, 1)), F.count(F.when(F.col("n") == 2, 1))
        totals = counts[n].groupBy(context.alias("context")).agg(
            F.sum("n").alias("total"), (ones * d1 + twos * d2 + (F.count("n") - ones - twos) * d3).alias("freed"))
        p = (wanted[n].join(counts[n], "gram", "left").withColumn("context", context).join(totals, "context", "left"))
        if lower is None:
            p = p.withColumn("p_lower", F.lit(1.0 / alphabet))
        else:
            short = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
            p = p.withColumn("suffix", suffix).join(short, "suffix")
        own = F.coalesce(F.col("n") - cut, F.lit(0.0)) / F.col("total")
        p = p.select("gram", F.when(F.col("total").isNull(), F.col("p_lower"))
                     .otherwise(own + F.col("freed") / F.col("total") * F.col("p_lower")).alias("p"))
        lower = materialise(p, "llm-kn-p")
    return lower.select("gram", F.round(-F.log2("p") * UNITS).cast("int").alias("units"))


def _hashed(bits: DataFrame) -> DataFrame:
    """(key, units): grams by the hash under which texts look them up."""
    def run(frames):
        for f in frames:
            codes = np.frombuffer("".join(f["gram"]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
            yield pd.DataFrame({"key": _hash([codes[:, k] for k in range(ORDER)]).astype(np.int64), "units": f["units"].to_numpy()})

    return bits.mapInPandas(run, "key long, units int")


class _Table:
    """Open-addressing hash table from gram hash to units of bits."""

    def __init__(self, keys: np.ndarray, units: np.ndarray):
        power = max(4, int(2 * len(keys)).bit_length())
        size = 1 << power
        self._shift = np.uint64(64 - power)
        self._mask, self._keys, self._units = size - 1, np.zeros(size, np.uint64), np.zeros(size, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self._keys[s] == 0
            self._keys[s[free]] = keys[left[free]]  # of several keys for one slot the last stays
            self._units[s[free]] = units[left[free]]
            left = left[self._keys[s] != keys[left]]
            slot[left] = (slot[left] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units of each key, and 1 or 0 for whether the table holds it."""
        slot = self._slot(keys)
        held = self._keys[slot]
        hit = held == keys
        units, left = np.where(hit, self._units[slot], 0), np.flatnonzero(~hit & (held != 0))
        while len(left):
            at = (slot[left] + 1) & self._mask
            slot[left], held = at, self._keys[at]
            same = held == keys[left]
            hit[left[same]], units[left[same]] = True, self._units[at[same]]
            left = left[~same & (held != 0)]
        return units, hit

    def sums(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Units and number of the grams of each text that the table holds."""
        total, found = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        parts, owner, size = [], [], 0

        def add():
            units, hit = self.get(np.concatenate(parts))
            ends = np.cumsum([len(p) for p in parts])
            units = np.concatenate([[0], np.cumsum(units, dtype=np.int64)])
            hit = np.concatenate([[0], np.cumsum(hit)])
            starts = ends - [len(p) for p in parts]
            np.add.at(total, owner, units[ends] - units[starts])
            np.add.at(found, owner, hit[ends] - hit[starts])

        for i, text in enumerate(texts):
            for codes in _parts(text or ""):
                keys = _keys(codes)
                parts.append(keys)
                owner.append(i)
                size += len(keys)
                if size > PART:
                    add()
                    parts, owner, size = [], [], 0
        if parts:
            add()
        return total, found


@functools.lru_cache(1)
def _table(shared) -> _Table:
    return _Table(*shared.value)


def score_texts(rows: DataFrame, bits: DataFrame, shard: int = SHARD) -> DataFrame:
    """``rows`` without ``text``, with total_bits and n_grams: a written table.

    ``__key`` is a key of the text and whatever else tells rows apart. With
    several shards only one is on the driver and the executors at a time, and
    sums are added by ``__key``: repeated rows have equal sums in each shard.
    """
    spark = rows.sparkSession
    small_batches(spark)
    bits = materialise(_hashed(bits), "llm-kn-bits")
    shards = max(1, -(-bits.count() // shard))
    others = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def score(s: int, kept: list[str]) -> DataFrame:
        part = bits.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == s).toArrow()  # columns, not a row object for each gram
        shared = spark.sparkContext.broadcast((part["key"].to_numpy().astype(np.uint64), part["units"].to_numpy()))

        def run(frames):
            table = _table(shared)
            for f in frames:
                total, found = table.sums(f["text"])
                yield f[kept].assign(total=total, n_grams=found)

        del part
        schema = ", ".join(f"{c} {kinds[c]}" for c in kept)
        out = rows.select(*kept, "text").mapInPandas(run, f"{schema}, total long, n_grams long")
        if shards > 1:
            out = out.groupBy(*kept).agg(F.max("total").alias("total"), F.max("n_grams").alias("n_grams"))
        out = materialise(out, "llm-kn-scored")
        shared.destroy()
        return out

    if shards == 1:
        scored = score(0, others)
    else:
        sums = None
        for s in range(shards):
            part = score(s, ["__key"])
            sums = part if sums is None else sums.unionByName(part)
        sums = sums.groupBy("__key").agg(F.sum("total").alias("total"), F.sum("n_grams").alias("n_grams"))
        scored = materialise(rows.select(*others).join(sums, "__key"), "llm-kn-scored")
    return scored.select(*others, (F.col("total") / UNITS).alias("total_bits"), "n_grams")


def _limits(scored: DataFrame) -> DataFrame:
    """(lang, limit) from the trusted documents that were kept out of the counts; lang '*' tells all languages."""
    step = F.floor(F.col("total_bits") / F.col("n_grams") * STEPS)
    held = scored.filter(F.col("calibrates") & (F.col("n_grams") > 0)).withColumn("step", step)
    one = held.select(F.struct(F.lit(False).alias("all"), F.col("lang").alias("lang")).alias("g"), "step")
    every = held.select(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")).alias("g"), "step")
    steps = one.unionByName(every).groupBy("g", "step").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("g").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = (steps.withColumn("upto", F.sum("n").over(up)).withColumn("of", F.sum("n").over(Window.partitionBy("g"))))
    at = lambda q: (F.min(F.when(F.col("upto") >= F.col("of") * F.lit(q), F.col("step"))) + 1) / STEPS
    limits = steps.groupBy("g").agg(at(0.5).alias("middle"), at(0.95).alias("high"), F.max("of").alias("of"))
    return limits.select(F.col("g.all").alias("all"), F.col("g.lang").alias("lang"), "of",
                         (F.col("middle") + SLACK * (F.greatest(F.col("high") - F.col("middle"), F.lit(0.05)))).alias("limit"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             shard: int = SHARD) -> DataFrame:
    """One row per input row: doc_id, lang, bits (per character), limit, kept, and ``__key`` of (doc_id, lang, text).

    ``labels`` has doc_id and quality (1: trusted).
    """
    good = bounded(labels.filter("quality = 1").select(F.col("doc_id").alias("__good")).distinct(), "llm-kn-trusted")
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    rows = rows.join(good, F.col("doc_id") == F.col("__good"), "left")
    label = F.col("__good").isNotNull()
    aside = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0
    rows = rows.select("doc_id", "lang", "text", (label & ~aside).alias("trusted"), (label & aside).alias("calibrates"))
    grams = materialise(gram_counts(rows), "llm-kn-grams")
    bits = log_probabilities(grams)
    keyed = rows.select("doc_id", "lang", "calibrates", row_key("doc_id", "lang", "text").alias("__key"), "text")
    scored = score_texts(keyed, bits, shard)
    limits = bounded(_limits(scored), "llm-kn-limits")
    own = limits.filter(~F.col("all") & (F.col("of") >= MIN_CALIBRATION)).select(F.col("lang").alias("__l"), F.col("limit").alias("__own"))
    general = next((r["limit"] for r in limits.filter("all").collect()), None)  # one row
    judged = (scored.join(own, F.col("lang").eqNullSafe(F.col("__l")), "left")
              .withColumn("bits", F.when(F.col("n_grams") > 0, F.col("total_bits") / F.col("n_grams")))
              .withColumn("limit", F.coalesce(F.col("__own"), F.lit(general).cast("double"))))
    within = F.col("total_bits") <= F.col("limit") * F.col("n_grams") + ALLOWANCE
    kept = F.col("bits").isNotNull() & (F.col("limit").isNull() | within)
    return judged.select("doc_id", "lang", "bits", "limit", kept.alias("kept"), "__key")


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that the classifier keeps, columns unchanged."""
    kept = materialise(classify(docs, labels, doc_id, text, lang).filter("kept").select("__key"), "llm-kn-kept")
    return keep_rows(docs, kept, doc_id, lang, text)
