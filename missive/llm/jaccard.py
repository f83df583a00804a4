"""Operator 9: n-gram Jaccard join with rare-first prefix filtering.

A document's set is its distinct five-word shingles (64-bit hashes). Two
documents link if 100 * |intersection| >= 80 * |union|. Steps:

1. One pass over the texts gives each document's set size and set key (a hash
   of the whole set), and counts all shingles in a sketch of ``CELLS`` cells.
   Documents of one set key are copies: they count as one from here on.
2. Shingles are ordered rare first, by their cell's count, then by hash: any
   order all documents share is right, a better one leaves fewer candidates.
   Only the prefix of n - ceil(0.8 n) + 1 rarest shingles can hold the first
   shingle that two linked sets share, so only prefixes are shuffled. What
   occurs in one document alone is dropped on arrival.
3. First every set is paired with the sets that are nearest the middle of its
   shingles' groups (the member with the fewest rarer shingles), at most one
   verified pair per set. That joins big groups of near copies without pairing
   all their members. Then pairs are made only of sets that share a prefix
   shingle and are not in one component yet: no link between different
   components can be missed, and links inside one do not change the result.
4. Length and positional filters apply where pairs are made; the suffix filter
   bounds the intersection by two small histograms of all shingles; every
   pair left is verified once, on the whole sets.
5. Components by label propagation with pointer jumping.

The sketch (4 MB) is the only broadcast besides bitmaps of at most 64 MB that
tell which texts to read again. Sets are compared by 64-bit hashes.

Defined cases: a null text, or one without words, has an empty set, links with
nothing and is its own component; fewer than five words are one shingle; rows
that repeat a text are copies; a null doc_id ranks after all others; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bitmaps_of, in_bitmaps, join_groups, keep_rows, row_key, small_batches
from missive.session import materialise

WORDS = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
CELLS = 1 << 20
_CHUNKS = 16
_PARTIALS = 256
#: Cells of a set's histogram for the suffix filter.
BINS = 64
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PRIME = np.uint64(0x9E3779B185EBCA87)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [[] if t is None else t.encode("utf-8", "surrogatepass").translate(_FOLD).split() for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((xxhash.xxh64_intdigest(x) for w in words for x in w), np.uint64, sum(sizes))
    out, at = [], 0
    for size in sizes:
        own, at = flat[at:at + size], at + size
        if not size:
            out.append(np.empty(0, np.uint64))
            continue
        width = min(size, WORDS)
        h = np.full(size - width + 1, width, np.uint64)
        for k in range(width):
            h = h * _PRIME + own[k:size - width + 1 + k]
        out.append(np.unique(_mix(h)))
    return out


def _set_key(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 11) - (1 << 63)


def _histogram(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BINS), 65535).astype("<u2").tobytes()


def _describe(rows: DataFrame) -> DataFrame:
    """Per document (doc_id, own, n, key, hist), and partial sketches as (chunk, part, counts)."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(frames):
        cells = np.zeros(CELLS, np.int64)
        for f in frames:
            sets = shingle_sets(f["text"])
            for s in sets:
                np.add.at(cells, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
            yield pd.DataFrame({"doc_id": f["doc_id"], "own": f["own"], "n": [len(s) for s in sets], "key": [_set_key(s) for s in sets],
                                "hist": [_histogram(s) for s in sets], "chunk": -1, "part": 0, "counts": None})
        if cells.any():
            part = TaskContext.get().partitionId() // _PARTIALS
            yield pd.DataFrame({"doc_id": None, "own": None, "n": None, "key": None, "hist": None, "chunk": range(_CHUNKS), "part": part,
                                "counts": [zlib.compress(c.tobytes(), 1) for c in np.split(cells, _CHUNKS)]})

    return rows.mapInPandas(run, f"doc_id {kind}, own long, n long, key long, hist binary, chunk int, part int, counts binary")


def _sketch(described: DataFrame) -> np.ndarray:
    """Sum of all partial sketches; partial sums first, so that no task holds them all."""

    def add(f: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in f["counts"])
        return pd.DataFrame({"chunk": f["chunk"][:1], "part": f["part"][:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "chunk int, part int, counts binary"
    parts = described.filter("chunk >= 0").select("chunk", "part", "counts")
    for by in (["chunk", "part"], ["chunk"]):
        parts = parts.groupBy(*by).applyInPandas(add, kind)
    total = np.zeros(CELLS, np.int64)
    for r in parts.collect():  # 16 rows, 8 MB in all
        total[r["chunk"] * (CELLS // _CHUNKS):(r["chunk"] + 1) * (CELLS // _CHUNKS)] = np.frombuffer(
            zlib.decompress(r["counts"]), np.int64)
    return np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)


def _prefixes(rows: DataFrame, sketch: np.ndarray) -> DataFrame:
    """(token, key, n, pos): the rarest shingles of each set; a set once in each task."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(frames):
        count, seen = shared.value, set()
        for f in frames:
            tokens, keys, sizes, places = [], [], [], []
            for s in shingle_sets(f["text"]):
                if not len(s) or (key := _set_key(s)) in seen:
                    continue
                seen.add(key)
                take = len(s) - -(-NUM * len(s) // DEN) + 1
                order = np.lexsort((s, count[(s & np.uint64(CELLS - 1)).astype(np.int64)]))[:take]
                tokens.append(s[order].astype(np.int64))
                keys.append(np.full(take, key, np.int64))
                sizes.append(np.full(take, len(s), np.int64))
                places.append(np.arange(take))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens), "key": np.concatenate(keys),
                                    "n": np.concatenate(sizes), "pos": np.concatenate(places)})

    return rows.select("text").mapInPandas(run, "token long, key long, n int, pos int")


def _shared_tokens(prefixes: DataFrame) -> DataFrame:
    """Rows whose token two or more sets have, each with its group's centre; streamed in token order, never a group whole."""
    spread = prefixes.repartition("token").sortWithinPartitions("token", "pos", "n", "key")

    def run(frames):
        held, told = None, False  # the open group's centre, and whether its own row is out already
        for f in frames:
            t, k, n, p = (f[c].to_numpy() for c in ("token", "key", "n", "pos"))
            new = np.concatenate([[held is None or t[0] != held[0]], t[1:] != t[:-1]])
            carried = held is not None
            if carried:  # the open group's centre goes before this batch
                t, k, n, p = (np.concatenate([[x], y]) for x, y in zip(held, (t, k, n, p)))
                new = np.concatenate([[True], new])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            centre = first[group]
            other = k != k[centre]  # copies of the centre's set from other tasks are not a second set
            has = np.zeros(len(first), bool)
            np.logical_or.at(has, group, other)
            keep = other | (has[group] & (np.arange(len(t)) == centre))
            if carried and told:
                keep[0] = False
            told = bool(has[-1]) or (carried and told and len(first) == 1)
            held = tuple(x[first[-1]] for x in (t, k, n, p))
            c = centre[keep]
            yield pd.DataFrame({"token": t[keep], "key": k[keep], "n": n[keep], "pos": p[keep],
                                "c_key": k[c], "c_n": n[c], "c_pos": p[c]})

    return spread.mapInPandas(run, "token long, key long, n int, pos int, c_key long, c_n int, c_pos int")


def _may_link(n, pos, m, other_pos):
    """Length filter, and positional filter at a shared prefix shingle (right at the first one that two sets share)."""
    length = (F.least(n, m) * DEN) >= (F.greatest(n, m) * NUM)
    most = F.lit(1) + F.least(n - pos, m - other_pos) - 1
    return length & (most * (NUM + DEN) >= (n + m) * NUM)


def _suffix_filter(pairs: DataFrame, hists: DataFrame) -> DataFrame:
    """Drop pairs whose histograms rule out the intersection they need."""
    for side in ("a", "b"):
        pairs = pairs.join(hists.select(F.col("key").alias(side), F.col("hist").alias(f"h_{side}"),
                                        F.col("n").alias(f"n_{side}")), side)

    def run(frames):
        for f in frames:
            if len(f):
                x, y = (np.frombuffer(b"".join(f[c]), "<u2").reshape(-1, BINS).astype(np.int64) for c in ("h_a", "h_b"))
                most = np.minimum(x, y).sum(axis=1)
                full = (x == 65535).any(axis=1) | (y == 65535).any(axis=1)  # a cell that stopped counting
                ok = full | (most * (NUM + DEN) >= (f["n_a"] + f["n_b"]).to_numpy() * NUM)
                yield f.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""
    for side in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("key").alias(side), F.col("text").alias(f"t_{side}")), side)
    small_batches(pairs.sparkSession)

    def run(frames):
        for f in frames:
            sets = dict()
            for side in ("a", "b"):
                new = f.drop_duplicates(side)
                sets.update(zip(new[side], shingle_sets(new[f"t_{side}"])))
            ok = []
            for a, b in zip(f["a"], f["b"]):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                ok.append(both * (NUM + DEN) >= (len(sets[a]) + len(sets[b])) * NUM)
            yield f.loc[ok, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def _texts_of(rows: DataFrame, docs_by_key: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, text) of the sets in ``pairs``; a bitmap lets only (nearly) those texts into the shuffle."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = materialise(keys.join(docs_by_key, "key").select("key", "rep"), "llm-jaccard-wanted")
    bitmaps, bits = bitmaps_of(ids.select(F.xxhash64("rep").alias("h")), ids.count())
    near = in_bitmaps(rows.select("doc_id", "text", F.xxhash64("doc_id").alias("h")), "h", bitmaps, bits)

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"key": [_set_key(s) for s in shingle_sets(f["text"])], "text": f["text"]})

    found = near.select("text").mapInPandas(run, "key long, text string")
    # rows that repeat an id can bring other texts; texts of one key have one set, so any of them will do
    return materialise(found.join(keys, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")),
                       "llm-jaccard-texts")


def components(edges: DataFrame) -> DataFrame:
    """(key, component): the smallest key reachable; keys without an edge are not listed."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "llm-jaccard-edges")
    labels = materialise(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("component")),
                         "llm-jaccard-labels")
    while True:
        heard = (both.join(labels, both["b"] == labels["key"]).groupBy("a").agg(F.min("component").alias("heard")))
        step = (labels.join(heard, labels["key"] == heard["a"])
                .select("key", F.col("component").alias("old"), F.least("component", "heard").alias("component")))
        jump = labels.select(F.col("key").alias("__k"), F.col("component").alias("__c"))
        step = (step.join(jump, F.col("component") == F.col("__k"))
                .select("key", "old", F.least("component", "__c").alias("component")))
        step = materialise(step, "llm-jaccard-labels")
        labels = step.select("key", "component")
        if step.filter("old <> component").isEmpty():
            return labels


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, component (null for an empty set) and own, a key of (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    described = materialise(_describe(rows.withColumn("own", row_key("doc_id", "text"))), "llm-jaccard-described")
    listed = described.filter("chunk < 0")
    sets = materialise(listed.filter("n > 0").groupBy("key")
                       .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"),
                            F.first("hist").alias("hist")), "llm-jaccard-sets")
    shared = materialise(_shared_tokens(_prefixes(rows, _sketch(described))), "llm-jaccard-shared")
    # round 1: each set with one centre
    star = (shared.filter("key <> c_key").filter(_may_link(F.col("n"), F.col("pos"), F.col("c_n"), F.col("c_pos")))
            .groupBy("key", "c_key").agg(F.count(F.lit(1)).alias("common")))
    star = star.groupBy("key").agg(F.max_by("c_key", F.struct("common", "c_key")).alias("b"))
    star = materialise(_suffix_filter(star.select(F.col("key").alias("a"), "b"), sets), "llm-jaccard-star")
    reps = sets.select("key", "rep")
    linked = materialise(_verify(star, _texts_of(rows, reps, star)), "llm-jaccard-links")
    first = components(linked)
    # round 2: pairs across the components that a shingle's group still has
    part = (shared.select("token", "key", "n", "pos").join(first, "key", "left")
            .withColumn("component", F.coalesce("component", "key")))
    part = materialise(part, "llm-jaccard-parts")
    mixed = part.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    part = part.join(mixed.select("token"), "token", "left_semi")
    other = part.select(F.col("token").alias("t2"), F.col("key").alias("b"), F.col("n").alias("m"),
                        F.col("pos").alias("pos2"), F.col("component").alias("other"))
    across = (part.join(other, (F.col("token") == F.col("t2")) & (F.col("key") < F.col("b"))
                        & (F.col("component") != F.col("other"))
                        & _may_link(F.col("n"), F.col("pos"), F.col("m"), F.col("pos2")))
              .select(F.col("key").alias("a"), "b").distinct())
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = materialise(_suffix_filter(across.join(tried, ["a", "b"], "left_anti"), sets), "llm-jaccard-pairs")
    more = materialise(_verify(across, _texts_of(rows, reps, across)), "llm-jaccard-links")
    final = components(linked.unionByName(more))
    # back to documents: a component is named by its smallest doc_id
    by_key = sets.select("key", "rep", "copies").join(final, "key", "left")
    by_key = materialise(by_key.withColumn("component", F.coalesce("component", "key")), "llm-jaccard-by-key")
    names = materialise(by_key.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")),
                        "llm-jaccard-names")
    total = by_key.count()
    named = materialise(join_groups(by_key, names, "component", "members", total).select("key", "component", "component_id", "copies"),
                        "llm-jaccard-named")
    some = listed.filter("n > 0").select("doc_id", "own", "n", "key")
    out = join_groups(some, named, "key", "copies", listed.count())
    none = listed.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
                                         F.lit(None).cast("long").alias("component"), "own")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "component", "own").unionByName(none)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    return jaccard_classes(docs, doc_id, text).select("doc_id", "n_shingles", "component_id")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component (of its smallest doc_id, null last), and every row without words; columns unchanged.

    Decided by (doc_id, text), so rows that share an id or have none are told
    apart by their texts; of rows equal in both, one stays."""
    found = materialise(jaccard_classes(docs, doc_id, text).select("doc_id", "component", "own"), "llm-jaccard-classes")
    rows = (found.filter("component IS NOT NULL").groupBy("component", "own")
            .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")))
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own", "copies")).alias("b"))
    best = materialise(best.select(F.col("b.own").alias("__key"), F.col("b.copies").alias("copies")), "llm-jaccard-best")
    single = best.filter("copies = 1").select("__key").unionByName(
        found.filter("component IS NULL").select(F.col("own").alias("__key")).distinct())
    out = keep_rows(docs, single, doc_id, text)
    many = best.filter("copies > 1")
    return out if many.isEmpty() else out.unionByName(keep_rows(docs, many, doc_id, text, one_each=True))
