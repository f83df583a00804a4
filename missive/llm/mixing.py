"""Operator 10: mixing sources to target weights by hash thresholds (native).

Every document has a fixed 60-bit hash. A source whose target is r times its
size takes each document floor(r) times and once more if the hash lies below
the source's threshold. Thresholds come from nested histograms: sizes are
summed by source and the first 12 bits of the hash, the bucket in which the
running sum passes the budget is found, and only that bucket's documents are
summed again by the next 12 bits, and so on. Nothing is sorted but the at most
4,096 buckets of one source.

Targets: the weights repeat over the sources by code point, null last, and
share ``share`` of all sizes; a target stops at ``cap`` times its source's size
and the excess goes to the others by weight, which is the fill level L with
sum(min(cap * size, L * weight)) = budget.

Defined cases: a null text has size 0; a null source is a source of its own; an
empty table, or one without words, takes nothing; documents with one hash
(rows that repeat id and text) are taken or left together; the document at the
threshold is taken if that brings the sum nearer to the target. The number of
sources is the only thing that meets in one task (the fill level is global).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import bounded, n_words, whole_row
from missive.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Hex digits of the hash that the nested histograms resolve; the last is the whole hash.
LEVELS = (3, 6, 9, 15)


def _hash(doc_id: Column, text: Column, seed: str) -> Column:
    joined = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")),
                      F.lit(":"), F.coalesce(text, F.lit("")))
    return F.substring(F.md5(joined), 1, 15)


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    return docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"),
                       n_words(docs[text]).alias("size"), _hash(docs[doc_id], docs[text], seed).alias("hash"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target, copies (whole takes) and need (words beyond them)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("weight", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    fill = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    per = (per.withColumn("__most", F.col("source_size") * F.lit(float(cap)))
           .withColumn("__ratio", F.col("__most") / F.col("weight"))
           .withColumn("__budget", F.sum("source_size").over(everything) * F.lit(float(min(share, cap))))
           .withColumn("__before", F.coalesce(F.sum("__most").over(fill.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0.0)))
           .withColumn("__rest", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
           .withColumn("__level", (F.col("__budget") - F.col("__before")) / F.col("__rest"))
           .withColumn("__open", F.when(F.col("__ratio") > F.col("__level"),
                                        F.struct(F.col("__ratio").alias("r"), F.col("__level").alias("level"))))
           .withColumn("__fill", F.min("__open").over(everything)["level"])
           .withColumn("target", F.coalesce(F.least(F.col("__most"), F.col("__fill") * F.col("weight")),
                                            F.col("__most"))))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return (per.withColumn("copies", copies.cast("long"))
            .withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
            .select("source", "source_size", "target", "copies", "need"))


def thresholds(sized: DataFrame, per: DataFrame) -> DataFrame:
    """Per source, the hash at which the running size passes ``need`` and whether that hash is taken."""
    need = per.filter("need > 0").select(F.col("source").alias("__s"), "need")   # whole takes need no threshold
    inside, edge = sized, None
    for depth in LEVELS:
        bucket = F.substring("hash", 1, depth)
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        hist = hist.join(need, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        if edge is None:
            hist = hist.withColumn("base", F.lit(0).cast("long"))
        else:
            hist = (hist.join(edge.select(F.col("source").alias("__s"), F.col("before").alias("base")),
                              F.col("source").eqNullSafe(F.col("__s"))).drop("__s"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = (hist.withColumn("after", F.col("base") + F.sum("words").over(run))
                .withColumn("before", F.col("after") - F.col("words")))
        edge = bounded(hist.filter((F.col("before") <= F.col("need")) & (F.col("after") > F.col("need")))
                       .select("source", "bucket", "before", "after", "need"), "llm-mix-edge")
        if depth != LEVELS[-1]:
            cut = edge.select(F.col("source").alias("__s"), F.col("bucket").alias("__b"))
            inside = (inside.join(cut, F.col("source").eqNullSafe(F.col("__s"))
                                  & (F.substring("hash", 1, depth) == F.col("__b"))).drop("__s", "__b"))
            inside = materialise(inside, "llm-mix-bucket")  # 1/4096 of the rows at each level
    return edge.select("source", F.col("bucket").alias("threshold"),
                       (F.col("after") - F.col("need") < F.col("need") - F.col("before")).alias("at_threshold"))


def _plan(sized: DataFrame, weights, share, cap) -> DataFrame:
    per = bounded(targets(sized, weights, share, cap), "llm-mix-targets")
    cut = thresholds(sized, per).select(F.col("source").alias("__s"), "threshold", "at_threshold")
    return bounded(per.join(cut, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"), "llm-mix-plan")


def _times() -> Column:
    extra = (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("at_threshold"))
    return (F.col("copies") + F.coalesce(extra, F.lit(False)).cast("long"))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, times."""
    sized = materialise(_sized(docs, doc_id, text, source, seed), "llm-mix-sized")
    plan = _plan(sized, weights, share, cap).withColumnRenamed("source", "__s")
    out = sized.join(plan, F.col("source").eqNullSafe(F.col("__s"))).withColumn("times", _times())
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("size") * F.col("times")).alias("taken"), "times")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mixture itself: every row as often as it is taken, all columns unchanged; texts are not shuffled."""
    sized = materialise(_sized(docs, doc_id, text, source, seed), "llm-mix-sized")
    plan = (_plan(sized, weights, share, cap)
            .select(F.col("source").alias("__s"), "copies", "threshold", "at_threshold"))
    own = docs.select(whole_row(docs), docs[source].alias("__source"),
                      _hash(docs[doc_id], docs[text], seed).alias("hash"))
    taken = own.join(plan, F.col("__source").eqNullSafe(F.col("__s"))).withColumn("__times", _times().cast("int"))
    return (taken.filter("__times > 0")
            .withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*"))
