"""Operator 6: quality rules with robust multivariate outliers (native).

Every text gives base statistics (words, symbols, repeated lines and
three-word windows) and from them a vector of four transformed statistics. Per
language and source the minimum-covariance-determinant estimate (centre and
covariance of the ``KEEP`` of rows that lie closest together) is found by
concentration steps from several deterministic starts, all around the medians:
median deviations, the covariance of spatial signs, and that of tanh scores.
In a step rows are ranked by Mahalanobis distance under the current estimate,
and the next estimate is made from the nearest rows. A start goes on as long as
its determinant falls by more than ``GAIN``; since it cannot fall below that of
the least spreads, every start ends by itself. Of a group's starts the least
determinant wins. A step is one aggregation: counts, sums and products by
group, start and distance class (logarithmic, ``CLASSES`` at most); the class
at the border counts with the fraction that makes the share exact. So no group
meets in one task and a group of any size shuffles the same few rows. Estimates
are one narrow row per group and start; the 4 x 4 Cholesky factor is written
out as columns.

A row is rejected when its squared distance exceeds ``CUTOFF`` or a base rule
fails. Each statistic keeps a least spread (``FLOOR``), as otherwise a group in
which nearly all rows agree would reject any other row.

Defined cases: null and empty texts have no words and fail the base rule; a
null language or source is a group of its own; groups under ``MIN_GROUP`` rows
are judged together with the language's other small groups, and with all small
languages if those are still too few; an empty table gives an empty result;
repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missive.llm.common import BROADCAST_ROWS, SPACE, WORD, bounded, words
from missive.session import materialise

#: Share of a group's rows that the estimate is made from.
KEEP = 0.5
#: Rejection bound for the squared distance (4 degrees of freedom; the chi-squared tail is 1e-9).
CUTOFF = 48.0
#: Median of chi-squared with 4 degrees of freedom, which scales the estimate (fixed value).
CHI2_MEDIAN = 3.3567
MIN_GROUP = 50
#: A start is done when the logarithm of its factor's determinant falls by no more than this in a step.
GAIN = 0.001
STARTS = ("spread", "signs", "tanh")
#: Median of the absolute deviations of a normal law, as a share of its standard deviation (fixed value).
MAD_SHARE = 0.6745
#: Classes per unit of asinh(value / least spread), by which medians are found.
PER_UNIT = 64
#: Distance classes per doubling of the squared distance, and the least and largest exponent.
PER_OCTAVE, LOW, HIGH = 12, -7, 13
CLASSES = PER_OCTAVE * (HIGH - LOW)
STATS = ("x0", "x1", "x2", "x3")
#: Least standard deviations of: log words, mean word length, symbols (root of share), repeats (root of share).
FLOOR = {"x0": 0.2, "x1": 0.2, "x2": 0.03, "x3": 0.15}


def base_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
               source: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; one row per input row."""
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[lang].alias("lang"), docs[source].alias("source"), t.alias("t"),
                       words(t).alias("w"),
                       F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    tail = lambda k: F.slice("w", F.lit(k), F.greatest(F.size("w") - (k - 1), F.lit(0)))
    # three-word windows as (hash, place), sorted, so that equal windows are neighbours
    windows = F.slice(F.arrays_zip(F.col("w").alias("a"), tail(2).alias("b"), tail(3).alias("c")), F.lit(1),
                      F.greatest(F.size("w") - 2, F.lit(0)))
    keyed = F.transform(windows, lambda g, i: F.struct(F.xxhash64(g["a"], g["b"], g["c"]).alias("h"), i.alias("i")))
    rows = rows.select("doc_id", "lang", "source", "t", F.size("w").cast("long").alias("n_words"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                       F.sort_array(keyed).alias("s"))
    # "near": whether the entry before, or the entry after, holds the same window
    after = F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0)))
    same = F.zip_with(F.col("s"), after, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    rows = rows.select("doc_id", "lang", "source", "t", "n_words", "n_dup_lines", "s", same.alias("same"))
    before = F.concat(F.array(F.lit(False)), F.col("same"))
    flagged = F.arrays_zip(F.col("s").alias("own"), F.col("same").alias("next"),
                           F.slice(before, F.lit(1), F.size("s")).alias("prev"))
    twice = F.filter(flagged, lambda x: x["next"] | x["prev"])
    places = F.flatten(F.transform(twice, lambda x: F.array(x["own"]["i"], x["own"]["i"] + 1, x["own"]["i"] + 2)))
    return rows.select(
        "doc_id", "lang", "source", "n_words",
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        "n_dup_lines", F.size(F.array_distinct(places)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return (stats.withColumn("x0", F.log(n + F.lit(1.0)))
            .withColumn("x1", F.col("word_chars") / n)
            .withColumn("x2", F.sqrt(F.col("n_symbols") / chars))
            .withColumn("x3", F.sqrt(F.col("n_repeat_words") / n)))


def _groups(rows: DataFrame) -> DataFrame:
    """Add glang, gsource: the group a row is judged in (small groups are pooled); one narrow table of groups."""
    per = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < MIN_GROUP
    per = per.withColumn("pooled", F.sum(F.when(small, F.col("n")).otherwise(0)).over(Window.partitionBy("lang")))
    name = lambda c: F.concat(F.lit("="), F.coalesce(F.col(c), F.lit("")), F.col(c).isNull().cast("string"))
    per = per.select(
        F.col("lang").alias("__l"), F.col("source").alias("__s"),
        F.when(small & (F.col("pooled") < MIN_GROUP), F.lit("*")).otherwise(name("lang")).alias("glang"),
        F.when(small, F.lit("*")).otherwise(name("source")).alias("gsource"))
    per = bounded(per, "llm-mcd-groups")
    return (rows.join(per, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")))
            .drop("__l", "__s"))


def _pairs():
    return [(i, j) for i in range(len(STATS)) for j in range(i + 1)]


def _moments() -> list[Column]:
    one = [F.count(F.lit(1)).alias("n")] + [F.sum(x).alias(f"s_{x}") for x in STATS]
    return one + [F.sum(F.col(STATS[i]) * F.col(STATS[j])).alias(f"p_{i}{j}") for i, j in _pairs()]


def _factor(sums: DataFrame) -> DataFrame:
    """Centre m_i and Cholesky factor l_ij of the covariance, from sums of a group's rows."""
    out = sums
    for x in STATS:
        out = out.withColumn(f"m_{x}", F.col(f"s_{x}") / F.col("n"))
    for i, j in _pairs():
        cov = F.col(f"p_{i}{j}") / F.col("n") - F.col(f"m_{STATS[i]}") * F.col(f"m_{STATS[j]}")
        if i == j:  # a least spread on the diagonal keeps the matrix positive definite
            cov = F.greatest(cov, F.lit(0.0)) + F.lit(FLOOR[STATS[i]] ** 2)
        out = out.withColumn(f"c_{i}{j}", cov)
    for i, j in _pairs():
        dot = F.lit(0.0)
        for k in range(j):
            dot = dot + F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
        rest = F.col(f"c_{i}{j}") - dot
        out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOOR[STATS[i]] ** 2 / 16))) if i == j
                             else rest / F.col(f"l_{j}{j}"))
    return out.select(*_KEYS, *_ESTIMATE)


_KEYS = ("glang", "gsource", "start")
_ESTIMATE = tuple(f"m_{x}" for x in STATS) + tuple(f"l_{i}{j}" for i, j in _pairs())


def _log_det() -> Column:
    total = F.lit(0.0)
    for i in range(len(STATS)):
        total = total + F.log(F.col(f"l_{i}{i}"))
    return total


def _distance(rows: DataFrame, est: DataFrame, how: str = "left") -> DataFrame:
    """Add d2, the squared Mahalanobis distance (forward substitution); null where a group has no estimate."""
    out, total = rows.join(est, ["glang", "gsource"], how), F.lit(0.0)
    for i, x in enumerate(STATS):
        z = F.col(x) - F.col(f"m_{x}")
        for k in range(i):
            z = z - F.col(f"l_{i}{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", z / F.col(f"l_{i}{i}"))
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return out.withColumn("d2", total)


def _class(d2: Column) -> Column:
    octave = F.log2(F.greatest(d2, F.lit(2.0 ** LOW)))
    return F.least(F.floor((octave - LOW) * PER_OCTAVE), F.lit(CLASSES - 1)).cast("int")


def _by_class(rows: DataFrame, est: DataFrame) -> DataFrame:
    return _distance(rows, est, "inner").groupBy(*_KEYS, _class(F.col("d2")).alias("class")).agg(*_moments())


def _nearest(classes: DataFrame, share: float) -> DataFrame:
    """Sums over the nearest ``share`` of each group's rows; the class at the border counts with a fraction."""
    group = Window.partitionBy(*_KEYS)
    before = F.coalesce(F.sum("n").over(group.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.greatest(F.least((F.sum("n").over(group) * F.lit(share) - before) / F.col("n"), F.lit(1.0)), F.lit(0.0))
    names = ["n"] + [f"s_{x}" for x in STATS] + [f"p_{i}{j}" for i, j in _pairs()]
    return (classes.withColumn("part", part).filter("part > 0").groupBy(*_KEYS)
            .agg(*[F.sum(F.col(c) * F.col("part")).alias(c) for c in names]))


def _medians(rows: DataFrame, values: dict[str, Column], names: dict[str, str]) -> DataFrame:
    """Per (glang, gsource) the median of each value as its class' middle: a histogram, so no group meets in one task."""
    scaled = {x: F.asinh(v / F.lit(FLOOR[x])) * F.lit(float(PER_UNIT)) for x, v in values.items()}
    stat = F.explode(F.array(*[F.struct(F.lit(x).alias("stat"), F.floor(v).cast("int").alias("class")) for x, v in scaled.items()]))
    counts = (rows.select("glang", "gsource", stat.alias("s")).groupBy("glang", "gsource", "s.stat", "s.class")
              .agg(F.count(F.lit(1)).alias("n")))
    group = Window.partitionBy("glang", "gsource", "stat")
    upto = F.sum("n").over(group.orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    middle = (counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(group)).filter(F.col("upto") * 2 >= F.col("all"))
              .groupBy("glang", "gsource", "stat").agg(F.min("class").alias("class")))
    return middle.groupBy("glang", "gsource").agg(*[
        F.max(F.when(F.col("stat") == x, F.sinh((F.col("class") + 0.5) / PER_UNIT) * F.lit(FLOOR[x]))).alias(names[x])
        for x in STATS])


def _starts(rows: DataFrame) -> DataFrame:
    """First estimates, all centred on the medians, which a clump under half of a group bounds."""
    centre = bounded(_medians(rows, {x: F.col(x) for x in STATS}, {x: f"m_{x}" for x in STATS}), "llm-mcd-estimate")
    apart = rows.join(centre, ["glang", "gsource"])
    mad = _medians(apart, {x: F.abs(F.col(x) - F.col(f"m_{x}")) for x in STATS}, {x: f"d_{x}" for x in STATS})
    spread = lambda x: F.sqrt(F.pow(F.col(f"d_{x}") / MAD_SHARE, F.lit(2.0)) + F.lit(FLOOR[x] ** 2))
    scale = bounded(centre.join(mad, ["glang", "gsource"]).select("glang", "gsource", *[f"m_{x}" for x in STATS],
                                                                  *[spread(x).alias(f"w_{x}") for x in STATS]), "llm-mcd-scale")
    plain = scale.select("glang", "gsource", F.lit(STARTS[0]).alias("start"), *[f"m_{x}" for x in STATS],
                         *[(F.col(f"w_{STATS[i]}") if i == j else F.lit(0.0)).alias(f"l_{i}{j}") for i, j in _pairs()])
    z = {x: (F.col(x) - F.col(f"m_{x}")) / F.col(f"w_{x}") for x in STATS}
    length = F.sqrt(sum((v * v for v in z.values()), F.lit(0.0)))
    bent = {STARTS[1]: {x: v * len(STATS) ** 0.5 / F.greatest(length, F.lit(1e-6)) for x, v in z.items()},
            STARTS[2]: {x: F.tanh(v) for x, v in z.items()}}
    scores = F.explode(F.array(*[F.struct(F.lit(name).alias("start"), *[v.alias(x) for x, v in t.items()]) for name, t in bent.items()]))
    # scores in units of the statistics, so that the least spreads mean the same
    scored = (rows.join(scale, ["glang", "gsource"]).select("glang", "gsource", scores.alias("t"), *[f"w_{x}" for x in STATS])
              .select("glang", "gsource", "t.start", *[(F.col(f"t.{x}") * F.col(f"w_{x}")).alias(x) for x in STATS]))
    shaped = _factor(scored.groupBy(*_KEYS).agg(*_moments())).drop(*[f"m_{x}" for x in STATS])
    return plain.unionByName(shaped.join(centre, ["glang", "gsource"]))


def mcd(rows: DataFrame) -> DataFrame:
    """Robust centre and scaled Cholesky factor per (glang, gsource); ``rows`` has the statistics ``STATS``."""
    current = materialise(_starts(rows), "llm-mcd-estimate")
    small = current.count() <= BROADCAST_ROWS
    best = current.select(*_KEYS, F.struct(*_ESTIMATE).alias("best"), F.lit(float("inf")).alias("det"))
    while True:
        found = _factor(_nearest(_by_class(rows, F.broadcast(current) if small else current), KEEP))
        found = found.select(*_KEYS, F.struct(*_ESTIMATE).alias("new"), _log_det().alias("new_det"))
        step = best.join(found, list(_KEYS), "left")
        less = F.coalesce(F.col("new_det") < F.col("det"), F.lit(False))
        step = materialise(step.select(*_KEYS, F.when(less, F.col("new")).otherwise(F.col("best")).alias("best"),
                                       F.when(less, F.col("new_det")).otherwise(F.col("det")).alias("det"),
                                       F.coalesce(F.col("new_det") < F.col("det") - F.lit(GAIN), F.lit(False)).alias("goes_on")),
                           "llm-mcd-estimate")
        best, current = step.drop("goes_on"), step.filter("goes_on").select(*_KEYS, "best.*")
        if current.isEmpty():
            break
    chosen = best.groupBy("glang", "gsource").agg(F.min_by("best", F.struct("det", "start")).alias("best"))
    est = bounded(chosen.select("glang", "gsource", F.lit("least").alias("start"), "best.*"), "llm-mcd-estimate")
    # the estimate of the nearest rows is too narrow: scale it so that the median distance is that of a normal law
    upto = F.sum("n").over(Window.partitionBy(*_KEYS).orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    classes = _distance(rows, est, "inner").groupBy(*_KEYS, _class(F.col("d2")).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    middle = (classes.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy(*_KEYS)))
              .filter(F.col("upto") * 2 >= F.col("all")).groupBy("glang", "gsource").agg(F.min("class").alias("class")))
    scale = F.sqrt(F.greatest(F.pow(F.lit(2.0), (F.col("class") + 0.5) / PER_OCTAVE + LOW) / CHI2_MEDIAN, F.lit(1.0)))
    est = est.join(middle.select("glang", "gsource", scale.alias("scale")), ["glang", "gsource"])
    factor = [(F.col(f"l_{i}{j}") * F.col("scale")).alias(f"l_{i}{j}") for i, j in _pairs()]
    return bounded(est.select("glang", "gsource", *[f"m_{x}" for x in STATS], *factor), "llm-mcd-estimate")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source") -> DataFrame:
    """One row per input row: doc_id, the base statistics, base_failed, kept and distance2."""
    stats = materialise(_vector(base_stats(docs, doc_id, text, lang, source)), "llm-quality-stats")
    rows = _groups(stats)
    # rows that fail a base rule are rejected anyway: the estimates describe the others
    est = mcd(rows.filter(~base_failed()).select("glang", "gsource", *STATS))
    judged = _distance(rows, est)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)).alias("kept"), F.col("d2").alias("distance2"))

