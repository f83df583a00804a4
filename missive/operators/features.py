"""Feature operators (F1-F8): TF-IDF vocabulary and weights, Word2Vec pooling.

TF-IDF definition (fitted on training rows only):
  terms      = word runs of >= 2 word characters in clean_text, plus adjacent bigrams
  vocabulary = top ``max_features`` terms by corpus count (ties: term ascending),
               indexed alphabetically
  tf         = 1 + ln(count in row)          (sublinear, non-zero entries only)
  idf        = ln((1 + n) / (1 + df)) + 1    (smooth idf; n = training rows)
  weight     = tf * idf, then L2-normalised per row

Plan shape: term counting for the vocabulary is an explode + partial
aggregate; an exact count cutoff trims it before the top-k; the vocabulary
(bounded by ``max_features``) is the only thing broadcast. Per-row weights are
map-only: ``CountVectorizerModel`` counts vocabulary terms inside each row with
a hash map, sublinear tf is one array expression on the sparse struct, and
after one Parquet hop (struct -> VectorUDT) idf scaling and the L2 norm are
Spark's vector transformers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from missive.functions import text as T
from missive.operators import parts as P
from missive.operators.wordvec import WordVectors
from missive.session import materialise, scratch_path

MAX_FEATURES = 5000
W2V_SIZE = 100
W2V_WINDOW = 5
W2V_MIN_COUNT = 1
W2V_EPOCHS = 10
SEED = 42


def analyzer_terms(clean_col: Column) -> Column:
    """F1 analyzer: word runs of two or more characters plus their bigrams."""
    return T.uni_and_bigrams(T.vocab_tokens(clean_col))


# ---------------------------------------------------------------------------
# Vocabulary
# ---------------------------------------------------------------------------

def with_terms(df: DataFrame, clean_col: str = "clean_text", out_col: str = "_terms") -> DataFrame:
    """Stage the token array in its own column so the regex runs once per row."""
    return (df.withColumn("_toks", T.vocab_tokens(F.col(clean_col)))
            .withColumn(out_col, T.uni_and_bigrams(F.col("_toks"))).drop("_toks"))


def term_counts(train: DataFrame, clean_col: str = "clean_text") -> DataFrame:
    return counts_of_terms(with_terms(train.select(clean_col), clean_col))


def counts_of_terms(terms: DataFrame) -> DataFrame:
    """(term, term_count) from a frame with a ``_terms`` array (partial aggregation)."""
    return (terms.select(F.explode("_terms").alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("term_count")))


def bigram_counts(df: DataFrame, clean_col: str = "clean_text") -> DataFrame:
    """bigram, n: how often each bigram of the analyzer occurs.

    Counted in parts (``operators.parts``) and summed in as many tasks, so that
    a task's memory does not grow with the input; a frequent bigram is one row a part."""
    def counts(rows: pa.Table) -> pa.Table:
        words, lengths = P.flat_words(rows)
        row = np.repeat(np.arange(len(lengths)), lengths)
        one = pa.array(row[:-1] == row[1:])
        pairs = pc.binary_join_element_wise(words[:-1].filter(one), words[1:].filter(one), pa.scalar(" ", words.type))
        found = pairs.value_counts()
        return pa.table({"bigram": found.field("values"), "n": found.field("counts")})

    rows, parts = P.dealt(df.select(clean_col), T.vocab_tokens(F.col(clean_col)), "bigram-rows")
    counted = P.by_part(rows.select("_part", "_words"), parts).applyInArrow(counts, "bigram string, n long")
    return counted.repartition(parts, "bigram").groupBy("bigram").agg(F.sum("n").alias("n"))


def count_cutoff(counts: DataFrame, k: int) -> int | None:
    """Smallest count c such that the terms with count >= c number at least ``k``
    (None when there are fewer than ``k`` terms).

    Works on the histogram of count values (term_count -> number of terms),
    whose size is bounded by sqrt(2 * total tokens), not by the vocabulary.
    """
    from pyspark.sql import Window
    hist = counts.groupBy("term_count").agg(F.count(F.lit(1)).alias("n_terms"))
    desc = Window.orderBy(F.col("term_count").desc()).rowsBetween(Window.unboundedPreceding, 0)
    row = (hist.withColumn("cum", F.sum("n_terms").over(desc))
           .filter(F.col("cum") >= k).agg(F.max("term_count").alias("cut")).first())
    return None if row is None or row["cut"] is None else int(row["cut"])


def top_terms(counts: DataFrame, max_features: int) -> DataFrame:
    """Exact top ``max_features`` by (count desc, term asc). Rows below the count
    cutoff are dropped before the top-k, so the final single-task merge sees
    about ``max_features`` rows instead of ``max_features`` per partition."""
    cut = count_cutoff(counts, max_features)
    kept = counts if cut is None else counts.filter(F.col("term_count") >= cut)
    return kept.orderBy(F.col("term_count").desc(), F.col("term").asc()).limit(max_features)


def fit_vocabulary(train: DataFrame, clean_col: str = "clean_text",
                   max_features: int = MAX_FEATURES, n_docs: int | None = None,
                   terms: DataFrame | None = None) -> DataFrame:
    """(term, term_index, term_count, doc_freq, idf) for the top ``max_features`` terms.

    ``terms`` may pass the training rows' staged ``_terms`` arrays so that the
    analyzer runs once for both the counts and the document frequencies."""
    if terms is None:
        terms = with_terms(train.select(clean_col), clean_col)
    counts = materialise(counts_of_terms(terms), "term-counts")   # read by the cutoff and the top-k
    top = top_terms(counts, max_features)
    distinct_terms = terms.select(F.explode(F.array_distinct("_terms")).alias("term"))
    dfreq = (distinct_terms.join(F.broadcast(top.select("term")), "term")   # <= max_features rows
             .groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq")))
    if n_docs is None:
        n_docs = terms.count()
    n = F.lit(float(n_docs))
    vocab = top.join(dfreq, "term", "left").withColumn("doc_freq", F.coalesce("doc_freq", F.lit(0)))
    vocab = vocab.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("doc_freq"))) + F.lit(1.0))
    # Alphabetical index over <= max_features rows (single small partition by design).
    from pyspark.sql import Window
    return vocab.withColumn("term_index", (F.row_number().over(Window.orderBy("term")) - 1).cast("long"))


@dataclass
class TfidfModel:
    """A fitted TF-IDF vocabulary held as two bounded driver-side lists."""
    terms: list[str]
    idf: list[float]
    n_docs: int

    @classmethod
    def fit(cls, train: DataFrame, clean_col: str = "clean_text",
            max_features: int = MAX_FEATURES) -> "TfidfModel":
        # tokens are written; terms are made of them twice, for counts and document frequencies: kept, they are many times the texts
        tokens = materialise(train.select(T.vocab_tokens(F.col(clean_col)).alias("_toks")), "tfidf-tokens")
        n_docs = tokens.count()
        vocab = fit_vocabulary(train, clean_col, max_features, n_docs, tokens.select(T.uni_and_bigrams(F.col("_toks")).alias("_terms")))
        rows = vocab.select("term_index", "term", "idf").orderBy("term_index").collect()  # <= max_features
        return cls([r["term"] for r in rows], [float(r["idf"]) for r in rows], n_docs)

    def vocabulary_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.idf))],
            "term_index int, term string, idf double")

    def counter(self, clean_col: str = "clean_text") -> CountVectorizerModel:
        return CountVectorizerModel.from_vocabulary(self.terms, inputCol="_terms", outputCol="_tf")

    def weights_long(self, df: DataFrame, key_cols: list[str], clean_col: str = "clean_text") -> DataFrame:
        """(keys..., term, weight): long form of the same weights (the materialised
        vectors exploded, vocabulary joined by broadcast: <= max_features rows)."""
        vecs = self.materialise(df.select(*key_cols, clean_col), "_v", clean_col)
        u = F.unwrap_udt(F.col("_v"))
        z = vecs.select(*key_cols, F.explode(F.arrays_zip(u.getField("indices").alias("term_index"),
                                                          u.getField("values").alias("weight"))).alias("z"))
        vocab = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(self.terms)], "term_index int, term string")
        return (z.select(*key_cols, F.col("z.term_index").alias("term_index"), F.col("z.weight").alias("weight"))
                .join(F.broadcast(vocab), "term_index").drop("term_index"))

    def sublinear_struct(self, df: DataFrame, clean_col: str = "clean_text") -> DataFrame:
        """Adds ``_fs`` = the sparse struct of 1 + ln(count) per vocabulary term (no idf, no norm)."""
        staged = df.withColumn("_toks", T.vocab_tokens(F.col(clean_col))) \
            .withColumn("_terms", T.uni_and_bigrams(F.col("_toks")))
        counted = self.counter().transform(staged)
        v = F.unwrap_udt(F.col("_tf"))
        fs = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(len(self.terms)).cast("int").alias("size"),
                      v.getField("indices").alias("indices"),
                      F.transform(v.getField("values"), lambda x: F.lit(1.0) + F.log(x)).alias("values"))
        return counted.withColumn("_fs", fs).drop("_toks", "_terms", "_tf")

    def materialise(self, df: DataFrame, features_col: str = "features", clean_col: str = "clean_text",
                    path: str | None = None) -> DataFrame:
        """Write rows with the sublinear-tf struct once, read them back typed as
        ``VectorUDT``, then scale by idf and L2-normalise with Spark's vector
        transformers (JVM vector code, no interpreted lambdas).

        The Parquet hop is what turns the struct into an ML vector without a
        Python worker; it also cuts lineage (the path is under the shared
        checkpoint folder) so the features survive executor loss and are
        reused by every model of the grid.
        """
        from pyspark.ml.feature import ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors
        spark = df.sparkSession
        path = path or scratch_path(spark, "tfidf-features")
        self.sublinear_struct(df, clean_col).withColumnRenamed("_fs", "_tf_sub").write.mode("overwrite").parquet(path)
        staged = read_with_vector(spark, path, "_tf_sub")
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.idf or [0.0]), inputCol="_tf_sub",
                                    outputCol="_tfidf").transform(staged)
        return Normalizer(p=2.0, inputCol="_tfidf", outputCol=features_col).transform(scaled) \
            .drop("_tf_sub", "_tfidf")


def read_with_vector(spark: SparkSession, path: str, features_col: str) -> DataFrame:
    written = spark.read.parquet(path)
    schema = T_.StructType([
        T_.StructField(f.name, VectorUDT() if f.name == features_col else f.dataType, f.nullable)
        for f in written.schema.fields])
    return spark.read.schema(schema).parquet(path)


# ---------------------------------------------------------------------------
# Word2Vec (F6-F8)
# ---------------------------------------------------------------------------

def fit_word2vec(train: DataFrame, clean_col: str = "clean_text", vector_size: int = W2V_SIZE,
                 window: int = W2V_WINDOW, min_count: int = W2V_MIN_COUNT, epochs: int = W2V_EPOCHS,
                 seed: int = SEED, num_partitions: int | None = None) -> WordVectors:
    """skip-gram Word2Vec (negative sampling) on whitespace tokens of the training rows.

    Trained in parts and held as a table (``operators.skipgram``): nothing of
    the vocabulary's size is on the driver. ``num_partitions`` parts, by
    default as many as the words need."""
    from missive.operators import skipgram
    return skipgram.fit(train, T.split_clean_text(F.col(clean_col)), vector_size, window, min_count, epochs, seed, num_partitions)


MAX_BROADCAST_VOCAB = 1_000_000   # words; above this the vocabulary is looked up by parts, not shipped to every task
GATHERED = 32_768   # words whose vectors are summed at once
MEAN_WORDS = 1_000_000   # words of a part whose vectors are float32: large parts have fewer different words in all


def mean_vectors(model, df: DataFrame, clean_col: str = "clean_text",
                 out_col: str = "features", key_col: str | None = None) -> DataFrame:
    """F7 + F8: mean of the vectors of in-vocabulary words; zero vector if none.

    ``model`` is a ``Word2VecModel`` or a table of vectors (``wordvec.WordVectors``).
    Up to ``MAX_BROADCAST_VOCAB`` words the pooling is map-only: Spark's
    transform divides by *all* words, so the known-word count from a
    vocabulary counter rescales the mean in-row. A larger vocabulary is not
    shipped to every task: rows are dealt to parts, and each part takes the
    vectors of its different words from the table. No key is needed.
    """
    size = model.getVectorSize()
    vectors = model.getVectors()
    # a table of vectors is always looked up; of a Word2Vec model the vocabulary is already on the driver
    if not isinstance(model, Word2VecModel) or vectors.count() > MAX_BROADCAST_VOCAB:
        return _mean_vectors_by_part(vectors, df, clean_col, out_col, size, getattr(model, "single", False))
    vocab = [r["word"] for r in vectors.select("word").orderBy("word").collect()]   # <= MAX_BROADCAST_VOCAB
    counter = CountVectorizerModel.from_vocabulary(vocab, inputCol="_words", outputCol="_known")
    staged = df.withColumn("_words", T.split_clean_text(F.col(clean_col)))
    staged = counter.transform(model.setInputCol("_words").setOutputCol("_w2v").transform(staged))
    n_all = F.size("_words").cast("double")
    arr = vector_to_array(F.col("_w2v"))
    zeros = F.array_repeat(F.lit(0.0), size)
    # finish() sees the known-word count as a lambda variable: arr is evaluated once.
    mean = F.aggregate(F.unwrap_udt(F.col("_known")).getField("values"), F.lit(0.0), lambda a, x: a + x,
                       lambda nk: F.when(nk > 0, F.transform(arr, lambda x: x * n_all / nk)).otherwise(zeros))
    return staged.withColumn(out_col, array_to_vector(mean)).drop("_words", "_w2v", "_known")


def _mean_vectors_by_part(vectors: DataFrame, df: DataFrame, clean_col: str, out_col: str, size: int, single: bool = False) -> DataFrame:
    """Rows meet the vectors of their words part by part (``operators.parts``): no occurrence is shuffled with a vector.

    Vectors that are ``single`` are moved and held as float32, which loses nothing; sums are float64."""
    columns, kind = df.columns, np.float32 if single else np.float64

    def means(rows: pa.Table, known: pa.Table) -> pa.Table:
        words, lengths = P.flat_words(rows)
        names = P.joined(known["word"], words.type).dictionary_encode()
        place, at = names.indices.to_numpy(zero_copy_only=False), P.places(words, names.dictionary)
        times = np.bincount(place, minlength=len(names.dictionary))   # a word may have several vectors: each counts
        table, sums = P.matrix(known["v"], size, kind), np.zeros((rows.num_rows, size))
        if len(times) < len(table):
            order = np.argsort(place, kind="stable")
            table = np.add.reduceat(table[order], np.r_[0, np.cumsum(times)[:-1]], dtype=np.float64)
        here = np.flatnonzero(at >= 0)
        held, row = at[here], np.repeat(np.arange(len(lengths)), lengths)[here]
        for a in range(0, len(held), GATHERED):   # words in the order of the text: equal rows have equal sums
            r = row[a:a + GATHERED]
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            sums[r[starts]] += np.add.reduceat(table[held[a:a + GATHERED]], starts, dtype=np.float64)
        sums /= np.maximum(np.bincount(row, weights=times[held], minlength=len(sums)), 1)[:, None]
        return rows.select(columns).append_column(out_col, P.lists(np.round(sums, 12)))

    rows, parts = P.dealt(df, T.split_clean_text(F.col(clean_col)), "w2v-rows", part_words=max(MEAN_WORDS, P.PART_WORDS) if single else None)
    table = vectors.select("word", vector_to_array("vector", "float32" if single else "float64").alias("v"))
    schema = T_.StructType([*(rows.schema[c] for c in columns), T_.StructField(out_col, T_.ArrayType(T_.DoubleType()))])
    return P.look_up(rows, parts, table, means, schema).withColumn(out_col, array_to_vector(out_col))


def embedding_mean(df: DataFrame, group_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """F7 on stored embeddings: element-wise mean per group, long form (group, dim, mean_value)."""
    exploded = df.select(group_col, F.posexplode(vec_col).alias("dim", "x")).withColumn("dim", F.col("dim").cast("long"))
    return exploded.groupBy(group_col, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean_value"))
