"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver tables (or data Spark derives from them) in
full; limits appear only where the operator is a top-k report.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.functions import text as T
from missive.operators import evaluate as EV
from missive.operators import features as FE
from missive.operators import history as H
from missive.operators import score as SC
from missive.operators import split as SP
from missive.operators import stats
from missive.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

# Corpus words used as a non-vacuous trigger list (the default list barely
# occurs in the synthetic prose).
CORPUS_TRIGGERS = ("the", "and", "of the", "le", "la", "des", "que", "der", "und", "el", "los", "with")


#: A text that is empty after cleaning: stop words and single letters only.
STOP_TEXT = " The of <b>and</b> a x "


def q_label_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = tables.table(spark, sf_dir, "labels")
    out = lab.select(
        "doc_id",
        T.standardise_label(F.col("toxic").cast("string")).alias("toxic_label"),
        T.standardise_label(F.col("quality").cast("double").cast("string")).alias("quality_label"),
        T.standardise_label(F.concat(F.lit(" "), F.when(F.col("quality") == 0, F.lit("YES"))
                                     .otherwise(F.lit("No")), F.lit("\t"))).alias("word_label"))
    return out.filter(T.is_valid_label(F.col("toxic_label")) & T.is_valid_label(F.col("quality_label")))


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.clean_text(F.col("text")).alias("clean_text"))


def q_html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select("page_id", T.clean_text(F.col("html")).alias("clean_text"))


def q_messages_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = tables.messages(spark, sf_dir)
    return stats.prepare_messages(msgs).select("doc_id", "label", "clean_text")


def q_dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dataset_stats(stats.prepare_messages(tables.messages(spark, sf_dir)))


def q_class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.class_distribution(q_dataset_stats(spark, sf_dir))


def q_token_counts_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.token_counts_by_label(stats.prepare_messages(tables.messages(spark, sf_dir)))


def _texts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), "text")
    pages = tables.table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"),
                                                         F.col("html").alias("text"))
    return docs.unionByName(pages)


def q_trigger_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.trigger_hits(_texts_by_source(spark, sf_dir), "text", ["source"])


def q_trigger_hits_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.trigger_hits(_texts_by_source(spark, sf_dir), "text", ["source"], CORPUS_TRIGGERS)


def q_trigger_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.table(spark, sf_dir, "pages")
    return pages.select("page_id", T.highlight_triggers(F.col("html"), CORPUS_TRIGGERS).alias("highlighted"))



def q_messages_gaps(spark, sf_dir):
    """Messages some of which have no label, no text, or nothing but stop words; the rest is cleaned."""
    msgs = tables.messages(spark, sf_dir)
    fifth = F.col("doc_id") % 5
    gaps = msgs.select("doc_id", F.when(fifth != 0, F.col("label")).alias("label"),
                       F.when(fifth == 1, F.lit(None)).when(fifth == 2, F.lit(STOP_TEXT)).otherwise(F.col("text")).alias("text"))
    return stats.prepare_messages(gaps).select("doc_id", "label", "clean_text")


# --- history reports -------------------------------------------------------

HISTORY_SEARCH = '"k": 7'


def q_history_search(spark, sf_dir):
    return H.get_history(tables.history(spark, sf_dir), 100, search_query=HISTORY_SEARCH)


def q_history_label_filter(spark, sf_dir):
    return H.get_history(tables.history(spark, sf_dir), 100, label_filter="SPAM")


def q_history_latest(spark, sf_dir):
    return H.get_history(tables.history(spark, sf_dir), 100, label_filter="All")


def q_history_kpis(spark, sf_dir):
    return H.kpis(tables.history(spark, sf_dir))


def _scored_history(spark, sf_dir):
    """The history's rows as a scored batch."""
    return tables.history(spark, sf_dir).select(
        F.col("email_text").alias("text"), "is_spam", F.col("probability").alias("spam_probability"),
        F.col("confidence").alias("confidence_score"), F.col("model_used").alias("model_name"),
        F.col("vectorizer_used").alias("vectorizer_name"))


def q_history_append(spark, sf_dir):
    """Two batches appended to a new history store and read back: rows, ids and texts of each."""
    from missive.session import scratch_path
    from missive.sources import history_store as HS
    scored = _scored_history(spark, sf_dir)
    path = scratch_path(spark, "history-append")
    HS.init_history(spark, path)
    for spam in (1, 0):
        HS.append_scored(spark, path, scored.filter(F.col("is_spam") == spam))
    return HS.read_history(spark, path).groupBy("is_spam").agg(
        F.count(F.lit(1)).alias("scans"), F.min("id").cast("long").alias("first_id"), F.max("id").cast("long").alias("last_id"),
        F.countDistinct("id").alias("n_ids"), F.countDistinct("email_text").alias("n_texts"))


def q_history_kpis_merged(spark, sf_dir):
    """A7, A9 from partial states: rows reach a history store by model in several appends, each followed by a refresh."""
    from missive.operators import kpi_state as KS
    from missive.session import scratch_path
    from missive.sources import history_store as HS
    hist = tables.history(spark, sf_dir)
    path = scratch_path(spark, "history-merged")
    HS.init_history(spark, path)
    batch = F.pmod(F.col("id"), F.lit(3))
    for k in range(3):
        rows = hist.filter(batch == k).select(*[c for c in hist.columns if c != "id"])
        HS.with_consecutive_ids(rows, "id", HS.next_id(spark, path)).select(*hist.columns).write.mode("append").parquet(path)
        if k != 1:   # a refresh may cover several appends
            KS.refresh(spark, path)
    states = KS.read_states(spark, path)
    return KS.kpis(states).crossJoin(F.broadcast(KS.scans_by_model(states)))


def q_history_by_model(spark, sf_dir):
    return H.scans_by_model(tables.history(spark, sf_dir))


def q_history_trend(spark, sf_dir):
    return H.trend(tables.history(spark, sf_dir))


def q_history_windowed_trend(spark, sf_dir):
    return H.windowed_trend(tables.history(spark, sf_dir), "1 hour")


def q_history_display(spark, sf_dir):
    return H.display(tables.history(spark, sf_dir))


# --- evaluation ------------------------------------------------------------

RULE_MODEL = "Marker rule"


def _rule_metrics(spark, sf_dir):
    preds = tables.rule_predictions(spark, sf_dir)
    m = EV.evaluate(preds, "label", "y_pred", ["lang"])
    return m.select(F.lit(RULE_MODEL).alias("model_name"), F.col("lang").alias("vectorizer_name"),
                    F.dense_rank().over(Window.orderBy("lang")).cast("long").alias("grid_ordinal"),
                    "tn", "fp", "fn", "tp", *EV.METRICS, "confusion_matrix")


def q_confusion_matrix(spark, sf_dir):
    m = _rule_metrics(spark, sf_dir)
    return m.select("vectorizer_name", "tn", "fp", "fn", "tp", EV.matrix_text(m).alias("matrix"))


def q_eval_metrics(spark, sf_dir):
    return _rule_metrics(spark, sf_dir).select("model_name", "vectorizer_name", *EV.METRICS)


def q_best_model(spark, sf_dir):
    return EV.best_model(_rule_metrics(spark, sf_dir)).select("model_name", "vectorizer_name", "f1_score")


def q_metrics_unpivot(spark, sf_dir):
    return EV.metrics_long(_rule_metrics(spark, sf_dir))


def q_metrics_table(spark, sf_dir):
    return EV.metrics_table(_rule_metrics(spark, sf_dir))


# --- split / features ------------------------------------------------------

def _prepared(spark, sf_dir):
    return stats.prepare_messages(tables.messages(spark, sf_dir)).select("doc_id", "label", "clean_text")


def _split(spark, sf_dir):
    """The split reads its input three times (bucket counts, whole buckets,
    boundary rows): the cleaned messages are written once, not re-cleaned."""
    from missive.session import materialise
    return SP.stratified_split(materialise(_prepared(spark, sf_dir), "prepared"), "label", "doc_id")


def _split_checkpointed(spark, sf_dir):
    """The split, materialised once in the shared checkpoint folder: the
    feature fit reads it several times (counts, top-k, doc frequency)."""
    from missive.operators import ml as ML
    return ML.prepare_split(_labelled(spark, sf_dir)).drop("y")


def q_stratified_split_members(spark, sf_dir):
    return _split(spark, sf_dir).select("doc_id", "label", "split")


def q_stratified_split_counts(spark, sf_dir):
    return SP.split_counts(_split(spark, sf_dir))


def q_class_weights(spark, sf_dir):
    train = _split(spark, sf_dir).filter(F.col("split") == "train")
    return SP.class_weights(train).select("label", "n_c", F.round("weight", 9).alias("weight"))


def q_tfidf_vocab(spark, sf_dir):
    train = _split_checkpointed(spark, sf_dir).filter(F.col("split") == "train")
    v = FE.fit_vocabulary(train)
    return v.select("term", "term_index", "term_count", "doc_freq", F.round("idf", 9).alias("idf"))


def q_tfidf_weights(spark, sf_dir):
    prepared = _split_checkpointed(spark, sf_dir)
    model = FE.TfidfModel.fit(prepared.filter(F.col("split") == "train"))
    w = model.weights_long(prepared, ["doc_id"])
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def q_bigram_counts(spark, sf_dir):
    """Every bigram of the cleaned labelled messages with its count."""
    return FE.bigram_counts(_prepared(spark, sf_dir).select("clean_text"))


def q_bigrams_topk(spark, sf_dir):
    """A report of the 100 most frequent bigrams."""
    return q_bigram_counts(spark, sf_dir).orderBy(F.col("n").desc(), F.col("bigram").asc()).limit(100)


def q_messages_lemmatised(spark, sf_dir):
    """T13 within cleaning (P4): labelled messages whose clean text consists of noun lemmas."""
    msgs = tables.messages(spark, sf_dir)
    return stats.prepare_messages(msgs, lemma_map=_lemma_table(spark, sf_dir)).select("doc_id", "label", "clean_text")


def q_embedding_mean(spark, sf_dir):
    emb = tables.table(spark, sf_dir, "embeddings")
    return FE.embedding_mean(emb).select("label", "dim", F.round("mean_value", 6).alias("mean_value"))


# --- scoring ---------------------------------------------------------------

def _rule_scored_batch(spark, sf_dir):
    items = tables.batch_input(spark, sf_dir)
    ok, _ = SC.split_valid(items)
    staged = ok.withColumn("clean_text", T.clean_text(F.col("text"))) \
        .withColumn("p", (F.length("text") % 101).cast("double") / F.lit(100.0))
    return SC.postprocess(staged, "p", "clean_text")


def q_score_postprocess(spark, sf_dir):
    return _rule_scored_batch(spark, sf_dir).select("id", "is_spam", "spam_probability", "confidence_score")


def q_score_blank(spark, sf_dir):
    """Scored turns, a third of them empty after cleaning: those are ham with probability 0 and full confidence."""
    items = tables.batch_input(spark, sf_dir)
    turn = F.substring_index("id", ":", -1).cast("int")
    ok, _ = SC.split_valid(items.withColumn("text", F.when(turn % 3 == 1, F.lit(STOP_TEXT)).otherwise(F.col("text"))))
    staged = ok.select("id", T.clean_text(F.col("text")).alias("clean_text"), ((F.length("text") % 101) / 100.0).alias("p"))
    return SC.postprocess(staged, "p", "clean_text").select("id", "clean_text", "is_spam", "spam_probability", "confidence_score")


def q_batch_summary(spark, sf_dir):
    return SC.batch_summary(_rule_scored_batch(spark, sf_dir), ("role",))


def q_batch_display(spark, sf_dir):
    return SC.batch_display(_rule_scored_batch(spark, sf_dir)).select(
        "id", "prediction", "probability_pct", "confidence_pct")


def q_pool_append(spark, sf_dir):
    msgs = tables.messages(spark, sf_dir)
    existing = msgs.select("label", "text")
    new = stats.standardise_labels(msgs.select(F.col("toxic").cast("string").alias("label"), "text"))
    return existing.unionByName(new).na.drop(subset=["label", "text"])


# --- training and scoring (rows-only checks: learners are not SQL) ----------

def _labelled(spark, sf_dir):
    return tables.messages(spark, sf_dir).select("doc_id", "label", "text")


def _train_score(vec, model_name):
    def run(spark, sf_dir):
        from missive.operators import ml as ML
        res = ML.train_grid(ML.prepare_split(_labelled(spark, sf_dir)), [(vec, model_name)])
        preds = res.test_predictions[(vec, model_name)]
        return SC.postprocess(preds, "p", "clean_text").select(
            "doc_id", "label", "y_pred", "is_spam", "spam_probability", "confidence_score")
    run.__name__ = f"q_train_score_{vec}_{model_name}"
    return run


def q_model_grid(spark, sf_dir):
    from missive.operators import ml as ML
    return ML.train_grid(ML.prepare_split(_labelled(spark, sf_dir))).metrics


def q_word2vec_doc_vectors(spark, sf_dir):
    from missive.operators import ml as ML
    split_df = ML.prepare_split(_labelled(spark, sf_dir))
    vecs = ML.fit_vectorisers(split_df.filter(F.col("split") == "train"), (ML.W2V,))
    from pyspark.ml.functions import vector_to_array
    return vecs.features(ML.W2V, split_df).select("doc_id", "split", vector_to_array("features").alias("vector"))


#: Gradients at fitted weights are at most this long (the learners stop at a relative gain of 1e-4, Platt's at 1e-6).
GRADIENT_BOUND = 5e-3


def q_learner_optimality(spark, sf_dir):
    """M3, M8: is the gradient at the fitted weights of logistic regression and of Platt scaling within GRADIENT_BOUND?"""
    from missive.operators import ml as ML
    from missive.operators import optimality as OP
    split_df = ML.prepare_split(_labelled(spark, sf_dir))
    res = ML.train_grid(split_df, [(ML.TFIDF, ML.LR), (ML.TFIDF, ML.SVM)])
    train = split_df.filter(F.col("split") == "train")
    rows = SP.with_class_weight(train).select(F.col("doc_id").alias("key"), "y", "weight")
    lr, tfidf = res.models[(ML.TFIDF, ML.LR)], res.vectorisers.tfidf
    beta = spark.createDataFrame([(t, float(b)) for t, b in zip(tfidf.terms, lr.coefficients.toArray())], "term string, beta double")   # <= 5000
    long = tfidf.weights_long(train.select(F.col("doc_id").alias("key"), "clean_text"), ["key"]).withColumnRenamed("weight", "x")
    reg = 1.0 / train.count()
    out = OP.logistic_gradient(long, rows, F.broadcast(beta), lr.intercept, reg).withColumn("learner", F.lit(ML.LR))
    platt = res.models[(ML.TFIDF, ML.SVM)]
    margins = platt.margins.withColumn("key", F.monotonically_increasing_id()).withColumn("weight", F.lit(1.0))
    from missive.session import materialise
    margins = materialise(margins, "platt-rows")
    slope = spark.createDataFrame([("margin", float(platt.calibrator.coefficients[0]))], "term string, beta double")
    out = out.unionByName(OP.logistic_gradient(margins.select("key", F.lit("margin").alias("term"), F.col("margin").alias("x")),
                                               margins.select("key", "y", "weight"), slope, platt.calibrator.intercept, 0.0)
                          .withColumn("learner", F.lit("Platt scaling")))
    return out.select("learner", "n_rows", "n_terms", (F.col("gradient_norm") < GRADIENT_BOUND).alias("optimal"))


def _order_messages(spark, sf_dir):
    """Stand-in messages: the parts of an order as words, finished orders as spam."""
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("w"))
    texts = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "w"))).alias("ws"))   # one order's lines
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "spam").otherwise("ham").alias("label"))
    return orders.join(texts, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("doc_id"), "label", F.array_join("ws.w", " ").alias("clean_text"))


def q_gaussian_nb_vectors(spark, sf_dir):
    """Gaussian naive Bayes on means of stored word vectors; unknown words are skipped, rows without a known one are zero."""
    from pyspark.ml.functions import array_to_vector
    from missive.operators import ml as ML
    from missive.operators.wordvec import WordVectors
    stored = tables.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("word"),
                                                             array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"))
    vecs = ML.Vectorisers(w2v=WordVectors(stored, 64))
    rows = ML.target(vecs.features(ML.W2V, _order_messages(spark, sf_dir)))
    model = ML.fit_model(ML.NB, ML.W2V, rows, 0)
    scored = SC.postprocess(ML.spam_probability(model, rows), "p", "clean_text")
    return scored.select("doc_id", "label", "is_spam", "spam_probability")


def _train_words(spark, sf_dir):
    train = _split_checkpointed(spark, sf_dir).filter(F.col("split") == "train")
    return train.select(T.split_clean_text(F.col("clean_text")).alias("_words"))


def q_word_pairs(spark, sf_dir):
    """words of training messages within five places of each other, counted in both orders."""
    from missive.operators import wordvec as WV
    return WV.pair_counts(_train_words(spark, sf_dir), "_words")


def q_word_ppmi(spark, sf_dir):
    """the positive pointwise mutual information of those pairs."""
    from missive.operators import wordvec as WV
    return WV.pair_weights(_train_words(spark, sf_dir), "_words").select("a", "b", F.round("weight", 6).alias("weight"))


def q_word_vectors(spark, sf_dir):
    """F6 without a model on the driver: every word with company gets a finite vector that is not zero."""
    from pyspark.ml.functions import vector_to_array
    from missive.operators import wordvec as WV
    train = _split_checkpointed(spark, sf_dir).filter(F.col("split") == "train")
    v = WV.fit_word_vectors(train).table.select("word", vector_to_array("vector").alias("v"))
    return v.select("word", F.size("v").alias("size"), F.exists("v", lambda x: x != 0).alias("not_zero"),
                    F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6)).alias("finite"))


def q_score_documents(spark, sf_dir):
    """Flagship: train LR on TF-IDF, score every document, summarise by source."""
    from missive.operators import ml as ML
    res = ML.train_grid(ML.prepare_split(_labelled(spark, sf_dir)), [(ML.TFIDF, ML.LR)])
    clf = ML.Classifier(ML.LR, ML.TFIDF, res.vectorisers, res.models[(ML.TFIDF, ML.LR)])
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return SC.batch_summary(clf.score(docs), ("source",))


# --- ingestion round trip and streams --------------------------------------

def q_ingest_roundtrip(spark, sf_dir):
    """K1 -> S1-S7: write labelled messages as headerless TSV under the shared
    folder, read them back with sniffing, the malformed-row rule and P1/P2."""
    from missive.session import scratch_path
    from missive.sources import ingest
    path = scratch_path(spark, "raw-pool")
    ingest.write_raw_tsv(tables.messages(spark, sf_dir).select("label", "text"), path)
    return ingest.ingest_labelled(spark, path, "auto").na.drop(subset=["label", "text"])


def q_stream_kpis(spark, sf_dir):
    from missive.session import scratch_path
    from missive.streaming import stream as ST
    out, ck = scratch_path(spark, "kpis-out"), scratch_path(spark, "kpis-ckpt")
    ST.run_live_kpis(ST.history_stream_from_events(spark, sf_dir), out, ck).awaitTermination()
    return ST.latest_per_key(out, spark, [])


def q_stream_trend(spark, sf_dir):
    from missive.session import scratch_path
    from missive.streaming import stream as ST
    out, ck = scratch_path(spark, "trend-out"), scratch_path(spark, "trend-ckpt")
    ST.run_certainty_trend(ST.history_stream_from_events(spark, sf_dir), out, ck).awaitTermination()
    res = ST.latest_per_key(out, spark, ["window_start", "window_end"])
    # back to naive UTC wall time, like the batch table's event time
    return res.withColumn("window_start", tables.utc_wall_clock(F.col("window_start"))) \
        .withColumn("window_end", tables.utc_wall_clock(F.col("window_end")))


def q_stream_score(spark, sf_dir):
    """ST1: train LR on TF-IDF, then score conversation turns as a file stream
    into the history (foreachBatch, replay-safe); read the history back."""
    from missive.operators import ml as ML
    from missive.session import scratch_path
    from missive.streaming import stream as ST
    res = ML.train_grid(ML.prepare_split(_labelled(spark, sf_dir)), [(ML.TFIDF, ML.LR)])
    clf = ML.Classifier(ML.LR, ML.TFIDF, res.vectorisers, res.models[(ML.TFIDF, ML.LR)])
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").schema
    src = spark.readStream.schema(schema).parquet(ST.table_glob(sf_dir, "conversations")).select("text")
    hist, ck = scratch_path(spark, "history"), scratch_path(spark, "score-ckpt")
    ST.score_stream(src, clf, hist, ck).awaitTermination()
    return spark.read.parquet(hist).drop("batch_id")


def _nb(spark, sf_dir, lemmas=None):
    """A naive Bayes bundle on TF-IDF: its fit has a closed form, so SQL can check every score."""
    from missive.operators import ml as ML
    from missive.session import scratch_path
    return ML.load_or_train(spark, scratch_path(spark, "nb-model"), _labelled(spark, sf_dir), [(ML.TFIDF, ML.NB)], lemmas)


def q_batch_analysis(spark, sf_dir):
    """Train and store a model, load it, score conversation turns as a batch into a history (K5)."""
    from missive.operators import ml as ML
    from missive.session import scratch_path
    from missive.sources import history_store as HS
    hist = scratch_path(spark, "batch-history")
    preds, _ = ML.analyze_batch(spark, _nb(spark, sf_dir), tables.batch_input(spark, sf_dir).select("id", "text"), hist)
    stored = HS.read_history(spark, hist)
    seen = stored.groupBy(F.col("email_text").alias("text")).agg(
        F.count(F.lit(1)).alias("n_stored"), F.max("probability").alias("stored_probability"))
    return preds.join(seen, "text").select("id", "is_spam", "spam_probability", "confidence_score", "model_name",
                                           "n_stored", "stored_probability")


def _lemma_table(spark, sf_dir):
    from missive.functions.lemma import build_lexicon, lemma_map
    from missive.session import materialise
    toks = materialise(tables.messages(spark, sf_dir).na.drop(subset=["label", "text"])
                       .select("doc_id", T.clean_tokens(F.col("text")).alias("tokens")), "lemma-tokens")
    return materialise(lemma_map(toks, build_lexicon(toks, "tokens"), None, "tokens"), "lemma-map")


def q_score_lemmatised(spark, sf_dir):
    """T13 in training and scoring alike: a model of lemmas, stored with its lemma map, scores the messages."""
    scored = _nb(spark, sf_dir, _lemma_table(spark, sf_dir)).score(_labelled(spark, sf_dir).select("doc_id", "text"))
    return scored.select("doc_id", "clean_text", "is_spam", "spam_probability", "confidence_score")


def q_stream_score_nb(spark, sf_dir):
    """ST1 with naive Bayes: scores of the streamed conversation turns, read back from the history."""
    from missive.session import scratch_path
    from missive.streaming import stream as ST
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").schema
    src = spark.readStream.schema(schema).parquet(ST.table_glob(sf_dir, "conversations")).select("text") \
        .filter(F.length("text") >= 1)
    hist, ck = scratch_path(spark, "history-nb"), scratch_path(spark, "score-nb-ckpt")
    ST.score_stream(src, _nb(spark, sf_dir), hist, ck).awaitTermination()
    return spark.read.parquet(hist).groupBy("email_text", "is_spam", "probability", "confidence", "model_used").agg(
        F.count(F.lit(1)).alias("n"))


def q_model_registry(spark, sf_dir):
    """Train the whole grid into a registry and read its metrics back."""
    from missive.operators import ml as ML
    from missive.session import scratch_path
    from missive.sources import ingest
    root = scratch_path(spark, "registry")
    ML.retrain(spark, root, _labelled(spark, sf_dir))
    m = ingest.read_model_metrics(spark, ML.active_model_dir(spark, root))
    cell = lambda i, j: F.col("confusion_matrix")[i][j]
    right = (cell(0, 0) + cell(1, 1)) / (cell(0, 0) + cell(0, 1) + cell(1, 0) + cell(1, 1))
    return m.select("model_name", "vectorizer_name", "grid_ordinal",
                    (cell(0, 0) + cell(0, 1)).alias("ham_tested"), (cell(1, 0) + cell(1, 1)).alias("spam_tested"),
                    ((F.abs(right - F.col("accuracy")) < 1e-9) & F.col("f1_score").between(0, 1)).alias("consistent"))


def q_pool_versions(spark, sf_dir):
    """Overwrite a pool, append to it, read its newest version."""
    from missive.session import scratch_path
    from missive.sources import ingest
    root = scratch_path(spark, "pool")
    msgs = tables.messages(spark, sf_dir)
    ingest.update_pool(spark, root, msgs.select("label", "text"), "overwrite")
    new = stats.standardise_labels(msgs.select(F.col("toxic").cast("string").alias("label"), "text"))
    told = ingest.update_pool(spark, root, new, "append")
    return ingest.read_pool(spark, root).select("label", "text", F.lit(told["uploaded_records"]).cast("long").alias("uploaded"),
                                                F.lit(told["total_records"]).cast("long").alias("total"),
                                                F.lit(told["version"]).cast("long").alias("version"))


def q_processed_versions(spark, sf_dir):
    """K4: a processed set read, its pool appended to, and the set read again: the old part is kept, the new one cleaned."""
    from missive.session import scratch_path
    from missive.sources import ingest
    root = scratch_path(spark, "pool-processed")
    msgs = tables.messages(spark, sf_dir)
    ingest.update_pool(spark, root, msgs.select("label", "text"), "overwrite")
    before = ingest.read_processed_pool(spark, root).count()
    new = stats.standardise_labels(msgs.select(F.col("toxic").cast("string").alias("label"), "text"))
    ingest.update_pool(spark, root, new, "append")
    return ingest.read_processed_pool(spark, root).withColumn("rows_before", F.lit(before).cast("long"))


def q_history_clear(spark, sf_dir):
    """K7: a history that is cleared between two appends keeps the second alone, with ids from 1."""
    from missive.session import scratch_path
    from missive.sources import history_store as HS
    scored = _scored_history(spark, sf_dir)
    path = scratch_path(spark, "history-clear")
    HS.init_history(spark, path)
    HS.append_scored(spark, path, scored.filter("is_spam = 1"))
    HS.clear_history(spark, path)
    HS.append_scored(spark, path, scored.filter("is_spam = 0"))
    return HS.read_history(spark, path).groupBy("is_spam").agg(
        F.count(F.lit(1)).alias("scans"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.countDistinct("id").alias("n_ids"), F.countDistinct("email_text").alias("n_texts"))


def q_ingest_modes(spark, sf_dir):
    """Files with a header line read by both explicit modes; without a header the line is a row with no valid label."""
    from missive.session import scratch_path
    from missive.sources import ingest
    path = scratch_path(spark, "modes")
    rows = tables.messages(spark, sf_dir).select("label", _one_field(F.col("text")).alias("text"))
    rows.write.option("header", True).option("sep", "\t").option("quote", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = [ingest.ingest_labelled(spark, path, m).withColumn("mode", F.lit(m)) for m in ("headered", "headerless")]
    return read[0].unionByName(read[1])


def q_ingest_headered(spark, sf_dir):
    """Files with a header, roles by name, labels of four spellings (one not valid), no quoting.

    A fifth of the texts keeps its commas, and nothing is quoted: a comma is one field too many, and such rows are skipped."""
    from missive.session import scratch_path
    from missive.sources import ingest
    path = scratch_path(spark, "headered")
    label = F.element_at(F.array(F.lit("YES"), F.lit(" no "), F.lit("maybe"), F.lit("Spam")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = tables.messages(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("note"), _one_field(F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.translate("text", ",", ";"))).alias("message"),
        label.alias("category"))
    rows.write.option("header", True).option("quote", "").option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return ingest.ingest_labelled(spark, path)


def _one_field(text):
    return F.concat(F.lit("t "), F.regexp_replace(F.coalesce(text, F.lit("")), r"[\"\\\r\n\t]", " "))


def q_ingest_quoted(spark, sf_dir):
    """Pages as a headered CSV whose texts hold quotes, separators and line breaks, read back by splits."""
    from missive.session import scratch_path
    from missive.sources import ingest
    pages = tables.table(spark, sf_dir, "pages")
    text = F.concat(F.lit("\""), F.coalesce("url", F.lit("")), F.lit("\",\n\n\""), F.coalesce("html", F.lit("")), F.lit("\"\n"))
    rows = pages.select(F.when(F.col("page_id") % 3 == 0, "spam").when(F.col("page_id") % 3 == 1, "ham").alias("label"), text.alias("message"))
    path = scratch_path(spark, "quoted-csv")
    (rows.write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return ingest.ingest_labelled(spark, path, "auto")


def q_ingest_ragged(spark, sf_dir):
    """Tab-separated files with a header; a third of the rows has no text (kept, text null), a third a field too many (skipped)."""
    from missive.session import scratch_path
    from missive.sources import ingest
    third, tab = F.col("doc_id") % 3, F.lit("\t")
    line = F.concat(F.col("label"), F.when(third == 0, F.lit("")).otherwise(F.concat(tab, _one_field(F.col("text")))),
                    F.when(third == 1, F.concat(tab, F.lit("extra"))).otherwise(F.lit("")))
    path = scratch_path(spark, "ragged")
    # one column under the header of two: rows keep the number of fields that their text has
    (tables.messages(spark, sf_dir).select(line.alias("label\ttext")).write.option("header", True).option("sep", "\x01").option("quote", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return ingest.ingest_labelled(spark, path, "auto")


def q_processed_reread(spark, sf_dir):
    """The processed set written and read again; rows whose clean text is empty or null go."""
    from missive.session import scratch_path
    from missive.sources import ingest
    path = scratch_path(spark, "processed")
    prepared = stats.prepare_messages(tables.messages(spark, sf_dir))
    blank = F.when(F.col("doc_id") % 7 == 0, F.lit("")).when(F.col("doc_id") % 7 != 1, F.col("clean_text"))
    ingest.write_processed(prepared.withColumn("clean_text", blank), path)
    return ingest.read_processed(spark, path)


def q_batch_file(spark, sf_dir):
    """A batch file written and read again; null and empty texts are rejected."""
    from missive.session import scratch_path
    from missive.sources import ingest
    path = scratch_path(spark, "batch-file")
    turn = F.col("turn")
    conv = tables.table(spark, sf_dir, "conversations")
    ingest.write_batch_results(conv.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string")).alias("id"),
        F.when(turn % 5 == 3, F.lit(None)).when(turn % 5 == 4, F.lit("")).otherwise(F.col("text")).alias("text"), "role"), path)
    ok, rejected = SC.split_valid(ingest.read_batch_input(spark, path))
    return ok.withColumn("accepted", F.lit(True)).unionByName(
        rejected.withColumn("accepted", F.lit(False))).select("id", "accepted", F.coalesce("text", F.lit("")).alias("text"))


def q_batch_row_numbers(spark, sf_dir):
    """A batch file without ids: rows are numbered from 1 without gap or repeat, texts stay whole."""
    from missive.session import scratch_path
    from missive.sources import ingest
    path = scratch_path(spark, "batch-no-ids")
    ingest.write_batch_results(tables.table(spark, sf_dir, "conversations").select("role", "text"), path)
    rows = ingest.read_batch_input(spark, path).withColumn("at", F.col("id").cast("long"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("at").alias("n_ids"), F.min("at").alias("first_id"),
                    F.max("at").alias("last_id"), F.count_if(F.col("id") != F.col("at").cast("string")).alias("n_odd"),
                    F.sum(F.length("text")).alias("text_chars"), F.countDistinct("text").alias("n_texts"))


def q_lemmatize(spark, sf_dir):
    """Noun lemmas of the cleaned tokens of labelled messages (corpus lexicon, df >= 2)."""
    from missive.functions.lemma import lemmatize
    msgs = tables.messages(spark, sf_dir).na.drop(subset=["label", "text"])
    toks = msgs.select("doc_id", T.clean_tokens(F.col("text")).alias("tokens"))
    return lemmatize(toks, "tokens", "lemmas", key_col="doc_id").select(
        "doc_id", F.array_join("lemmas", " ").alias("lemma_text"))

QUERIES: dict[str, Query] = {
    "label_standardise": q_label_standardise,
    "clean_text": q_clean_text,
    "html_strip": q_html_strip,
    "messages_clean": q_messages_clean,
    "messages_gaps": q_messages_gaps,
    "dataset_stats": q_dataset_stats,
    "class_distribution": q_class_distribution,
    "token_counts_by_label": q_token_counts_by_label,
    "trigger_hits": q_trigger_hits,
    "trigger_hits_corpus": q_trigger_hits_corpus,
    "trigger_highlight": q_trigger_highlight,
    "history_search": q_history_search,
    "history_label_filter": q_history_label_filter,
    "history_latest": q_history_latest,
    "history_kpis": q_history_kpis,
    "history_append": q_history_append,
    "history_kpis_merged": q_history_kpis_merged,
    "history_by_model": q_history_by_model,
    "history_trend": q_history_trend,
    "history_windowed_trend": q_history_windowed_trend,
    "history_display": q_history_display,
    "confusion_matrix": q_confusion_matrix,
    "eval_metrics": q_eval_metrics,
    "best_model": q_best_model,
    "metrics_unpivot": q_metrics_unpivot,
    "metrics_table": q_metrics_table,
    "stratified_split_members": q_stratified_split_members,
    "stratified_split_counts": q_stratified_split_counts,
    "class_weights": q_class_weights,
    "tfidf_vocab": q_tfidf_vocab,
    "tfidf_weights": q_tfidf_weights,
    "bigrams_topk": q_bigrams_topk,
    "bigram_counts": q_bigram_counts,
    "messages_lemmatised": q_messages_lemmatised,
    "embedding_mean": q_embedding_mean,
    "score_postprocess": q_score_postprocess,
    "score_blank": q_score_blank,
    "batch_summary": q_batch_summary,
    "batch_display": q_batch_display,
    "pool_append": q_pool_append,
    "train_score_lr_tfidf": _train_score("TF-IDF", "Logistic Regression"),
    "train_score_nb_tfidf": _train_score("TF-IDF", "Naive Bayes"),
    "train_score_svm_tfidf": _train_score("TF-IDF", "Support Vector Machine"),
    "train_score_rf_tfidf": _train_score("TF-IDF", "Random Forest"),
    "train_score_lr_w2v": _train_score("Word2Vec", "Logistic Regression"),
    "train_score_nb_w2v": _train_score("Word2Vec", "Naive Bayes"),
    "train_score_svm_w2v": _train_score("Word2Vec", "Support Vector Machine"),
    "train_score_rf_w2v": _train_score("Word2Vec", "Random Forest"),
    "model_grid": q_model_grid,
    "word2vec_doc_vectors": q_word2vec_doc_vectors,
    "score_documents": q_score_documents,
    "ingest_roundtrip": q_ingest_roundtrip,
    "stream_kpis": q_stream_kpis,
    "stream_trend": q_stream_trend,
    "stream_score": q_stream_score,
    "lemmatize": q_lemmatize,
    "batch_analysis": q_batch_analysis,
    "score_lemmatised": q_score_lemmatised,
    "stream_score_nb": q_stream_score_nb,
    "model_registry": q_model_registry,
    "pool_versions": q_pool_versions,
    "processed_versions": q_processed_versions,
    "history_clear": q_history_clear,
    "ingest_modes": q_ingest_modes,
    "ingest_headered": q_ingest_headered,
    "ingest_quoted": q_ingest_quoted,
    "ingest_ragged": q_ingest_ragged,
    "batch_row_numbers": q_batch_row_numbers,
    "learner_optimality": q_learner_optimality,
    "gaussian_nb_vectors": q_gaussian_nb_vectors,
    "word_pairs": q_word_pairs,
    "word_ppmi": q_word_ppmi,
    "word_vectors": q_word_vectors,
    "processed_reread": q_processed_reread,
    "batch_file": q_batch_file,
}
FLAGSHIP = "score_documents"
