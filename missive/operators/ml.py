"""Training grid, selection, persistence and scoring.

Grid: {TF-IDF, Word2Vec} x {logistic regression, naive Bayes, RBF-kernel SVM
with Platt scaling, random forest}, fitted on the training split only, evaluated on
the test split, best by F1 (first in grid order on ties).

Every model yields a spam probability ``p``; the class is ``p >= 0.5`` in
evaluation and in scoring alike. Features are materialised once per
vectoriser under the shared checkpoint folder and reused by all four models.
"""

from __future__ import annotations

import json
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.classification import (LinearSVC, LinearSVCModel, LogisticRegression,
                                       LogisticRegressionModel, NaiveBayes, NaiveBayesModel)
from pyspark.ml.feature import VectorAssembler, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.operators import evaluate as EV
from missive.operators import features as FE
from missive.operators import forest as FO
from missive.operators import split as SP
from missive.operators import stats
from missive.operators import wordvec as WV
from missive.sources import ingest
from missive.operators.kernel import SIZE as FOURIER_SIZE, FourierMap
from missive.operators.score import postprocess
from missive.session import materialise, scratch_path, read_or_none

TFIDF, W2V = "TF-IDF", "Word2Vec"
LR, NB, SVM, RF = "Logistic Regression", "Naive Bayes", "Support Vector Machine", "Random Forest"
GRID = [(TFIDF, LR), (TFIDF, NB), (TFIDF, SVM), (TFIDF, RF), (W2V, LR), (W2V, NB), (W2V, SVM), (W2V, RF)]
PLATT_FOLDS = 5
SEED = 42
# Iterative learners hold their rows as one block a partition and launch one job per
# iteration over all of them. A block may be sent whole to another executor, or moved
# to disk and back: partitions are sized by rows, not by scan layout, at about 30 MB.
ROWS_PER_TRAIN_PARTITION = 8_000
#: Rows up to which the fits of a Platt SVM all run at once; of more, each holds a copy of them, so few do.
ROWS_AT_ONCE, FEW_FITS = 50_000, 2


def target(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Explicit 0/1 target: spam = 1 (no frequency-ordered indexer)."""
    return df.withColumn("y", (F.col(label_col) == "spam").cast("double"))


def artefact_name(model_name: str, vectorizer_name: str) -> str:
    """K8 directory name: lower-cased names joined by '_'."""
    return f"{model_name.lower().replace(' ', '_')}_{vectorizer_name.lower().replace('-', '_')}"


# ---------------------------------------------------------------------------
# Estimators (M3-M8)
# ---------------------------------------------------------------------------

#: Passes a linear fit may take; it stops earlier when it converges.
MAX_ITERATIONS = 1000
#: Trees of a forest and their depth.
FOREST_TREES, FOREST_DEPTH = 100, 30


def _estimator(model_name: str, vectorizer_name: str, n_train: float):
    reg = 1.0 / max(n_train, 1)   # C = 1 on a sum of balanced weights that totals n_train
    # tol 1e-4 as in the grid's learner defaults; every L-BFGS iteration is a full pass (one Spark job)
    if model_name == LR:
        return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=MAX_ITERATIONS,
                                  regParam=reg, elasticNetParam=0.0, standardization=False, tol=1e-4)
    if model_name == NB:   # the only learner without balanced class weights in the grid
        kind = "multinomial" if vectorizer_name == TFIDF else "gaussian"
        return NaiveBayes(featuresCol="features", labelCol="y", modelType=kind, smoothing=1.0)
    if model_name == SVM:
        return LinearSVC(featuresCol="features", labelCol="y", weightCol="weight", maxIter=MAX_ITERATIONS,
                         regParam=reg, standardization=False, tol=1e-4)
    raise ValueError(f"unknown model: {model_name}")


def _margin(df: DataFrame, svm: LinearSVCModel, features_col: str = "features") -> DataFrame:
    scored = svm.setFeaturesCol(features_col).setRawPredictionCol("_raw").setPredictionCol("_svm_pred").transform(df)
    return scored.withColumn("margin", vector_to_array(F.col("_raw")).getItem(1)).drop("_raw", "_svm_pred")


#: Kernels of the SVM; the grid's is the RBF kernel.
KERNELS = ("rbf", "linear")


@dataclass
class PlattSVM:
    """An SVM plus a 1-feature logistic calibration fitted on out-of-fold margins.

    With a ``feature_map`` (M6, RBF kernel) the linear SVM works on its random
    Fourier features, without one on the features themselves."""
    svm: LinearSVCModel
    calibrator: LogisticRegressionModel
    feature_map: FourierMap | None = None
    margins: DataFrame | None = None   # of a fresh fit: y and out-of-fold margin of the rows that the calibrator saw

    @classmethod
    def fit(cls, train: DataFrame, kernel: str = "rbf", size: int = FOURIER_SIZE, gamma: float | None = None) -> "PlattSVM":
        """Five out-of-fold SVMs give unbiased margins for the calibrator; the
        final SVM uses all rows. The six fits are independent and run as
        concurrent Spark jobs from a small driver thread pool.

        Rows are dealt to folds by a hash of their features, so equal rows
        share a fold and no key column is needed. The mapped rows are written
        once: every pass of all six fits reads them, and nothing else is kept."""
        if kernel not in KERNELS:
            raise ValueError(f"unknown kernel {kernel!r}; expected one of {KERNELS}")
        feature_map = FourierMap.fit(train, gamma=gamma, size=size) if kernel == "rbf" else None
        folded = train.select("y", "weight", "features", F.pmod(F.xxhash64(F.unwrap_udt("features")), F.lit(PLATT_FOLDS)).alias("_fold"))
        if feature_map is not None:
            folded = feature_map.transform(folded)
        folded = materialise(folded, "svm-features")
        sums = folded.groupBy("_fold").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).collect()   # one row a fold
        mass = {r["_fold"]: r["w"] for r in sums}
        n_rows = sum(r["n"] for r in sums)
        folded = sized_for_iteration(folded, n_rows)
        whole = sum(mass.values())
        used = [k for k in sorted(mass) if 0 < mass[k] < whole]   # a fold that holds all rows leaves none to train on
        parts = [(folded.filter(F.col("_fold") != k), whole - mass[k]) for k in used] + [(folded, whole)]
        with ThreadPoolExecutor(max_workers=len(parts) if n_rows <= ROWS_AT_ONCE else FEW_FITS) as pool:
            fitted = list(pool.map(lambda p: _estimator(SVM, TFIDF, p[1]).fit(p[0]), parts))
        oof = None
        for k, svm in zip(used or sorted(mass), fitted):
            part = _margin(folded.filter(F.col("_fold") == k), svm).select("y", "margin")
            oof = part if oof is None else oof.unionByName(part)
        oof = materialise(oof, "svm-margins")
        cal_in = VectorAssembler(inputCols=["margin"], outputCol="mfeat").transform(oof)
        cal = LogisticRegression(featuresCol="mfeat", labelCol="y", maxIter=MAX_ITERATIONS, regParam=0.0).fit(cal_in)
        return cls(fitted[-1], cal, feature_map, oof)

    def transform(self, df: DataFrame) -> DataFrame:
        mapped = df if self.feature_map is None else self.feature_map.transform(df, out_col="_fourier")
        col = "features" if self.feature_map is None else "_fourier"
        scored = _margin(mapped, self.svm, col).drop("_fourier")
        m = VectorAssembler(inputCols=["margin"], outputCol="mfeat").transform(scored)
        out = self.calibrator.setProbabilityCol("probability").setPredictionCol("_cal_pred") \
            .setRawPredictionCol("_cal_raw").transform(m)
        return out.drop("mfeat", "margin", "_cal_pred", "_cal_raw")

    def save(self, path: str) -> None:
        self.svm.write().overwrite().save(f"{path}/svm")
        self.calibrator.write().overwrite().save(f"{path}/calibrator")
        if self.feature_map is not None:
            self.feature_map.save(SparkSession.getActiveSession(), f"{path}/feature_map")

    @classmethod
    def load(cls, path: str) -> "PlattSVM":
        return cls(LinearSVCModel.load(f"{path}/svm"), LogisticRegressionModel.load(f"{path}/calibrator"),
                   FourierMap.load(SparkSession.getActiveSession(), f"{path}/feature_map"))


def fit_model(model_name: str, vectorizer_name: str, train: DataFrame, n_train: int):
    if model_name == SVM:
        return PlattSVM.fit(train)
    if model_name == RF:
        return FO.Forest.fit(train, FOREST_TREES, FOREST_DEPTH, SEED)
    return _estimator(model_name, vectorizer_name, n_train).fit(train)


def spam_probability(model, df: DataFrame) -> DataFrame:
    """Adds ``p`` (probability of spam) from any fitted grid model."""
    if isinstance(model, FO.Forest):
        return model.probability(df)
    if isinstance(model, PlattSVM):
        out = model.transform(df)
    else:
        out = model.setProbabilityCol("probability").setPredictionCol("_pred") \
            .setRawPredictionCol("_rawp").transform(df).drop("_pred", "_rawp")
    return out.withColumn("p", vector_to_array(F.col("probability")).getItem(1)).drop("probability")


_LOADERS = {LR: LogisticRegressionModel, NB: NaiveBayesModel}


def load_model(model_name: str, path: str):
    if model_name == SVM:
        return PlattSVM.load(path)
    if model_name == RF:
        return FO.Forest.load(SparkSession.getActiveSession(), path)
    return _LOADERS[model_name].load(path)


def save_model(model, path: str) -> None:
    if isinstance(model, PlattSVM | FO.Forest):
        model.save(path)
    else:
        model.write().overwrite().save(path)


# ---------------------------------------------------------------------------
# Feature families
# ---------------------------------------------------------------------------

@dataclass
class Vectorisers:
    tfidf: FE.TfidfModel | None = None
    w2v: Word2VecModel | WV.WordVectors | None = None

    def features(self, name: str, df: DataFrame, path: str | None = None) -> DataFrame:
        spark = df.sparkSession
        if name == TFIDF:
            return self.tfidf.materialise(df, "features", path=path)
        path = path or scratch_path(spark, "w2v-features")
        key = "doc_id" if "doc_id" in df.columns else None
        FE.mean_vectors(self.w2v, df, key_col=key).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


#: How word vectors are fitted: Spark's skip-gram Word2Vec, whose vocabulary lives on the driver, or as a table.
WORD_VECTORS = {"word2vec": FE.fit_word2vec, "ppmi": WV.fit_word_vectors}


def fit_vectorisers(train: DataFrame, names=(TFIDF, W2V), word_vectors: str = "word2vec") -> Vectorisers:
    """Both feature families are fitted on the training rows only; the two fits
    are independent and run as concurrent Spark jobs."""
    fits = {TFIDF: FE.TfidfModel.fit, W2V: WORD_VECTORS[word_vectors]}
    wanted = [n for n in (TFIDF, W2V) if n in names]
    with ThreadPoolExecutor(max_workers=max(1, len(wanted))) as pool:
        done = dict(zip(wanted, pool.map(lambda n: fits[n](train), wanted)))
    return Vectorisers(tfidf=done.get(TFIDF), w2v=done.get(W2V))


# ---------------------------------------------------------------------------
# Training grid (M9-M11) and scoring
# ---------------------------------------------------------------------------

@dataclass
class TrainResult:
    metrics: DataFrame                       # one row per grid model
    test_predictions: dict = field(default_factory=dict)   # (vec, model) -> DataFrame
    models: dict = field(default_factory=dict)
    vectorisers: Vectorisers | None = None


def prepare_split(labelled: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """P3-P5 + M1 on labelled (doc_id, label, text) rows, checkpointed once; with a lemma map also T13."""
    prepared = materialise(stats.prepare_messages(labelled, lemma_map=lemmas).select("doc_id", "label", "clean_text"),
                           "prepared")   # read by the bucket count and both split branches
    return materialise(target(SP.stratified_split(prepared, "label", "doc_id")), "split")


def sized_for_iteration(df: DataFrame, n_rows: int, have: int | None = None) -> DataFrame:
    """As many partitions as ``n_rows`` need by ``ROWS_PER_TRAIN_PARTITION``: scan partitions are merged
    (no shuffle), and where the scan has fewer (``have``; asked of ``df``, a plain scan, if not given) rows are dealt."""
    want = max(1, math.ceil(n_rows / ROWS_PER_TRAIN_PARTITION))
    if have is None:
        have = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.coalesce(want) if want <= have else df.repartition(want)


def train_grid(split_df: DataFrame, grid=GRID, model_dir: str | None = None,
               lemmas: DataFrame | None = None, word_vectors: str = "word2vec") -> TrainResult:
    """M9: fit and evaluate every grid model. ``lemmas`` is the map ``split_df`` was cleaned with; it is saved with the models.
    ``word_vectors`` ("ppmi" for large vocabularies) says how the Word2Vec family is fitted."""
    spark = split_df.sparkSession
    train = split_df.filter(F.col("split") == "train")
    n_train = train.count()
    vec_names = tuple(dict.fromkeys(v for v, _ in grid))
    vecs = fit_vectorisers(train, vec_names, word_vectors)
    result = TrainResult(metrics=None, vectorisers=vecs)
    rows = []
    for vec in vec_names:
        feats = vecs.features(vec, split_df)
        # learners keep the rows in a form of their own: here they are read from the written features, without their texts
        weighted = SP.with_class_weight(feats.filter(F.col("split") == "train")).select("y", "weight", "features")
        tr = sized_for_iteration(weighted, n_train, feats._jdf.queryExecution().toRdd().getNumPartitions())
        te = feats.filter(F.col("split") == "test")
        names = [m for v, m in grid if v == vec]
        with ThreadPoolExecutor(max_workers=len(names)) as pool:   # independent fits overlap
            fitted = dict(zip(names, pool.map(lambda mn: fit_model(mn, vec, weighted if mn == RF else tr, n_train), names)))   # the forest reads its rows once, in the partitions they have
        for model_name in names:
            model = fitted[model_name]
            preds = spam_probability(model, te).withColumn(
                "y_pred", F.when(F.col("p") >= 0.5, F.lit("spam")).otherwise(F.lit("ham")))
            result.models[(vec, model_name)] = model
            result.test_predictions[(vec, model_name)] = preds
            m = EV.evaluate(preds).first()
            name = artefact_name(model_name, vec)
            rows.append((model_name, vec, GRID.index((vec, model_name)) + 1, m["tn"], m["fp"], m["fn"], m["tp"],
                         float(m["accuracy"]), float(m["precision"]), float(m["recall"]), float(m["f1_score"]),
                         name))
            if model_dir:
                save_model(model, f"{model_dir}/{name}")
    result.metrics = spark.createDataFrame(
        rows, "model_name string, vectorizer_name string, grid_ordinal long, tn long, fp long, fn long, tp long, "
              "accuracy double, precision double, recall double, f1_score double, model_filename string")
    if model_dir:
        save_vectorisers(vecs, model_dir)
        if lemmas is not None:
            lemmas.write.mode("overwrite").parquet(f"{model_dir}/lemma_map")
        write_metadata(result.metrics, split_df, model_dir)
    return result


def save_vectorisers(vecs: Vectorisers, model_dir: str) -> None:
    spark = SparkSession.getActiveSession()
    if vecs.tfidf is not None:
        vecs.tfidf.vocabulary_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{model_dir}/tfidf_vectorizer")
    if isinstance(vecs.w2v, WV.WordVectors):
        vecs.w2v.save(f"{model_dir}/word_vectors")
    elif vecs.w2v is not None:
        vecs.w2v.write().overwrite().save(f"{model_dir}/word2vec_model")


def load_vectorisers(model_dir: str, names=(TFIDF, W2V)) -> Vectorisers:
    spark = SparkSession.getActiveSession()
    v = Vectorisers()
    if TFIDF in names:
        rows = spark.read.parquet(f"{model_dir}/tfidf_vectorizer").orderBy("term_index").collect()  # <= 5000
        v.tfidf = FE.TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows], 0)
    if W2V in names:
        table = read_or_none(lambda: WV.WordVectors.load(spark, f"{model_dir}/word_vectors"))
        v.w2v = table or Word2VecModel.load(f"{model_dir}/word2vec_model")
    return v


def write_metadata(metrics: DataFrame, split_df: DataFrame, model_dir: str) -> None:
    """K9 + M18: metrics and dataset stats as JSON; the active pointer is written last."""
    best = EV.best_model(metrics).first()
    stats_row = stats.dataset_stats(split_df).first()
    m = metrics.withColumn("confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp"))) \
        .withColumn("vectorizer_filename", F.when(F.col("vectorizer_name") == TFIDF, F.lit("tfidf_vectorizer"))
                    .otherwise(F.lit("word2vec_model")))
    m.drop("tn", "fp", "fn", "tp").coalesce(1).write.mode("overwrite").json(f"{model_dir}/all_models")
    stats_row_df = split_df.sparkSession.createDataFrame([stats_row.asDict()])
    stats_row_df.coalesce(1).write.mode("overwrite").json(f"{model_dir}/dataset_stats")
    active = {"model_name": best["model_name"], "vectorizer_name": best["vectorizer_name"],
              "f1_score": float(best["f1_score"]), "model_filename": best["model_filename"],
              "vectorizer_filename": "tfidf_vectorizer" if best["vectorizer_name"] == TFIDF else "word2vec_model"}
    split_df.sparkSession.createDataFrame([(json.dumps(active),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(f"{model_dir}/active_model")


def read_active(spark: SparkSession, model_dir: str) -> dict | None:
    """The active-model pointer, or None when nothing was trained yet."""
    found = read_or_none(lambda: spark.read.text(f"{model_dir}/active_model"))
    row = found.first() if found is not None else None
    return json.loads(row["value"]) if row else None


@dataclass
class Classifier:
    """An active model bundle that scores DataFrames of raw text."""
    model_name: str
    vectorizer_name: str
    vectorisers: Vectorisers
    model: object
    lemmas: DataFrame | None = None   # the map the training texts were cleaned with (T13)

    @classmethod
    def load(cls, spark: SparkSession, model_dir: str) -> "Classifier":
        active = read_active(spark, model_dir)
        if active is None:
            raise FileNotFoundError(f"no active model under {model_dir}")
        vec = active["vectorizer_name"]
        return cls(active["model_name"], vec, load_vectorisers(model_dir, (vec,)),
                   load_model(active["model_name"], f"{model_dir}/{active['model_filename']}"),
                   read_or_none(lambda: spark.read.parquet(f"{model_dir}/lemma_map")))

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """M12-M14 over a whole frame: clean -> vectorise -> p -> class/confidence."""
        from missive.functions import text as T
        if self.lemmas is None:
            staged = df.withColumn("clean_text", T.clean_text(F.col(text_col)))
        else:
            from missive.functions.lemma import lemmatize_column
            rows = materialise(df.withColumn("_row", F.monotonically_increasing_id())   # any frame, with or without a key
                               .withColumn("_tokens", T.clean_tokens(F.col(text_col))), "score-rows")
            staged = lemmatize_column(rows, "_tokens", self.lemmas, "_lemmas", key_col="_row") \
                .withColumn("clean_text", F.array_join("_lemmas", " ")).drop("_row", "_tokens", "_lemmas")
        feats = self.vectorisers.features(self.vectorizer_name, staged)
        scored = spam_probability(self.model, feats).drop("features")
        return postprocess(scored, "p", "clean_text").withColumn("model_name", F.lit(self.model_name)) \
            .withColumn("vectorizer_name", F.lit(self.vectorizer_name))


def load_or_train(spark: SparkSession, model_dir: str, labelled: DataFrame, grid=GRID,
                  lemmas: DataFrame | None = None) -> Classifier:
    """Load the active model; train the grid first when none exists."""
    if read_active(spark, model_dir) is None:
        train_grid(prepare_split(labelled, lemmas), grid, model_dir, lemmas)
    return Classifier.load(spark, model_dir)


# ---------------------------------------------------------------------------
# Versioned retraining (M18) and batch analysis
# ---------------------------------------------------------------------------

def active_model_dir(spark: SparkSession, root: str) -> str | None:
    """The model directory the registry pointer names (None before any training)."""
    version = ingest.current_version(spark, root)
    return None if version is None else f"{root}/v{version}"


def retrain(spark: SparkSession, root: str, labelled: DataFrame, grid=GRID, lemmas: DataFrame | None = None) -> str:
    """Train the grid into a new version directory, then move the pointer.
    A failed run leaves the previous version active."""
    version = ingest.next_version(spark, root)
    model_dir = f"{root}/v{version}"
    train_grid(prepare_split(labelled, lemmas), grid, model_dir, lemmas)
    ingest.publish_version(spark, root, version)
    return model_dir


def analyze_batch(spark: SparkSession, classifier: Classifier, items: DataFrame,
                  history_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Score every (id, text) item, append all scores to the history in one
    write, and return (predictions, summary). Empty texts are rejected first.

    ``position`` is the item's place in the input, 1 for the first item that is
    scored; ``prediction_time_ms`` is the batch's time per row, 0 where nothing
    is left of the text after cleaning."""
    from missive.operators.score import batch_summary, split_valid
    ok, _rejected = split_valid(items)
    ok = ingest.with_consecutive_ids(ok, "position")
    began = time.time()
    preds = classifier.score(ok).select("position", "id", "text", "is_spam", "spam_probability", "confidence_score",
                                        "model_name", "vectorizer_name", (F.col("clean_text") == "").alias("_empty"))
    preds = materialise(preds, "batch-predictions")
    elapsed_ms = (time.time() - began) * 1000.0   # this write is what scores the rows
    per_row = round(elapsed_ms / max(preds.count(), 1), 2)
    preds = preds.withColumn("prediction_time_ms", F.when(F.col("_empty"), 0.0).otherwise(per_row)).drop("_empty")
    if history_path:
        from missive.sources.history_store import append_scored
        append_scored(spark, history_path, preds, elapsed_ms=elapsed_ms)
    return preds, batch_summary(preds)
