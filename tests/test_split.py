from pyspark.sql import functions as F

from missive.operators import split as SP


def test_allocation_matches_published_counts(spark):
    counts = spark.createDataFrame([("ham", 4816), ("spam", 747)], "label string, c long")
    got = {r["label"]: (r["n_train_c"], r["n_test_c"]) for r in SP.allocation(counts).collect()}
    assert got == {"ham": (3852, 964), "spam": (598, 149)}


def _frame(spark, n_ham, n_spam):
    rows = [(i, "ham") for i in range(n_ham)] + [(n_ham + i, "spam") for i in range(n_spam)]
    return spark.createDataFrame(rows, "doc_id long, label string")


def test_split_exact_disjoint_complete(spark):
    df = _frame(spark, 4816, 747)
    for digits, limit in ((1, None), (4, None), (1, 10)):   # limit 10 forces the second bucket level
        out = SP.stratified_split(df, bucket_digits=digits, rank_limit=limit)
        counts = {(r["label"], r["split"]): r["n"] for r in SP.split_counts(out).collect()}
        assert counts == {("ham", "train"): 3852, ("ham", "test"): 964,
                          ("spam", "train"): 598, ("spam", "test"): 149}
        assert out.select("doc_id").distinct().count() == 5563


def test_split_equals_rank_definition(spark):
    df = _frame(spark, 300, 57)
    a = SP.stratified_split(df, bucket_digits=1, rank_limit=5).select("doc_id", "split")
    a1 = SP.stratified_split(df, bucket_digits=1).select("doc_id", "split")
    assert sorted(a.collect()) == sorted(a1.collect())
    h = SP.hash_rank("doc_id")
    from pyspark.sql import Window
    alloc = SP.allocation(df.groupBy("label").agg(F.count(F.lit(1)).alias("c")))
    ranked = (df.withColumn("_h", h).join(alloc, "label")
              .withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("_h", "doc_id")))
              .select("doc_id", F.when(F.col("rn") <= F.col("n_test_c"), "test").otherwise("train").alias("split")))
    assert sorted(a.collect()) == sorted(ranked.collect())


def test_class_weights_balanced(spark):
    df = _frame(spark, 30, 10)
    w = {r["label"]: r["weight"] for r in SP.class_weights(df).collect()}
    assert abs(w["ham"] - 40 / 60) < 1e-12 and abs(w["spam"] - 40 / 20) < 1e-12
