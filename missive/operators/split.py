"""Exact stratified train/test split (M1) and balanced class weights (M2).

Each row gets a hash rank ``md5(seed ':' key)``; inside every class the
lowest-ranked ``n_test_c`` rows go to test. Class allocation follows the
largest-remainder rule for the train side first (test = the rest), so the
counts equal those of a stratified shuffle split of the same size.

Scale: no global sort and no unpartitioned window over the data. Rows are
bucketed by hash digits; only per-(class, bucket) counts (<= 16^digits rows
per class) are ranked, whole buckets are assigned by a broadcast lookup of
that bounded size, and only the (hash, key) pairs of a boundary bucket are
ordered one by one — a second bucket level is used when that bucket would exceed
``RANK_LIMIT`` rows (about n / 16^(2*digits) rows per class then).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42
DEFAULT_TEST_SIZE = 0.2


def hash_rank(key_col: str, seed: int = DEFAULT_SEED):
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key_col).cast("string")))


def allocation(class_counts: DataFrame, label_col: str = "label",
               test_size: float = DEFAULT_TEST_SIZE) -> DataFrame:
    """(label, c) -> (label, c, n_test_c, n_train_c). Input has one row per class."""
    tot = Window.partitionBy()  # over the tiny per-class table only
    n = F.sum("c").over(tot)
    df = class_counts.select(label_col, "c", n.alias("n"))
    df = df.withColumn("n_test", F.ceil(F.lit(float(test_size)) * F.col("n").cast("double")))
    df = df.withColumn("n_train", F.col("n") - F.col("n_test"))
    cont = F.col("c").cast("double") * F.col("n_train").cast("double") / F.col("n").cast("double")
    df = df.withColumn("_fl", F.floor(cont)).withColumn("_rem", cont - F.floor(cont))
    df = df.withColumn("_need", F.col("n_train") - F.sum("_fl").over(tot))
    df = df.withColumn("_rk", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(label_col).asc())))
    train_c = F.col("_fl") + F.when(F.col("_rk") <= F.col("_need"), F.lit(1)).otherwise(F.lit(0))
    return df.select(label_col, "c", (F.col("c") - train_c).cast("long").alias("n_test_c"),
                     train_c.cast("long").alias("n_train_c"))


RANK_LIMIT = 2_000_000   # rows one task may rank; a larger boundary bucket gets a second level


def _level_plan(counts: DataFrame, label_col: str, bucket_col: str, quota: DataFrame) -> DataFrame:
    """Per (class, bucket): rows before it in hash order, its size, and whether
    the whole bucket is test, train, or holds the class's test/train boundary.
    ``counts`` has <= 16^digits rows per class, so the window is small."""
    before = Window.partitionBy(label_col).orderBy(bucket_col).rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("_bb", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
            .join(quota, label_col)
            .withColumn("_mode", F.when(F.col("_bb") + F.col("_bc") <= F.col("_quota"), F.lit("test"))
                        .when(F.col("_bb") >= F.col("_quota"), F.lit("train"))
                        .otherwise(F.lit("boundary")))
            .select(label_col, bucket_col, "_bc", "_bb", "_quota", "_mode"))


def _local(plan: DataFrame) -> DataFrame:
    """Bring a bucket plan (<= 16^digits rows per class) to the driver once and
    re-create it as a local relation: its lineage (a full aggregation pass) is
    not recomputed by every later use, and the broadcast size is known."""
    return plan.sparkSession.createDataFrame(plan.collect(), plan.schema)


def _rank_boundary(rows: DataFrame, label_col: str, bucket_col: str, key_col: str) -> DataFrame:
    """Only (class, hash, key) is ranked: the last test row of each class is the cut (one row a class, brought
    to the driver), and every row is held against its class's cut where it lies."""
    in_bucket = Window.partitionBy(label_col, bucket_col).orderBy("_h", key_col)
    ranked = rows.select(label_col, bucket_col, "_h", key_col, "_bb", "_quota").withColumn("_rk", F.row_number().over(in_bucket))
    place = F.struct(F.col("_h"), F.col(key_col).alias("_k"))
    cuts = _local(ranked.filter(F.col("_bb") + F.col("_rk") <= F.col("_quota")).groupBy(label_col).agg(F.max(place).alias("_cut")))
    return (rows.join(F.broadcast(cuts), label_col, "left")
            .withColumn("split", F.when(F.col("_cut").isNotNull() & (place <= F.col("_cut")), F.lit("test")).otherwise(F.lit("train")))
            .drop("_cut"))


def stratified_split(df: DataFrame, label_col: str = "label", key_col: str = "doc_id",
                     test_size: float = DEFAULT_TEST_SIZE, seed: int = DEFAULT_SEED,
                     bucket_digits: int = 4, rank_limit: int | None = None) -> DataFrame:
    """Add ``split`` ('train' / 'test'). ``key_col`` must be unique.

    Level 1 buckets rows by the first ``bucket_digits`` hex digits of the hash;
    whole buckets are assigned from a broadcast plan (<= 16^d rows per class).
    The rows of each class's boundary bucket are ranked in one task when there
    are at most ``rank_limit`` of them; otherwise they are bucketed again on the
    next ``bucket_digits`` digits and only the level-2 boundary bucket (about
    n / 16^(2d) rows per class) is ranked.
    """
    d = bucket_digits
    limit = RANK_LIMIT if rank_limit is None else rank_limit
    hashed = (df.withColumn("_h", hash_rank(key_col, seed))
              .withColumn("_b1", F.conv(F.substring("_h", 1, d), 16, 10).cast("int"))
              .withColumn("_b2", F.conv(F.substring("_h", d + 1, d), 16, 10).cast("int")))
    counts1 = hashed.groupBy(label_col, "_b1").agg(F.count(F.lit(1)).alias("_bc"))
    alloc = allocation(counts1.groupBy(label_col).agg(F.sum("_bc").alias("c")), label_col, test_size)
    plan1 = _local(_level_plan(counts1, label_col, "_b1", alloc.select(label_col, F.col("n_test_c").alias("_quota"))))
    j1 = hashed.join(F.broadcast(plan1.drop("_bc")), [label_col, "_b1"])
    done1 = j1.filter(F.col("_mode") != "boundary").withColumn("split", F.col("_mode"))
    rest1 = j1.filter(F.col("_mode") == "boundary")
    helpers = ["_h", "_b1", "_b2", "_bb", "_quota", "_mode"]
    biggest = plan1.filter(F.col("_mode") == "boundary").agg(F.max("_bc")).first()[0] or 0   # local, tiny
    if biggest <= limit:
        return done1.drop(*helpers).unionByName(_rank_boundary(rest1, label_col, "_b1", key_col).drop(*helpers))

    quota2 = plan1.filter(F.col("_mode") == "boundary").select(   # test rows still due inside it
        label_col, (F.col("_quota") - F.col("_bb")).alias("_quota"))
    counts2 = rest1.groupBy(label_col, "_b2").agg(F.count(F.lit(1)).alias("_bc"))
    plan2 = _local(_level_plan(counts2, label_col, "_b2", quota2))
    j2 = rest1.drop("_bb", "_quota", "_mode").join(F.broadcast(plan2.drop("_bc")), [label_col, "_b2"])
    done2 = j2.filter(F.col("_mode") != "boundary").withColumn("split", F.col("_mode"))
    done3 = _rank_boundary(j2.filter(F.col("_mode") == "boundary"), label_col, "_b2", key_col)
    return done1.drop(*helpers).unionByName(done2.drop(*helpers)).unionByName(done3.drop(*helpers))


def split_counts(split_df: DataFrame, label_col: str = "label") -> DataFrame:
    return split_df.groupBy(label_col, "split").agg(F.count(F.lit(1)).alias("n"))


def class_weights(train: DataFrame, label_col: str = "label") -> DataFrame:
    """M2: balanced weight n / (k * n_c) per class of the training rows."""
    counts = train.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    tot = Window.partitionBy()  # per-class table: one row per class
    return counts.select(label_col, "n_c",
                         (F.sum("n_c").over(tot).cast("double")
                          / (F.count(F.lit(1)).over(tot) * F.col("n_c")).cast("double")).alias("weight"))


def with_class_weight(train: DataFrame, label_col: str = "label", weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight to every training row (broadcast: one row per class)."""
    w = class_weights(train, label_col).select(label_col, F.col("weight").alias(weight_col))
    return train.join(F.broadcast(w), label_col)
