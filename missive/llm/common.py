"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from missive.session import materialise

#: Words are runs of anything but ASCII white space (fixed value).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Largest number of rows of a narrow table that is broadcast.
BROADCAST_ROWS = 200_000
#: A group is heavy when it holds more than one row in this many.
HEAVY_ONE_IN = 1000
#: Rows per Arrow batch: bounds a Python worker's memory when texts are long.
ARROW_ROWS = 512


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def between(text: Column, separators: str) -> Column:
    """The non-empty pieces of a text between runs of separators (a far cheaper form than extracting matches)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators, -1), lambda w: w != "")


def words(text: Column) -> Column:
    """The ``WORD`` matches of a text; none for null."""
    return between(text, SPACE)


def n_words(text: Column) -> Column:
    """Number of ``WORD`` matches: blank-trimmed text has one word more than runs of white space."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, SPACE, -1))).cast("long")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts of any length."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def bounded(df: DataFrame, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a narrow table once and mark it for broadcast if its counted size allows.

    Above ``limit`` rows the plain table is returned and the join shuffles.
    """
    table = materialise(df, name)
    return F.broadcast(table) if table.count() <= limit else table


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with their group's row, safe for groups of any size.

    At most ``HEAVY_ONE_IN`` groups can hold more than ``total / HEAVY_ONE_IN``
    rows each, so the heavy ones are broadcast (a bound that does not depend
    on the data) and their rows never meet in one task. All other groups are
    small and join by shuffle. ``groups`` should be a written table.
    """
    heavy = F.col(size) * HEAVY_ONE_IN > F.lit(total)
    hot = groups.filter(heavy)
    cold = groups.filter(~heavy)
    return (rows.join(F.broadcast(hot), key)
            .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)))


def row_key(*cols: str) -> Column:
    """64-bit key of the columns a decision depends on; nulls are told apart from values."""
    parts = []
    for c in cols:
        parts += [quoted(c), quoted(c).isNull()]
    return F.xxhash64(*parts)


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever their names; ``select("__row.*")`` gives them back."""
    return F.struct(*[quoted(c) for c in docs.columns]).alias("__row")


def keep_rows(docs: DataFrame, keys: DataFrame, *cols: str, one_each: bool = False) -> DataFrame:
    """Rows of ``docs`` whose (cols) key occurs in ``keys.__key``; columns unchanged. With ``one_each`` one row of each key."""
    kept = docs.select(whole_row(docs), row_key(*cols).alias("__key")).join(keys.select("__key"), "__key", "left_semi")
    return (kept.dropDuplicates(["__key"]) if one_each else kept).select("__row.*")


#: A bitmap has 2**15 bits.
_BUCKET = 15
#: Bitmaps together hold at most this many bits: 2**29 are 64 MB, the bound of their broadcast.
MAX_BITS = 1 << 29
BITS_PER_ROW = 8


def bits_for(rows: int, max_bits: int = MAX_BITS) -> int:
    bits = 1 << _BUCKET
    while bits < BITS_PER_ROW * rows and bits < max_bits:
        bits *= 2
    return bits


def pack(cells: DataFrame) -> DataFrame:
    """Bitmaps (bucket, bits) with the bits at ``cell`` set."""
    return (cells.select(F.shiftright("cell", _BUCKET).alias("bucket"),
                         F.col("cell").bitwiseAND(F.lit((1 << _BUCKET) - 1)).alias("pos"))
            .repartition("bucket")  # bitmaps are built once, after the shuffle, not once in each task
            .groupBy("bucket").agg(F.bitmap_construct_agg("pos").alias("bits")))


def with_bit(rows: DataFrame, cell: Column, bitmaps: DataFrame, name: str) -> DataFrame:
    """Add boolean ``name``: whether the bit at ``cell`` is set. The bitmaps are broadcast."""
    side = bitmaps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    out = rows.withColumn("__cell", cell).join(F.broadcast(side), F.shiftright("__cell", _BUCKET) == F.col("__bucket"), "left")
    byte = "conv(hex(substring(__bits, cast((__cell & 32767) >> 3 as int) + 1, 1)), 16, 10)"
    hit = F.expr(f"coalesce(cast({byte} as int) & shiftleft(1, cast(__cell & 7 as int)), 0) <> 0")
    return out.withColumn(name, hit).drop("__cell", "__bucket", "__bits")


def bitmaps_of(hashes: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """Written bitmaps of a one-column table of hashes ``h``, and their size in bits."""
    bits = bits_for(rows)
    return materialise(pack(hashes.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("cell"))), "llm-bitmap"), bits


def in_bitmaps(rows: DataFrame, h: str, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Rows whose hash may be among the packed ones (all that are, and few others)."""
    return with_bit(rows, F.col(h).bitwiseAND(F.lit(bits - 1)), bitmaps, "__in").filter("__in").drop("__in")
