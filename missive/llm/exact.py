"""Operator 8: exact dedup by two-pass Bloom filtering (native).

Pass 1 marks, for every text fingerprint, two cells of a filter and keeps the
cells that were marked twice: only cell numbers (8 bytes, summed before the
shuffle) move. The repeated cells become bitmaps of 32,768 bits, at most
``MAX_BITS`` in all (64 MB), which is the bound of the broadcast. Pass 2
looks every row up: a row with a cell outside the filter is the only one of
its text and passes straight through; the others, true repeats and the
filter's false positives, are shuffled and grouped by fingerprint. A fuller
filter only sends more rows through the shuffle; the result is always exact.

Defined cases: a null text counts as empty; an empty table gives an empty
result; a null ``doc_id`` ranks after all others and, if a group has no other,
is its ``keep_id``; of rows that repeat both text and ``doc_id`` exactly one is
kept; extra columns pass through ``drop_exact`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import MAX_BITS, SPACE, bits_for, join_groups, pack, whole_row, with_bit
from missive.session import materialise

def fingerprint(text: Column) -> Column:
    """SHA-256 (hex) of the text with runs of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), 256)


def _cells(sha: Column, bits: int) -> list[Column]:
    return [F.xxhash64(sha, F.lit(k)).bitwiseAND(F.lit(bits - 1)) for k in (1, 2)]


def repeated_filter(prints: DataFrame, rows: int, max_bits: int = MAX_BITS) -> tuple[DataFrame, int]:
    """Bitmaps of the cells that two or more fingerprints marked; and the filter's size in bits."""
    bits = bits_for(rows, max_bits)
    cells = prints.select(F.explode(F.array(*_cells(F.col("text_sha256"), bits))).alias("cell"))
    return materialise(pack(cells.groupBy("cell").count().filter("count >= 2")), "llm-exact-filter"), bits


def possibly_repeated(rows: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """Add ``__maybe``: both cells of ``text_sha256`` are in the filter."""
    out = rows
    for k, cell in enumerate(_cells(F.col("text_sha256"), bits)):
        out = with_bit(out, cell, bitmaps, f"__hit{k}")
    return out.withColumn("__maybe", F.col("__hit0") & F.col("__hit1")).drop("__hit0", "__hit1")


def _prepare(docs: DataFrame, doc_id: str, text: str, max_bits: int):
    prints = materialise(docs.select(docs[doc_id].alias("doc_id"), fingerprint(docs[text]).alias("text_sha256")),
                         "llm-exact-prints")
    total = prints.count()
    bitmaps, bits = repeated_filter(prints, total, max_bits)
    marked = possibly_repeated(prints, bitmaps, bits)
    copies = (marked.filter("__maybe").groupBy("text_sha256", "doc_id")
              .agg(F.count(F.lit(1)).alias("copies")))
    copies = materialise(copies, "llm-exact-copies")
    groups = materialise(copies.groupBy("text_sha256")
                         .agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"),
                              F.count(F.lit(1)).alias("members")), "llm-exact-groups")
    return total, bitmaps, bits, marked, copies, groups


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    total, _, _, marked, copies, groups = _prepare(docs, doc_id, text, max_bits)
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    single = (marked.filter(~F.col("__maybe"))
              .select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                      F.lit(True).alias("kept"), "text_sha256"))
    joined = join_groups(copies, groups, "text_sha256", "members", total)
    many = (joined.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__i") == 1)))
    return single.select(*cols).unionByName(many.select(*cols))


def drop_exact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               max_bits: int = MAX_BITS) -> DataFrame:
    """The rows that stay, with all their columns; only possibly repeated rows are shuffled."""
    _, bitmaps, bits, _, _, groups = _prepare(docs, doc_id, text, max_bits)
    marked = possibly_repeated(
        docs.select(whole_row(docs), docs[doc_id].alias("__id"),
                    fingerprint(docs[text]).alias("text_sha256")), bitmaps, bits)
    keepers = groups.select(F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"))
    stay = (marked.filter("__maybe")
            .join(keepers, (F.col("text_sha256") == F.col("__sha")) & F.col("__id").eqNullSafe(F.col("__keep")),
                  "left_semi")
            .dropDuplicates(["text_sha256", "__id"]))
    return (marked.filter(~F.col("__maybe")).select("__row")
            .unionByName(stay.select("__row")).select("__row.*"))
