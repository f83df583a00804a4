"""Texts and a table of words brought together without shuffling every occurrence.

A join of token occurrences with a table of words moves each occurrence twice,
with whatever the table holds for its word. Here rows are dealt to parts of
about ``PART_WORDS`` words; a part takes each of its different words from the
table once, and its rows are looked up in the task that holds both. Parts are
many and small, so a task's memory does not follow the input, and a word that
holds a third of all occurrences is one row a part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from missive.session import materialise

#: Words (and rows) of a part: what a task holds at a time.
PART_WORDS = 200_000


def written(df: DataFrame, words: Column, name: str, key: Column | None = None) -> tuple[DataFrame, Callable[[], int]]:
    """``df`` with its words (``_words``) and a place that stays (``_at``), written once; and how many words and rows there are.

    Rows are placed by number, so copies and repeated or missing keys spread like any other rows; with a
    ``key``, rows of one key share a place."""
    at = F.xxhash64(F.monotonically_increasing_id() if key is None else key)
    rows = materialise(df.withColumn("_words", words).withColumn("_at", at), name)
    return rows, lambda: rows.agg(F.sum(F.coalesce(F.greatest(F.size("_words"), F.lit(0)), F.lit(0)) + 1).alias("n")).first()["n"] or 0


def in_parts(rows: DataFrame, parts: int) -> DataFrame:
    """Written rows with their part (``_part``)."""
    return rows.withColumn("_part", F.pmod("_at", F.lit(parts)).cast("int"))


def dealt(df: DataFrame, words: Column, name: str, key: Column | None = None, part_words: int | None = None) -> tuple[DataFrame, int]:
    """``df`` written and in parts of about ``part_words`` words (by default ``PART_WORDS``); and the number of parts."""
    rows, load = written(df, words, name, key)
    parts = max(1, math.ceil(load() / (part_words or PART_WORDS)))
    return in_parts(rows, parts), parts


def by_part(rows: DataFrame, parts: int):
    """``rows`` grouped by part, in as many tasks as parts (merged ones would keep cores idle)."""
    return rows.repartition(parts, "_part").groupBy("_part")


def look_up(rows: DataFrame, parts: int, table: DataFrame, task: Callable[[pa.Table, pa.Table], pa.Table], schema: T_.StructType) -> DataFrame:
    """``task(rows, entries)`` for every part: its dealt rows and the rows of ``table`` (``word``, ...) for its different words."""
    need = rows.select(F.col("_part").alias("_of"), F.explode(F.array_distinct("_words")).alias("word")).distinct()
    found = need.join(table, "word")
    return by_part(rows, parts).cogroup(found.repartition(parts, "_of").groupBy("_of")).applyInArrow(task, schema)


def flat_words(rows: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """All words of a part's rows, and how many each row has."""
    words = rows["_words"].combine_chunks()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    return words.flatten(), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def joined(column: pa.Array | pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    """A table's column as one array of a type."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return pa.concat_arrays([c.cast(kind) for c in chunks]) if chunks else pa.array([], kind)


def places(words: pa.Array, entries: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Of each word its place among the entries, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=joined(entries, words.type)), -1).to_numpy(zero_copy_only=False)


def matrix(column: pa.ChunkedArray, size: int, dtype=np.float64) -> np.ndarray:
    """A column of number lists of one length as a matrix."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).astype(dtype, copy=False).reshape(-1, size) if flat else np.zeros((0, size), dtype)


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    rows, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(size)), pa.array(values.reshape(-1)))
