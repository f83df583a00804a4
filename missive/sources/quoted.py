"""Delimited files with quoted line breaks, read by many tasks a file.

Spark's ``multiLine`` reader gives each file to one task, because a line break
may stand inside a quoted field and only the file's beginning tells. Here the
lines are scanned with the usual splits, twice:

1. Every block (a task's piece of a file) says how its lines turn "the block
   begins outside quotes" and "it begins inside" into the state at its end.
   These functions of one bit are composed over the blocks of each file by a
   window over one row a block, which gives the state in which each block begins.
2. With that state, a task cuts its lines into records at true line ends. A
   record that crosses a block's border leaves a fragment on each side; only
   fragments are shuffled and joined.

Records are parsed by Spark's own CSV expression, with the same options as the
line reader, so values, nulls and short or long rows come out as there.

Quotes follow RFC 4180: a field is quoted if it begins with a quote, and quotes
in it are doubled; quotes inside an unquoted field are plain characters. The
files must end their lines with LF or CRLF (not CR alone), in UTF-8.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.session import materialise

QUOTE = '"'
#: Lines that a task holds as Python strings at a time.
LINES = 500


def ends_inside(line: str, sep: str, inside: bool) -> bool:
    """Whether the end of a line is inside a quoted field, given its beginning."""
    for piece in line.split(sep):
        if (inside or piece.startswith(QUOTE)) and piece.count(QUOTE) % 2:
            inside = not inside
    return inside


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, start: the lines in file order within each block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def block_ends(lines: DataFrame, sep: str) -> DataFrame:
    """file, start, from_out, from_in: the state at the end of each block for both states at its beginning."""
    def ends(batches):
        states: dict = {}
        for batch in batches:
            value = batch.column(0)
            for key in set(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                states.setdefault(key, (False, True))
            quoted = pc.match_substring(value, QUOTE)   # other lines leave the state as it is
            for line, file, start in zip(*(pc.filter(c, quoted).to_pylist() for c in batch.columns)):
                states[file, start] = tuple(ends_inside(line, sep, s) for s in states[file, start])
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in states], pa.int64()), pa.array([k[1] for k in states], pa.int64()),
             pa.array([s[0] for s in states.values()], pa.bool_()), pa.array([s[1] for s in states.values()], pa.bool_())],
            ["file", "start", "from_out", "from_in"])

    return lines.mapInArrow(ends, "file long, start long, from_out boolean, from_in boolean")


def block_states(blocks: DataFrame) -> DataFrame:
    """file, start, inside, ends_inside: the true states at the beginning and the end of each block.

    A block either sets the state (both beginnings end alike) or keeps or flips
    it. So the state is that of the last block that set it, flipped as often as
    blocks have flipped since; before any of those it counts from outside."""
    after = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    flips = F.when((F.col("from_out") != F.col("from_in")) & F.col("from_out"), 1).otherwise(0)
    sets = F.col("from_out") == F.col("from_in")
    marked = blocks.withColumn("flips", F.sum(flips).over(after))
    # the value a setting block leaves, with all flips up to it taken off again
    base = F.when(sets, (F.col("from_out").cast("int") + F.col("flips")) % 2)
    ends = marked.withColumn("ends_inside", (F.coalesce(F.last(base, ignorenulls=True).over(after), F.lit(0)) + F.col("flips")) % 2 == 1)
    return ends.withColumn("inside", F.coalesce(F.lag("ends_inside").over(Window.partitionBy("file").orderBy("start")), F.lit(False))) \
        .select("file", "start", "inside", "ends_inside")


def _cut(sep: str, fragments: bool):
    """Cut the lines of blocks into whole records, or into the fragments at their borders.

    kind 0: the rest of a record that began in an earlier block; 1: a whole record; 2: the beginning of one that goes on."""
    def cut(batches):
        key, inside, first, parts, tail = None, False, True, [], False

        def rest():   # lines left at a block's end belong to a record that goes on
            return [(*key, 0 if tail else 2, first, "\n".join(parts))] if parts else []

        for batch in (b.slice(i, LINES) for b in batches for i in range(0, b.num_rows, LINES)):
            out = []
            value, files, starts, begin = (batch.column(i).to_pylist() for i in range(4))
            for line, file, start, begins_inside in zip(value, files, starts, begin):
                if (file, start) != key:
                    out += rest()
                    key, inside, first, parts, tail = (file, start), begins_inside, start == 0, [], begins_inside
                if QUOTE in line:
                    inside = ends_inside(line, sep, inside)
                parts.append(line)
                if not inside:
                    out.append((*key, 0 if tail else 1, first, "\n".join(parts)))
                    first = first and out[-1][-1] in ("", "\r")   # empty lines do not count
                    parts, tail = [], False
            yield _rows([r for r in out if (r[2] != 1) == fragments])
        yield _rows([r for r in rest() if fragments])

    return cut


def _rows(rows: list) -> pa.RecordBatch:
    names = ["file", "start", "kind", "first", "record"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """first, record: the records of the files at ``path``; ``first`` marks the first record of a file."""
    lines = scan_lines(spark, path)
    blocks = materialise(block_states(block_ends(lines, sep)), "csv-blocks")   # one row a block
    # both passes must see the same splits: a block that the first did not see stops the job
    known = F.when(F.col("inside").isNull(), F.raise_error(F.lit("the splits of the files changed between two passes"))) \
        .otherwise(F.col("inside"))
    schema = "file long, start long, kind int, first boolean, record string"
    whole = (lines.join(F.broadcast(blocks.select("file", "start", "inside")), ["file", "start"], "left")   # 17 bytes a block
             .select("value", "file", "start", known.alias("inside")).mapInArrow(_cut(sep, False), schema))
    crossing = blocks.filter("inside OR ends_inside").select("file", "start", "inside")
    pieces = (lines.join(F.broadcast(crossing), ["file", "start"]).select("value", "file", "start", "inside")
              .mapInArrow(_cut(sep, True), schema))
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = (pieces.withColumn("begun", F.sum((F.col("kind") == 2).cast("int")).over(order))
              .groupBy("file", "begun")
              .agg(F.min_by("first", F.struct("start", "kind")).alias("first"), F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
              .select("first", F.array_join(F.col("parts.record"), "\n").alias("record")))   # the parts of one record
    return whole.select("first", "record").unionByName(joined)


def read_quoted(spark: SparkSession, path: str, sep: str, header: bool, columns: list[str]) -> DataFrame:
    """The named columns, all strings, of delimited files with quoted line breaks; empty lines are skipped."""
    records = read_records(spark, path, sep)
    if header:
        records = records.filter(~F.col("first"))
    # the carriage return of a CRLF line end; those inside quotes stay
    record = F.regexp_replace("record", "\r$", "")
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    options = {"sep": sep, "quote": QUOTE, "escape": QUOTE, "mode": "PERMISSIVE", "multiLine": "true", "lineSep": "\n"}
    return (records.select(record.alias("record")).filter("record <> ''")
            .select(F.from_csv("record", schema, options).alias("r")).select("r.*"))
