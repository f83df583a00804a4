"""Quoted line breaks in files that several tasks read, against Python's csv module and Spark's one-task reader."""

import csv
import random

import pytest

from missive.sources import ingest, quoted

COLUMNS = ["c0", "c1", "c2", "_over"]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _field(rng, sep, brk):
    bodies = ["a" + brk + "b", 'x""y', "line" + brk + brk + "break" + sep + "sep", "é日" + brk + '""quoted""' + brk + "end", "q" + sep, '""', brk,
              "long " * 300 + brk + "z" * 900 + brk + 'tail""']
    pick = rng.random()
    if pick < 0.5:
        return rng.choice([f"plain {rng.randrange(99)}", 'it"s 5" pipe', "", '""'])
    return '"' + rng.choice(bodies) + '"'


def _write(path, rng, sep, eol, brk, n, header):
    with open(path, "w", newline="") as f:
        if header:
            f.write(eol + '"lab' + brk + 'el"' + sep + "text" + sep + "c" + eol)
        for i in range(n):
            f.write(sep.join([str(i)] + [_field(rng, sep, brk) for _ in range(rng.choice([2, 2, 2, 1, 0, 3]))]) + eol)
            if rng.random() < 0.05:
                f.write(eol)


def _by_csv_module(paths, sep, header):
    rows = []
    for p in paths:
        with open(p, newline="") as f:
            found = [r for r in csv.reader(f, delimiter=sep) if r]
        rows += [tuple((r + [""] * 4)[:4]) for r in found[1 if header else 0:]]
    return sorted(rows)


@pytest.mark.parametrize("sep,eol,brk,header", [(",", "\n", "\n", True), ("\t", "\n", "\r\n", False), (",", "\r\n", "\r\n", False),
                                                ("\t", "\r\n", "\n", True)])
def test_equal_to_the_csv_module(spark, small_splits, tmp_path, sep, eol, brk, header):
    rng = random.Random(sep + eol + brk)
    paths = [tmp_path / f"f{i}.csv" for i in range(3)]
    for p, n in zip(paths, (400, 1, 60)):
        _write(p, rng, sep, eol, brk, n, header)
    lines = quoted.scan_lines(spark, str(tmp_path))
    assert lines.filter(quoted.F.col("start") > 0).select("file", "start").distinct().count() > 20   # many tasks a file
    assert quoted.block_states(quoted.block_ends(lines, sep)).filter("inside").count() > 5           # borders inside quotes
    got = quoted.read_quoted(spark, str(tmp_path), sep, header, COLUMNS).collect()
    assert sorted(tuple(x or "" for x in r) for r in got) == _by_csv_module(paths, sep, header)


def test_equal_to_the_one_task_reader(spark, small_splits, tmp_path):
    rng = random.Random(9)
    _write(tmp_path / "a.csv", rng, ",", "\n", "\n", 300, True)
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    want = (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
            .option("mode", "PERMISSIVE").csv(str(tmp_path)))
    got = quoted.read_quoted(spark, str(tmp_path), ",", True, COLUMNS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))   # nulls and empty strings too


def test_one_record_over_many_blocks_and_an_open_end(spark, small_splits, tmp_path):
    body = "\n".join(f"line {i}" for i in range(2000))
    (tmp_path / "a.csv").write_text(f'1,"{body}"\n2,b\n3,"open\nend')
    got = quoted.read_quoted(spark, str(tmp_path), ",", False, COLUMNS[:2]).collect()
    assert sorted((r["c0"], r["c1"]) for r in got if r["c0"] != "3") == [("1", body), ("2", "b")]
    assert [r["c0"] for r in got if r["c0"] == "3"] == ["3"]


def test_empty_file_and_reader_options(spark, small_splits, tmp_path):
    (tmp_path / "a.tsv").write_text("")
    assert quoted.read_quoted(spark, str(tmp_path), "\t", True, COLUMNS).count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.csv").write_text('label,text\nspam,"two\nlines"\nham,one\nham,too,many\nspam\n')
    rows = ingest.read_labelled_raw(spark, str(tmp_path / "b")).collect()
    assert sorted((r["label"], r["text"] or "") for r in rows) == [("ham", "one"), ("spam", ""), ("spam", "two\nlines")]
    (tmp_path / "c.csv").write_text('text,id\n"a\nb",7\nplain,8\n')
    assert sorted(map(tuple, ingest.read_batch_input(spark, str(tmp_path / "c.csv")).collect())) == [("7", "a\nb"), ("8", "plain")]


@pytest.mark.parametrize("line,from_out,from_in", [
    ("a,b", False, True), ('"a', True, False), ('a"b,c', False, False), ('"a""b",c', False, True), ('x","y', True, True),
    ('","', False, True), ('"', True, False), ('""', False, True), ('"a"",b', True, False), ("", False, True), ('a,"b,c', True, False)])
def test_state_after_a_line(line, from_out, from_in):
    assert (quoted.ends_inside(line, ",", False), quoted.ends_inside(line, ",", True)) == (from_out, from_in)
