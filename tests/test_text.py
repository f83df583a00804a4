from pyspark.sql import functions as F

from missive.functions import text as T

STOPS = ("the", "is", "a", "are", "to", "at")

CASES = [
    (None, ""), ("", ""), ("   ", ""), ("the is a", ""),
    ("WIN $500 now!", "win moneytoken numbertoken now exclamationtoken"),
    ("<b>Hi</b><br/>there", "hi there"),
    ("see http://x.com/a?b=1 or www.y.org now", "see or now"),
    ("mail me@x.com today", "mail today"),
    ("don't stop", "dont stop"),
    ("3.5 kg", "numbertoken numbertoken kg"),
    ("a I x yes", "yes"),
    ("a١b", "numbertoken"),
    ("£2,000", "moneytoken numbertoken numbertoken"),
]


def test_clean_text_fixtures(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", T.clean_text(F.col("t"), STOPS).alias("c")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, (CASES[i], got[i])


def test_unicode_whitespace_splits(spark):
    df = spark.createDataFrame([("ab cd ef\x1cgh",)], "t string")
    assert df.select(T.clean_text(F.col("t"), ()).alias("c")).first()["c"] == "ab cd ef gh"


def test_label_standardise(spark):
    raw = ["1", "0", "1.0", "0.0", "YES", " no ", "True", "false", "positive", "negative", "Spam", "HAM",
           "maybe", "2", "", None, "\tspam\n"]
    df = spark.createDataFrame([(x,) for x in raw], "label string")
    out = [r["l"] for r in df.select(T.standardise_label(F.col("label")).alias("l")).collect()]
    valid = [x for x in out if x in ("spam", "ham")]
    assert valid.count("spam") == 7 and valid.count("ham") == 6
    assert out[12] == "maybe" and out[15] is None


def test_bigrams_and_vocab_tokens(spark):
    df = spark.createDataFrame([("ab cd ef",), ("x",), ("",), ("ab «cd»",)], "t string")
    rows = df.select(T.uni_and_bigrams(T.vocab_tokens(F.col("t"))).alias("g")).collect()
    assert rows[0]["g"] == ["ab", "cd", "ef", "ab cd", "cd ef"]
    assert rows[1]["g"] == [] and rows[2]["g"] == []
    assert rows[3]["g"] == ["ab", "cd", "ab cd"]


def test_trigger_highlight_and_matches(spark):
    df = spark.createDataFrame([("You WON a Gift Card! winners free-free",)], "t string")
    r = df.select(T.highlight_triggers(F.col("t")).alias("h"), T.trigger_matches(F.col("t")).alias("m")).first()
    assert r["h"] == "You <mark>WON</mark> a <mark>Gift Card</mark>! winners <mark>free</mark>-<mark>free</mark>"
    assert r["m"] == ["won", "gift card", "free", "free"]


def test_no_python_udf_in_cleaning(spark):
    df = spark.createDataFrame([("x",)], "t string").select(T.clean_text(F.col("t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
