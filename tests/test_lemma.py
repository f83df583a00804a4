from missive.functions.lemma import build_lexicon, lemmatize


def test_lemma_fixtures(spark):
    df = spark.createDataFrame(
        [(1, ["prizes", "boxes", "churches", "parties", "women", "mice", "gas", "zzz"]), (2, [])],
        "id long, tokens array<string>")
    lex = spark.createDataFrame([(w,) for w in ["prize", "box", "church", "party", "woman", "mouse", "gas"]], "lemma string")
    exc = spark.createDataFrame([("mice", "mouse")], "form string, lemma string")
    got = {r["id"]: r["lemmas"] for r in lemmatize(df, "tokens", "lemmas", lex, exc, key_col="id").collect()}
    assert got[1] == ["prize", "box", "church", "party", "woman", "mouse", "gas", "zzz"]
    assert got[2] == []


def test_default_lexicon_document_frequency(spark):
    df = spark.createDataFrame([(1, ["cat", "cats", "cats"]), (2, ["cat", "dog"])], "id long, tokens array<string>")
    assert sorted(r["lemma"] for r in build_lexicon(df, "tokens").collect()) == ["cat"]
    got = {r["id"]: r["lemmas"] for r in lemmatize(df, key_col="id").collect()}
    assert got == {1: ["cat", "cat", "cat"], 2: ["cat", "dog"]}


def test_salted_join_equals_broadcast(spark, monkeypatch):
    import missive.functions.lemma as L
    rows = [(i, ["cats"] * 30 + ["dogs", "mice", "zzz"]) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    lex = spark.createDataFrame([("cat",), ("dog",)], "lemma string")
    a = {r["id"]: r["lemmas"] for r in L.lemmatize(df, lexicon=lex, key_col="id").collect()}
    monkeypatch.setattr(L, "MAX_BROADCAST_LEMMAS", 0)
    b = {r["id"]: r["lemmas"] for r in L.lemmatize(df, lexicon=lex, key_col="id").collect()}
    assert a == b and a[0][:2] == ["cat", "cat"] and a[0][-3:] == ["dog", "mice", "zzz"]
