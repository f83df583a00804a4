"""Training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from missive.llm import bpe, chat, exact, jaccard, langid, licenses, mixing, outliers, quality, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, key long, n int"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", 1, 2) for i, t, lang, src in rows], SCHEMA)


def sample_words(rng, n, size=60):
    return " ".join("w" + str(rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    rows = []
    for i in range(60):
        rows.append((i, sample_words(rng, rng.randrange(1, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])))
    base = sample_words(rng, 100, 5000).split()
    for i in range(60, 90):  # near copies, some of which link only through others
        w = list(base)
        for _ in range(i % 4):
            w[rng.randrange(100)] = f"edit{i}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(90, None, "en", "a"), (91, "", None, None), (92, " \n\t ", "en", "b"), (93, rows[60][1], "en", "b"),
             (94, "  " + rows[60][1].replace(" ", "\n"), "en", "b"), (95, "one two", "en", "a"), (96, "One two", "en", "a"),
             (97, sample_words(rng, 30000, 900), "en", "a"), (None, "one  two", "en", "a"), (5, rows[5][1], rows[5][2], rows[5][3])]
    return rows


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(spark, mixed):
    got = exact.exact_groups(docs_frame(spark, mixed)).collect()
    assert len(got) == len(mixed)
    groups = {}
    for i, t, *_ in mixed:
        groups.setdefault(hashlib.sha256(normal(t).encode()).hexdigest(), []).append(i)
    for r in got:
        ids = [x for x in groups[r.text_sha256] if x is not None]
        assert (r.keep_id, r.group_size) == (min(ids), len(groups[r.text_sha256]))
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)


@pytest.mark.parametrize("bits", [1 << 15, 1 << 29])
def test_drop_exact_keeps_one_of_each_and_all_columns(spark, mixed, bits):
    df = docs_frame(spark, mixed)
    got = exact.drop_exact(df, max_bits=bits)
    assert got.columns == df.columns
    texts = [normal(r.text) for r in got.collect()]
    assert sorted(texts) == sorted({normal(t) for _, t, *_ in mixed})


def test_exact_with_a_full_filter(spark):
    # far more texts than filter bits: everything is possibly repeated, the result stays exact
    df = spark.range(40000).select(F.col("id").alias("doc_id"), (F.col("id") % 39000).cast("string").alias("text"))
    got = exact.exact_groups(df, max_bits=1 << 15).agg(F.sum(F.col("kept").cast("int")), F.count("*"), F.max("group_size")).first()
    assert tuple(got) == (39000, 40000, 2)


def test_empty_tables(spark):
    df = docs_frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (exact.exact_groups(df), exact.drop_exact(df), mixing.mix_plan(df), mixing.mix(df), licenses.scan_licenses(df),
                outliers.quality_rules(df), bpe.bpe_digest(df), langid.identify_languages(df), quality.classify(df, labels),
                jaccard.jaccard_components(df), secrets.scan_secrets(df)):
        assert out.count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.chat_digest(chat.format_paths(chat.conversation_nodes(turns))).count() == 0


# ---- operator 9

def brute_components(rows):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    members = {}
    for a in range(len(rows)):
        members.setdefault(find(a), []).append(rows[a][0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted([(rows[a][0], len(sets[a]), name[find(a)]) for a in range(len(rows))], key=repr)


def test_jaccard_components(spark, mixed):
    got = [tuple(r) for r in jaccard.jaccard_components(docs_frame(spark, mixed)).collect()]
    assert sorted(got, key=repr) == brute_components(mixed)


def test_jaccard_chain_and_threshold(spark):
    # a ladder in which only neighbours link, and pairs exactly at, and just below, 0.8
    words = [f"x{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i:4 * i + 60]), "en", "a") for i in range(40)]
    at = [f"y{i}" for i in range(200)]
    rows += [(100, " ".join(at[:13]), "en", "a"), (101, " ".join(at[:12] + ["zz"]), "en", "a"), (102, " ".join(at[50:60]), "en", "a"),
             (103, " ".join(at[50:59]), "en", "a")]
    got = [tuple(r) for r in jaccard.jaccard_components(docs_frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute_components(rows)


def test_drop_near(spark, mixed):
    df = docs_frame(spark, mixed)
    got = jaccard.drop_near(df)
    assert got.columns == df.columns
    stay = {i for i, _, c in brute_components(mixed) if i == c}
    assert {r.doc_id for r in got.collect()} == stay


# ---- operator 10

def test_mixing_targets_and_sums(spark, mixed):
    df = docs_frame(spark, mixed)
    got = mixing.mix_plan(df).collect()
    sizes = {}
    for _, t, _, s in mixed:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, target, left = set(order), {}, 1.5 * sum(sizes.values())
    while True:  # reshare what exceeds the cap, until nothing does
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    source = {i: s for i, _, _, s in mixed}
    taken, largest = {}, {}
    assert len(got) == len(mixed)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    copies = Counter(r.doc_id for r in mixing.mix(df).collect())
    assert all(copies[r.doc_id] >= r.times for r in got) and sum(copies.values()) == sum(r.times for r in got)


# ---- operator 1

def test_escape_is_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", r"<\s><\\/s>[\INST][INST][[INST]]<s", "<<s>>", "", "a\\b", "[/INST]</s>\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    for r in got:
        assert r.u == r.t and not re.search(r"</?s>|\[/?INST\]", r.e)


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "hi </s>"), (1, 2, None, "x"), (1, 2, None, "x"), (None, 0, "assistant", "q"),
            (2, None, "assistant", "late"), (2, 0, "user", "é[INST]"), (2, 1, "assistant", "\n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.tree: r for r in chat.chat_digest(chat.format_paths(chat.conversation_nodes(df))).collect()}
    for conv in (1, None, 2):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join((r[2] or "") + "\n" + (r[3] or "") + "\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_reply_tree_paths(spark):
    #      1 -> 2 -> 4 -> 6 (score 1) ; 1 -> 3 -> 5 (score 3); 7 <-> 8 <- 9 is a ring; 10 answers itself
    nodes = [("t", 1, None, 0.0), ("t", 2, 1, 0.0), ("t", 3, 1, 2.0), ("t", 4, 2, 0.0), ("t", 5, 3, 1.0), ("t", 6, 4, 1.0),
             ("r", 7, 8, 0.0), ("r", 8, 7, 0.0), ("r", 9, 8, 5.0), ("s", 10, 10, 0.0), ("s", 11, 99, 0.5)]
    df = spark.createDataFrame([(*n, "user", str(n[1])) for n in nodes],
                               "tree string, node long, parent long, score double, role string, text string")
    paths = {}
    for r in chat.reply_paths(df, None).collect():
        paths.setdefault((r.tree, r.leaf), {})[r.place] = r.node
    shown = {k: [v[i] for i in sorted(v)] for k, v in paths.items()}
    assert shown == {("t", 6): [1, 2, 4, 6], ("t", 5): [1, 3, 5], ("r", 9): [7, 8, 9], ("s", 10): [10], ("s", 11): [11]}
    best = chat.format_paths(df, 1).collect()
    assert {(r.tree, r.leaf) for r in best} == {("t", 5), ("r", 9), ("s", 11)}
    assert next(r for r in best if r.tree == "t").formatted == "".join(f"<s>[INST]user[/INST]{i}</s>" for i in (1, 3, 5))


# ---- operator 2

def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"].split()
    edited = mit[:10] + ["really"] + mit[10:30] + mit[31:]
    texts = ["CC-BY cc by, cc... by\ncc by cc", "the General Public\nLicense. All rights reserved all rights all rights reserved", None, "",
             "word", "cc", "by cc", "ÉCC by", "x " * 30000 + "all rights reserved", " ".join(mit), "Foo " + " ".join(edited) + " bar",
             " ".join(mit[:20]), "general public licens", "cc by " * 50]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(3, "cc by", "en", "a"), (None, "cc by", "en", "a")]
    got = licenses.scan_licenses(docs_frame(spark, rows)).collect()
    want = Counter((i, *brute_license(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id > 3}
    assert "mit" in by[9].labels.split(",") and "mit" in by[10].labels.split(",") and by[11].labels == ""
    assert by[9].score == 1.0 and 0.8 <= by[10].score < 1 and 0 < by[11].score < 0.8
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_license_notices_and_later_parts(spark):
    import pathlib
    whole = lambda name: (pathlib.Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_text().split()
    texts = [("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("Released under the MIT License.", "mit"),
             ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
             ("It is under the GNU GPL, version 2", "gpl"), (" ".join(whole("mit")[-78:]), "mit"),  # the disclaimer alone
             ("foo bar " + " ".join(whole("apache-2.0")[600:760]) + " baz", "apache-2.0"),
             (" ".join(whole("mpl-2.0")[1000:1150]), "mpl-2.0"), (" ".join(whole("gpl-3.0")[-400:-250]), "gpl"),
             ("the mit press; a license of apache county, version 2.0 of the licence", ""), (" ".join(whole("gpl-2.0")[900:920]), "")]
    got = {r.doc_id: r for r in licenses.scan_licenses(docs_frame(spark, [(i, t, "en", "a") for i, (t, _) in enumerate(texts)])).collect()}
    for i, (t, want) in enumerate(texts):
        found = set(filter(None, got[i].labels.split(",")))
        assert (want in found) if want else not found, (t, found)


def test_license_lines_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"apache-2.0": "Licensed under the Apache License, Version 2.0", "mit": "Released under the MIT License"}
    rows = [(i, r.text) for i, r in enumerate(docs.select("text").collect())]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert any(line in (t or "") for line in lines.values() for _, t in rows)
    for r in got:
        for label, line in lines.items():
            assert (label in r.labels.split(",")) == (line in (rows[r.doc_id][1] or "")), r


# ---- operator 6

def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    covered = {j for i, x in enumerate(windows) if often[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality_stats_match_brute_force(spark, mixed):
    texts = [t for _, t, *_ in mixed] + ["a b c a b c a b", "x\nx\n\n \nx y\nx", "a a a a", "#*$ %&|<> é", "a\r\nb\r\nb", "one two three"]
    df = docs_frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    for r in outliers.quality_rules(df).collect():
        want = brute_stats(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_mcd_resists_outliers(spark):
    rng = np.random.default_rng(3)
    good = rng.normal([6, 5, 0.1, 0.2], [0.5, 0.6, 0.1, 0.3], (800, 4))
    bad = rng.normal([9, 11, 0.9, 3.0], 0.05, (150, 4))  # a tight clump that would drag a plain mean
    rows = [("g", "s", *map(float, x)) for x in np.concatenate([good, bad])]
    df = spark.createDataFrame(rows, "glang string, gsource string, x0 double, x1 double, x2 double, x3 double")
    est = outliers.mcd(df)
    assert abs(est.first()["m_x1"] - 5) < 0.2
    d2 = np.array([r.d2 for r in outliers._distance(df, est).orderBy("x1").select("x1", "d2").collect()])
    assert (d2[-150:] > outliers.CUTOFF).all() and (d2[:800] > outliers.CUTOFF).mean() < 0.01


def test_mcd_resists_groups_of_copies(spark):
    rng = np.random.default_rng(4)
    copy, rows = [5.5, 6.0, 0.6, 0.1], []
    for share in (0.2, 1 / 3, 0.4):
        good = rng.normal([5.5, 4.7, 0.02, 0.1], [0.5, 0.3, 0.03, 0.1], (600, 4))
        rows += [("g", f"{share:.2f}", *map(float, x)) for x in [*good, *[copy] * round(600 * share / (1 - share))]]
    df = spark.createDataFrame(rows, "glang string, gsource string, x0 double, x1 double, x2 double, x3 double")
    judged = outliers._distance(df, outliers.mcd(df)).select("gsource", "x0", "x2", "d2").collect()
    assert len(judged) == len(rows)
    for r in judged:
        assert (r.d2 > outliers.CUTOFF) == ((r.x0, r.x2) == (copy[0], copy[2])), r


# ---- operator 5

@pytest.fixture(scope="module")
def library():
    with open(bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_tree_equals_library(library):
    own = bpe.Codec(bpe.default_ranks(), leaf_chars=16, leaf_bytes=6)  # small leaves: many joins
    rng = random.Random(1)
    parts = ["the", "a", "é", "  ", "\n", "\t", "'s", "'", "'re", "don't", "123", "!!", "...", "你好", "👍", " ", "Z", "́", "_", "%"]
    for _ in range(1500):
        t = "".join(rng.choice(parts[:rng.randint(1, len(parts))]) for _ in range(rng.randint(0, 120)))
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    for t in ("a" * 3000, "ab" * 2000, " " * 2000 + "x", "你" * 900, "".join(rng.choice("abcdefgh") for _ in range(4000))):
        assert own.encode(t) == library.encode_ordinary(t)


def test_bpe_query(spark, mixed, library):
    df = docs_frame(spark, mixed)
    texts = Counter((i, t or "") for i, t, *_ in mixed)
    want = Counter()
    for (i, t), n in texts.items():
        ids = library.encode_ordinary(t)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += n
    assert Counter(tuple(r) for r in bpe.bpe_digest(df).collect()) == want
    decoded = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in decoded) == texts


# ---- operators 3, 4, 7

def tables(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")


def test_language_id_accuracy(spark):
    docs = tables(spark, "documents")
    extra = spark.createDataFrame([(10**6, None, "en", "a", 0), (10**6 + 1, "12 !?", "fr", "a", 0), (10**6 + 2, "", None, "a", 0)], docs.schema)
    got = langid.identify_languages(docs.unionByName(extra))
    odd = got.filter("doc_id >= 1000000").collect()
    assert [(r.lang_pred, r.score) for r in odd] == [("und", 0.0)] * 3
    held = got.filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0
    assert got.filter("score < 0 or score > 1").isEmpty()


def test_language_id_ignores_labels_of_predicted_rows(spark):
    docs = tables(spark, "documents")
    spoilt = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a = langid.identify_languages(docs).select("doc_id", "lang_pred")
    b = langid.identify_languages(spoilt).select("doc_id", "lang_pred")
    assert a.exceptAll(b).isEmpty()


def test_kneser_ney_is_a_distribution_and_matches_brute_force(spark):
    texts = ["abracadabra", "abra", "cabbage bar", "a" * 30, "dab"]
    df = spark.createDataFrame([(t, True) for t in texts] + [("xyz abra", False)], "text string, trusted boolean")
    grams = quality.gram_counts(df).collect()
    want, seen = Counter(), set()
    for t in [*texts, "xyz abra"]:
        p = "\0" * 4 + t
        for i in range(len(t)):
            seen.add(p[i:i + 5])
            want[p[i:i + 5]] += t != "xyz abra"
    assert {r.gram: r.n for r in grams} == {k: want[k] for k in seen}
    # all continuations of one context: their probabilities add up to one
    every = spark.createDataFrame([("\0abr" + chr(i), 0) for i in range(quality.ALPHABET)], "gram string, n long")
    counted = spark.createDataFrame(grams)
    both = every.unionByName(counted).groupBy("gram").agg(F.sum("n").alias("n"))
    total = quality.log_probabilities(both).filter(F.substring("gram", 1, 4) == "\0abr")
    assert total.agg(F.sum(F.pow(F.lit(2.0), -F.col("units") / quality.UNITS))).first()[0] == pytest.approx(1.0, abs=1e-3)


def plain_kneser_ney(trusted, others):
    """Bits of each text's characters by an interpolated modified Kneser-Ney model in plain Python."""
    fold = lambda t: "".join(" " if "\t" <= c <= "\r" else max(c, "\1") for c in t.lower())
    grams = lambda t: [("\0" * 4 + t)[i:i + 5] for i in range(len(t))]
    counts = {5: Counter(g for t in trusted for g in grams(fold(t)))}
    wanted = {g for t in [*trusted, *others] for g in grams(fold(t))}
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    alphabet = max(quality.ALPHABET, len({g[4] for g in wanted}))
    cuts, totals, freed = {}, {}, {}
    for n, c in counts.items():
        n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
        d = (0.5, 0.75, 0.9)
        if n1 and n2 and n3 and n4:
            y = n1 / (n1 + 2 * n2)
            d = tuple(min(max(i - (i + 1) * y * more / few, 0.05), i - 0.05)
                      for i, few, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        cuts[n], totals[n], freed[n] = d, Counter(), Counter()
        for g, v in c.items():
            totals[n][g[:-1]] += v
            freed[n][g[:-1]] += d[min(v, 3) - 1]

    def p(g):
        low = p(g[1:]) if len(g) > 1 else 1.0 / alphabet
        n, v = len(g), counts[len(g)][g]
        if not totals[n][g[:-1]]:
            return low
        own = v - cuts[n][min(v, 3) - 1] if v else 0.0
        return (own + freed[n][g[:-1]] * low) / totals[n][g[:-1]]

    return [sum(-math.log2(p(g)) for g in grams(fold(t))) for t in others]


def test_kneser_ney_bits_match_brute_force_in_every_script(spark):
    rng = random.Random(7)
    soup = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hira, kata = "あいうえおかきくけこさしすせそ", "アイウエオカキクケコサシスセソ"
    geo, hangul, emoji = "აბგდევზთიკ", "가나다라마바사아자차", "😀😁😂🤣"
    trusted = [soup(hira, 300), soup("abc de", 500), soup(geo, 200), "Tab\tand\nline Éa", soup(hangul, 100), "abra\0cadabra"]
    others = [soup(hira, 80), soup(kata, 80), soup(geo, 50), soup(hangul, 50) + emoji, soup("abc de", 99), "zzz\t\tÉ", "x", trusted[0]]
    df = spark.createDataFrame([(t, True) for t in trusted] + [(t, False) for t in others], "text string, trusted boolean")
    bits = quality.log_probabilities(quality.gram_counts(df.repartition(3)))
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(others)], "doc_id long, __key long, text string")
    want = plain_kneser_ney(trusted, others)
    for shard in (1 << 20, 100):
        got = {r.doc_id: (r.total_bits, r.n_grams) for r in quality.score_texts(rows, bits, shard).collect()}
        for i, t in enumerate(others):
            assert got[i][1] == len(t) and got[i][0] == pytest.approx(want[i], abs=len(t) / quality.UNITS)
    assert want[1] > want[0] + 80   # katakana is not taken for the hiragana that the model knows


def test_quality_classifier(spark):
    docs, labels = tables(spark, "documents"), tables(spark, "labels")
    odd = spark.createDataFrame([(10**6, None, "en", "a", 0), (10**6 + 1, "", "en", "a", 0), (10**6 + 2, "%%% $$$ ### " * 200, "en", "a", 0)],
                                docs.schema)
    got = quality.classify(docs.unionByName(odd), labels)
    assert got.filter("doc_id >= 1000000 and kept").isEmpty() and got.count() == docs.count() + 3
    judged = got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in judged}
    assert kept[1] >= 0.97 and kept[0] < 0.6
    one = {r.doc_id: r.bits for r in got.collect()}
    many = {r.doc_id: r.bits for r in quality.classify(docs.unionByName(odd), labels, shard=20000).collect()}  # several shards
    assert one == many
    twice = quality.classify(docs.unionByName(docs), labels, shard=20000)  # repeated rows stay apart
    assert twice.count() == 2 * docs.count()
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_secret_scan(spark):
    rng = random.Random(2)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(200):
        body = " ".join(rng.choice(["internationalisation", "the", "counterrevolutionary", "words", "and", "misunderstandings"]) for _ in range(40))
        secret = [f"password={hexes(18)}", f'token = "{hexes(40)}"', "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16))][i % 3]
        rows.append((i, f"{body} {secret} {body}" if i % 2 else body, "en", "a"))
    rows += [(500, None, "en", "a"), (501, "", "en", "a")]
    got = {r.doc_id: r for r in secrets.scan_secrets(docs_frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(200):
        assert got[i].n_secrets == i % 2, rows[i]
    assert got[500].n_candidates == got[501].n_candidates == 0


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name != "encode":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[5] == sizes[4] > 0
    assert corpus_pipeline.run(spark, sf).count() == sizes[5]
