"""The corpus pipeline against plain Python, row by row: repeated and null ids, nulls, clashing names, empty stages."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from missive.llm import exact, jaccard, mixing, quality
from tests.llm.test_operators import brute_components, normal

#: Columns that stages use inside, and names that need quoting.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __key long, __row string, `a.b` int, own string, hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 7, "r", k, "o", "h") for k, (i, t, g, s) in enumerate(rows)], SCHEMA)


def of(df):
    """(doc_id, text, lang, source) and the unique number of each row."""
    return [((r["doc_id"], r["text"], r["lang"], r["source"]), r["a.b"]) for r in df.collect()]


def plain_exact(rows):
    best = {}
    for r, k in rows:
        at = best.setdefault(normal(r[1]), [])
        at.append((r[0] is None, r[0] or 0))
    return Counter((min(v), t) for t, v in best.items())


def mixture(rows):
    """How often each row is taken, by sorting."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    of_source = {}
    for r, n in zip(rows, size):
        of_source[r[3]] = of_source.get(r[3], 0) + n
    names = sorted(of_source, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), 1.5 * sum(size), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * of_source[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * of_source[s]
            left -= target[s]
        free -= over
    times = [0] * len(rows)
    for s in names:
        own = [k for k, r in enumerate(rows) if r[3] == s]
        copies = int(target[s] // of_source[s]) if of_source[s] else 0
        need = target[s] - copies * of_source[s]
        digest = {k: hashlib.md5(f"mix-1:{'' if rows[k][0] is None else rows[k][0]}:{rows[k][1] or ''}".encode()).hexdigest()[:15] for k in own}
        at, sums = None, {}
        for k in own:
            sums[digest[k]] = sums.get(digest[k], 0) + size[k]
        run = 0
        for d in sorted(sums):   # the hash at which the running sum passes the need
            if need > 0 and run <= need < run + sums[d]:
                at = (d, run + sums[d] - need < need - run)
            run += sums[d]
        for k in own:
            times[k] = copies + (at is not None and (digest[k] < at[0] or (digest[k] == at[0] and at[1])))
    return times


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = ["river", "stone", "meadow", "light", "winter", "garden", "silver", "morning", "forest", "bridge", "harbor", "valley"]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", "s", "ly"]) for _ in range(n))

    rows = [(i, prose(rng.randrange(20, 120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None])) for i in range(120)]
    base = prose(80).split()
    for i in range(200, 215):   # near copies under own, shared and null ids
        w = list(base)
        w[rng.randrange(80)] = f"edit{i}"
        rows.append((rng.choice([i, 5, None]), " ".join(w), "en", "a"))
    rows += [(7, rows[30][1], "en", "b"), (7, rows[30][1], "en", "b"), (300, "  " + rows[30][1].replace(" ", "\n"), "fr", "c"),
             (301, None, "en", "a"), (302, "", None, None), (303, " \n", "en", "b"), (None, prose(40), None, None), (None, prose(40), "en", "a"),
             (304, prose(5000), "en", "c")]
    rows += [(400 + i, " ".join(rng.choice("zqxjkw") * rng.randrange(2, 9) for _ in range(60)), "en", "a") for i in range(8)]
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(400, 0, 0), (None, 1, 0)]
    return rows, labels


def test_run_matches_plain_python_stage_by_stage(spark, corpus, library, tmp_path):
    rows, labels = corpus
    sf = str(tmp_path)
    frame(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{sf}/documents.parquet")
    assert list(stages) == ["quality", "exact", "near", "mix", "encode"]
    columns, kept = docs.columns, {}
    for name in ("quality", "exact", "near", "mix"):
        out = stages[name](spark, docs, sf)
        assert out.columns == columns
        out.write.parquet(f"{sf}/{name}")
        kept[name] = of(spark.read.parquet(f"{sf}/{name}"))
        docs = spark.read.parquet(f"{sf}/{name}")

    # quality: exactly the rows that the classifier keeps, each once
    judged = quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    good = Counter((r["doc_id"], r["lang"], r["bits"]) for r in judged.filter("kept").collect())
    assert len(kept["quality"]) == sum(good.values()) and len({k for _, k in kept["quality"]}) == len(kept["quality"])
    assert Counter((r[0], r[2]) for r, _ in kept["quality"]) == Counter((i, g) for i, g, _ in good.elements())
    assert not {400 + i for i in range(1, 8)} & {r[0] for r, _ in kept["quality"]}   # letter soup goes
    assert {r[0] for r, _ in kept["quality"]} >= {i for i in range(0, 120) if i % 2}    # unlabelled prose stays

    # exact: one row of each text, that of its smallest id
    assert Counter(((r[0] is None, r[0] or 0), normal(r[1])) for r, _ in kept["exact"]) == plain_exact(kept["quality"])

    # near: one row of each component, that of its smallest id; chains included
    before = [r for r, _ in kept["exact"]]
    numbered = [(k, r[1]) for k, r in enumerate(before)]
    groups = {}
    for k, n, c in brute_components(numbered):
        groups.setdefault((c, n > 0) if n else (k, False), []).append(k)
    stay = [r for r, _ in kept["near"]]
    assert len(stay) == len(groups) < len(before)
    for members in groups.values():
        left = [before[k] for k in members if before[k] in stay]
        assert len(left) == 1 and (left[0][0] is None, left[0][0] or 0) == min((before[k][0] is None, before[k][0] or 0) for k in members)

    # mix: as often as sorting by hash says
    near = [r for r, _ in kept["near"]]
    want = Counter()
    for r, n in zip(near, mixture(near)):
        if n:
            want[r] += n
    assert Counter(r for r, _ in kept["mix"]) == want

    # encode, and the whole run
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect())
    encoded = Counter()
    for r, _ in kept["mix"]:
        ids = library.encode_ordinary(r[1] or "")
        encoded[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == encoded


def test_near_copies_under_shared_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    one = [(1, a, "en", "s"), (1, a + " x", "en", "s"), (3, a + " y", "en", "s")]
    assert [r[0] for r, _ in of(jaccard.drop_near(frame(spark, one)))] == [1]
    two = [(1, a, "en", "s"), (2, a + " x", "en", "s"), (2, b, "en", "s"), (3, b + " z", "en", "s")]
    assert sorted(r[:2] for r, _ in of(jaccard.drop_near(frame(spark, two)))) == [(1, a), (2, b)]
    same = [(None, a, "en", "s")] * 3 + [(None, a + " x", "en", "s"), (9, None, "en", "s"), (9, None, "en", "s"), (None, "", "en", "s")]
    got = [r[:2] for r, _ in of(jaccard.drop_near(frame(spark, same)))]
    assert len(got) == 4 and got.count((9, None)) == 2 and got.count((None, "")) == 1


def test_whole_takes_leave_empty_documents_alone(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(10)] + [(i, "", "en", "a") for i in range(50, 80)]
    taken = Counter(k for _, k in of(mixing.mix(frame(spark, rows), share=2.0)))
    assert set(taken.values()) == {2}


def test_stages_of_empty_tables_and_without_labels(spark, tmp_path):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (quality.keep_good(none, labels), exact.drop_exact(none), jaccard.drop_near(none), mixing.mix(none)):
        assert out.columns == none.columns and out.count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = frame(spark, [(1, "a few words", None, None), (2, None, "en", "a"), (None, "more words here", "en", None)])
    assert sorted(r[1] for r, _ in of(quality.keep_good(some, labels))) == ["a few words", "more words here"]   # nothing to judge by
