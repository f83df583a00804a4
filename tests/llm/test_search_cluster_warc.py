"""Operators 11 to 13 against brute force: nulls, empty and long values, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.llm import centroids, lexical, warc


# ---------------------------------------------------------------------------
# 11: lexical search
# ---------------------------------------------------------------------------

def terms(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(lexical.TERM, (text or "").translate(lower))


def brute_search(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (i, c) in enumerate(held):
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i, at))
        out += [(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(3)
    common = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.8 else f"r{rng.randrange(900)}" for _ in range(rng.randrange(1, 150))))
            for i in range(300)]
    docs += [(300 + i, "Alpha beta GAMMA alpha é-Élan 日本") for i in range(25)]   # ties
    docs += [(None, "alpha beta"), (7, "alpha beta"), (None, None), (400, None), (401, ""), (402, " ?! "),
             (403, " ".join(rng.choice(common) + str(rng.randrange(3000)) for _ in range(30000)) + " gamma")]
    items = [(i, " ".join(rng.choice(docs[:300])[1].split()[:20])) for i in range(12)]
    items += [(20, "alpha Beta beta"), (21, "élan ÉLAN Élan"), (22, "日本 unknownterm"), (23, ""), (24, None), (25, "nowhere"), (20, "gamma")]
    return docs, items


def search_rows(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x", None) for i, t in docs], "doc_id long, text string, row long, `a.b` string, terms string")
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, query int")
    return sorted([tuple(r) for r in lexical.search(lexical.build_index(d), q, **options).collect()], key=repr)


def test_lexical_search_matches_brute_force(spark, library):
    docs, items = library
    assert search_rows(spark, docs, items) == brute_search(docs, items)


def test_lexical_search_in_blocks_and_with_loose_sketches(spark, library, monkeypatch):
    docs, items = library
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(lexical, "SLOTS", 1)
    monkeypatch.setattr(lexical, "ROUNDS", (1,))
    assert search_rows(spark, docs, items, k=3) == brute_search(docs, items, 3)


def test_bounds_hold_and_prune(spark, library):
    """No sketch bound is under the exact score, and the last round scores few of the pairs."""
    docs, items = library
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = lexical.build_index(d)
    weighted = lexical.weighted_queries(index, spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    rows = weighted.select("query", "weights").collect()
    sc = spark.sparkContext
    plan = sc.broadcast([(r["query"], np.array([t["hash"] for t in r["weights"]]), np.array([float(t["weight"]) for t in r["weights"]]))
                         for r in rows])
    weights = sc.broadcast({r["query"]: [(t["term"], t["weight"]) for t in r["weights"]] for r in rows})
    every = lexical._reaching(index, plan, [1] * len(rows))
    scored = lexical._exact(index, weights, every).select("query", "row", "score").join(every, ["query", "row"]).collect()
    assert scored and all(r["bound"] >= r["score"] for r in scored)
    best = {}
    for r in scored:
        best.setdefault(r["query"], []).append(r["score"])
    floors = [sorted(best.get(r["query"], [0]))[-10:][0] for r in rows]
    assert lexical._reaching(index, plan, floors).count() < every.count() / 3


def test_lexical_search_of_empty_tables(spark):
    assert search_rows(spark, [], [(1, "a")]) == []
    assert search_rows(spark, [(1, "a b")], []) == []
    assert search_rows(spark, [(1, None)], [(1, "a")]) == []


# ---------------------------------------------------------------------------
# 12: centroid clustering
# ---------------------------------------------------------------------------

def brute_clusters(rows, dims, k, rounds, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x) < centroids.LARGEST for x in v)]
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    now = [v for _, v in hashed]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        now = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(now)]
    final = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in final)
    per = Counter()
    for _, d, j in final:
        per[j] += d
    return sorted(((i, j, d, per[j], total, hashlib.sha256(",".join(map(str, now[j])).encode()).hexdigest()) for i, d, j in final), key=repr)


def cluster_rows(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, `a.b` int")
    return sorted([tuple(r) for r in centroids.with_inertia(*centroids.centroid_clusters(frame, **options)).collect()], key=repr)


def vectors(dims, n=200):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(i % 5, 0.4, dims)]) for i in range(n)]
    same = rows[0][1]
    nan, inf = float("nan"), float("inf")
    return rows + [(500 + i, same) for i in range(90)] + [
        (3, same), (3, same), (None, same), (600, None), (601, same[:-1]), (602, same[:-1] + [None]), (603, same[:-1] + [nan]),
        (604, same[:-1] + [-inf]), (605, same[:-1] + [3e38]), (606, []), (607, [0.0] * dims)]


@pytest.mark.parametrize("k,rounds", [(7, 3), (1, 2), (400, 1), (5, 0)])
def test_centroid_clusters_match_brute_force(spark, k, rounds):
    rows = vectors(8)
    assert cluster_rows(spark, rows, dims=8, k=k, rounds=rounds) == brute_clusters(rows, 8, k, rounds)


def test_dot_products_stay_exact_and_unmoved_centroids_cost_nothing(spark):
    rows = [(i, [float(i % 3 * 4), 0.0]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    state, now = centroids.centroid_clusters(frame, dims=2, k=3, rounds=4)
    for r in state.collect():
        assert r["dots"] == (now @ np.array(r["v"])).tolist()
        assert r["distance"] == min(((now - np.array(r["v"])) ** 2).sum(axis=1))


def test_centroid_clusters_of_empty_tables(spark):
    assert cluster_rows(spark, [], dims=8) == []
    assert cluster_rows(spark, [(1, None), (2, [1.0])], dims=8) == []


# ---------------------------------------------------------------------------
# 13: WARC
# ---------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, record_type string, sha1 int, `a.b` int"


def pages_frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], PAGES)


def brute_pages(rows, min_bytes=0):
    groups = {}
    for at, (i, u, h) in enumerate(rows):
        groups.setdefault((h or "").encode(), []).append((i is not None, i or 0, u is not None, u or "", at))
    out = []
    for at, (i, u, h) in enumerate(rows):
        data = (h or "").encode()
        best = max(groups[data])
        first = len(data) < min_bytes or best[-1] == at
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if first else "revisit", None if first else rows[best[-1]][0]))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(8)
    rows = [(i, f"http://h/{i}", "<p>" + "x" * rng.randrange(3) + "é日" * (i % 4)) for i in range(80)]
    rows += [(100, "http://a", None), (101, "http://b", ""), (None, "http://c", "n"), (-5, None, "n"), (-6, "u\r\nWARC/1.0", "n"),
             (102, "http://w", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"),
             (103, "http://l", "".join(rng.choice("abcdefgh\r\n") for _ in range(3_000_000))), (104, "http://t", "tail\r\n\r\n"),
             (105, "http://e", "same"), (105, "http://e", "same"), (105, "http://e", "same"), (99, "http://e", "same"), (99, "http://e", "same")]
    return rows


def read_pages(spark, path):
    return sorted([tuple(r) for r in warc.page_digest(spark, path).collect()], key=repr)


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_pages_round_trip(spark, pages, min_bytes):
    path = warc.archive_pages(pages_frame(spark, pages), min_bytes=min_bytes)
    assert read_pages(spark, path) == brute_pages(pages, min_bytes)
    texts = warc.read_warc(spark, path, "record_type string, payload binary").filter("record_type = 'response'").collect()
    assert {bytes(r["payload"]).decode() for r in texts} == {h or "" for _, _, h in pages}


def test_pages_join_by_shuffle_beyond_the_broadcast_bound(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert read_pages(spark, warc.archive_pages(pages_frame(spark, pages))) == brute_pages(pages)


def test_archive_of_no_pages(spark):
    path = warc.archive_pages(pages_frame(spark, []))
    assert read_pages(spark, path) == []


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_pushed_filters_skip_payloads_and_partitions_follow_files(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.write_warc(warc.dedup_records(pages_frame(spark, pages)).coalesce(1), path, compression=compression, fileBytes=20_000)
    every = warc.read_warc(spark, path)
    assert every.count() == len(pages)
    for keep in ("record_type = 'revisit'", "record_type IN ('revisit', 'metadata')", "target_uri LIKE 'http://h/1%'", "refers_to IS NOT NULL",
                 "record_type = 'response' AND payload_bytes > 5", "record_type = 'none'"):
        filtered = every.filter(keep)
        assert sorted(r["headers"]["WARC-Record-ID"] for r in filtered.collect()) == sorted(
            r["headers"]["WARC-Record-ID"] for r in every.cache().filter(keep).collect())
        every.unpersist()
    assert "Filter (" not in every.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    reader = warc.WarcReader({"path": path, "partitionbytes": "30000"}, every.schema)
    assert len(reader.partitions()) > 1 and sum(len(p.names) for p in reader.partitions()) == len(warc._listed(path))
    assert every.filter("computed_digest <> payload_digest AND record_type = 'response'").count() == 0


def test_rejected_payloads_are_not_read(tmp_path):
    """A record that a filter rejects costs its header: the reader never touches the middle of its payload."""
    row = {"record_type": "response", "record_id": None, "target_uri": "http://x", "date": "d", "refers_to": None, "sha1": "00" * 20,
           "payload_bytes": 1 << 22, "payload": random.Random(1).randbytes(1 << 22), "extra": None}
    data = b"".join(record_bytes := warc.record_bytes(row)) + b"\r\n\r\n"
    assert len(record_bytes[1]) > 1 << 22
    for gz in (True, False):
        path = tmp_path / ("a.warc.gz" if gz else "a.warc")
        path.write_bytes((warc.gzip_member(data) if gz else data) * 3)
        if gz:
            assert gzip.decompress(path.read_bytes()) == data * 3   # any gzip reader reads it
        touched = []

        class Counting(warc._Raw):
            def readinto(self, buffer):
                n = super().readinto(buffer)
                touched.append(n)
                return n

        store, root = warc._store(str(path))
        raw = warc._Buffered(store.open_input_file(root))
        counting = warc.io.BufferedReader(Counting(store.open_input_file(root)), 4096)
        counting.size = raw.size
        assert list(warc.records(counting, gz, lambda f: False, True, True)) == []
        assert sum(touched) < len(data) / 10
        assert len(list(warc.records(raw, gz, lambda f: True, True, True))) == 3


def test_foreign_archive(spark, tmp_path):
    """Plain gzip members without the length field, fields in other cases, continued lines, no HTTP head."""
    one = (b"WARC/1.1\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <urn:a>\r\nX-Note: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")
    two = (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:b>\r\nContent-Type: application/http;msgtype=response\r\n"
           b"Content-Length: 27\r\n\r\nHTTP/1.1 200 OK\r\n\r\n<p>body\x00\xff\r\n\r\n")
    assert len(b"HTTP/1.1 200 OK\r\n\r\n<p>body\x00\xff") == 28
    two = two.replace(b"Content-Length: 27", b"Content-Length: 28")
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(one))
    (tmp_path / "y.warc").write_bytes(two + one)
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r["record_type"], r["payload_bytes"], bytes(r["payload"])) for r in rows) == sorted(
        [("warcinfo", 5, b"hello")] * 3 + [("response", 9, b"<p>body\x00\xff")] * 2)
    assert {r["headers"].get("X-Note") for r in rows} == {"a b", None}
    assert warc.read_warc(spark, str(tmp_path), "record_id string").filter(F.col("record_id") == "<urn:b>").count() == 2
