"""Operator 7: secret scans with a random forest that removes false positives.

Candidates of three shapes are found in whole texts: a value of 6 or more
characters (any, if quoted) right after a naming word and a sign of
assignment; the password in a URL's user part; and any run of 16 or more of
the characters that keys are made of. Each gets features: length, transitions
between kinds of characters, shares of digits, capitals, hex and other
characters, spread of characters, how much of its letters words of the
corpus' dictionary cover, whether it is a path, an address, a date or an
issued key format, and the words before and after it. A random forest decides.

The dictionary holds the ``DICTIONARY`` words that occur most often in the
corpus (counted over all texts by Spark; the bound is that parameter). The
forest is trained on labelled findings: ``findings`` of the caller (before,
value, after, label), or by default ``example_findings``, generated ones with
their truth known by construction: keys and passwords where they stand, and
what is mistaken for them (commit ids, checksums, dated paths and addresses,
file names, versions, identifiers, placeholders, settings without a value).
At most about ``TRAIN_ROWS`` findings of the corpus whose shape settles that
they are ordinary words join them, chosen by a hash (a bounded sample; the
bound is this parameter). Every candidate of every whole text is scored.

Defined cases: null and empty texts have no candidates; documents without a
finding are listed with 0; rows that repeat a doc_id are listed one by one; a
null doc_id is passed on; an empty table gives an empty result; overlapping
candidates count once, the named one first; equal values of a document are
listed as often as they occur, in order of value and probability; very long
texts are read whole; only the two named columns are read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import quoted, small_batches
from missive.operators.features import top_terms
from missive.session import materialise

#: Words that name a secret, shapes of issued keys, and words that name something else.
NAMING = r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)"
ISSUED = (r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}")
OTHER = (r"commit|revision|rev|sha\d*|md5|checksum|digest|hash|uuid|guid|build|version|release|isbn|order|ticket|issue|file|path|page|photo|"
         r"image|data|etag|branch|tag|session of|published|archived")
#: Characters read before and after a candidate.
AROUND = 40
DICTIONARY = 20_000
TRAIN_ROWS = 20_000
TREES, DEPTH = 40, 10
FEATURES = ("length", "switches", "digits", "capitals", "hexes", "others", "spread", "covered", "path", "address", "date", "issued",
            "named", "assigned", "user_part", "other_before", "other_after")

_NAMED = re.compile(NAMING + r"[A-Za-z_]{0,12}[\"']?[ \t]{0,3}(?::=|=>|[=:])[ \t]{0,3}(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"',;]{6,}))", re.I)
_USER_PART = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]{1,15}://[^\s/@:\"']{0,64}:([^\s/@\"']{6,})@")
_RUN = re.compile(r"[A-Za-z0-9_+/=.\-]{16,}")
_TRIM = re.compile(r"^[.\-=]+|[.=\-]+$")
_IS = {
    "path": re.compile(r"/|\\|\.[a-z]{2,4}$|^www\."),
    "address": re.compile(r"^\w+://|@|\.(?:com|org|net|io)\b"),
    "date": re.compile(r"(?:19|20)\d\d[-_/.]?(?:0[1-9]|1[0-2])"),
    "issued": re.compile(rf"^(?:{ISSUED})$"),
    "named": re.compile(NAMING, re.I),
    "assigned": re.compile(r"(?::=|=>|[=:])[ \t]{0,3}[\"']?$"),
    "other": re.compile(rf"\b(?:{OTHER})\b", re.I),
}
_LETTERS = re.compile(r"[a-z]{3,}")


def spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, in a URL's user part) of the candidates of a text, from left to right."""
    found = []
    for m in _NAMED.finditer(text):
        found.append((*m.span(m.lastindex), False))
    for m in _USER_PART.finditer(text):
        found.append((*m.span(1), True))
    taken = sorted(found)
    k = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not (k < len(taken) and taken[k][0] < b):
            name = re.match(r"[A-Za-z_]+=+", m.group())
            a += name.end() if name and b - a - name.end() >= 6 else 0
            found.append((a, b, False))
    out = []
    for a, b, user in sorted(found):
        value = text[a:b]
        if not any(c in "\"' \t" for c in value):   # a run's closing punctuation is not part of it
            trimmed = _TRIM.sub("", value)
            a, b = (a + value.find(trimmed), a + value.find(trimmed) + len(trimmed)) if trimmed else (a, a)
        if b - a >= 6 and not (out and a < out[-1][1]):
            out.append((a, b, user))
    return out


def _kind(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"


def covered(value: str, words: frozenset) -> float:
    """Share of the value's characters that dictionary words cover, the longest first at each place."""
    total = 0
    for run in _LETTERS.findall(value.lower()):
        at = 0
        while at < len(run):
            n = next((n for n in range(min(24, len(run) - at), 2, -1) if run[at:at + n] in words), 0)
            total += n
            at += n or 1
    return total / len(value)


def describe(before: str, value: str, after: str, user_part: bool, words: frozenset) -> tuple:
    """The features of one candidate, in the order of ``FEATURES``."""
    n, kinds = len(value), [_kind(c) for c in value]
    counts = Counter(value)
    spread = -sum(c / n * math.log2(c / n) for c in counts.values())
    return (float(n), sum(x != y for x, y in zip(kinds, kinds[1:])) / n, kinds.count("0") / n, kinds.count("A") / n,
            sum(c in "0123456789abcdefABCDEF" for c in value) / n, kinds.count("-") / n, spread, covered(value, words),
            float(bool(_IS["path"].search(value))), float(bool(_IS["address"].search(value))), float(bool(_IS["date"].search(value))),
            float(bool(_IS["issued"].search(value))), float(bool(_IS["named"].search(before))), float(bool(_IS["assigned"].search(before))),
            float(user_part), float(bool(_IS["other"].search(before))), float(bool(_IS["other"].search(after))))


_COLUMNS = ", ".join(f"{c} double" for c in FEATURES)


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> frozenset:
    """The corpus' most frequent words of three letters or more (a-z), ``size`` at most."""
    words = F.explode(F.split(F.lower(F.coalesce(quoted(text), F.lit(""))), "[^a-z]+"))
    counts = docs.select(words.alias("w")).filter(F.length("w").between(3, 24))
    counts = materialise(counts.groupBy(F.col("w").alias("term")).agg(F.count(F.lit(1)).alias("term_count")), "llm-secret-words")
    return frozenset(r["term"] for r in top_terms(counts, size).collect())   # words below the cut never leave their tasks


def candidates(docs: DataFrame, words: frozenset, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, value and features: one row per candidate, or one with null value for a text without any."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(doc_id).alias("doc_id"), quoted(text).alias("t"))
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(frames):
        for f in frames:
            out = []
            for row, doc, t in zip(f["row"], f["doc_id"], f["t"]):
                own = [(row, doc, t[a:b], *describe(t[max(0, a - AROUND):a], t[a:b], t[b:b + AROUND], user, shared.value))
                       for a, b, user in (spans(t) if t else ())]
                out += own or [(row, doc, None, *([None] * len(FEATURES)))]
            yield pd.DataFrame(out, columns=["row", "doc_id", "value", *FEATURES])

    return rows.mapInPandas(run, f"row long, doc_id {kind}, value string, {_COLUMNS}")


# ---------------------------------------------------------------------------
# Labelled findings
# ---------------------------------------------------------------------------

def example_findings(n: int = 6000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """(before, value, after, label): generated findings whose truth is known, half of them secrets."""
    rng = random.Random(seed)
    hexes, low, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    plain = ["summer", "winter", "hunter", "secret", "dragon", "monkey", "welcome", "orange", "server", "master", "garden", "coffee", "report",
             "index", "module", "service", "article", "release", "internal", "config", "handler", "backup", "update", "project"]
    word = lambda: rng.choice(plain)
    prose = lambda: " ".join(rng.choice(plain) for _ in range(rng.randrange(0, 5)))
    date = lambda sep: sep.join((str(rng.randrange(1995, 2030)), f"{rng.randrange(1, 13):02d}", f"{rng.randrange(1, 29):02d}"))
    name = lambda: rng.choice(["", "db_", "DB_", "my ", "admin ", "user_", "AWS_"]) + rng.choice(
        ["password", "Password", "passwd", "PWD", "secret", "token", "api_key", "api-key", "APIKEY", "access_key", "private_key", "client_secret"])
    sign = lambda: rng.choice(["=", " = ", ": ", ":", " := ", " => "])

    def key():
        return rng.choice([pick(hexes, rng.choice([16, 24, 32, 40, 64])), pick(alnum, rng.randrange(16, 60)), pick(alnum + "+/", 40) + "=",
                           pick(alnum + "-_", rng.randrange(20, 44)), pick(low + "0123456789", rng.randrange(16, 40))])

    def password():
        w = word()
        return rng.choice([w.capitalize() + str(rng.randrange(1950, 2030)), w + str(rng.randrange(10, 99999)), pick(alnum, rng.randrange(7, 15)),
                           w.replace("e", "3").replace("o", "0") + pick(alnum, 3), pick(alnum, 4) + rng.choice("-_.!#$%") + pick(alnum, 4),
                           w + rng.choice("!#$%&*") + str(rng.randrange(100)), f"{pick(low, 3)} {rng.randrange(10, 99)} {pick(low, 3)}!",
                           pick(alnum + "!#$%&*?", rng.randrange(8, 18)), pick(hexes, rng.randrange(8, 16))])

    def secret():
        way = rng.random()
        if way < 0.4:
            return f"{prose()} {name()}{sign()}{rng.choice(['', chr(34), chr(39)])}", key(), rng.choice(['"', "'", "", ";", " "]) + prose()
        if way < 0.75:
            return f"{prose()} {name()}{sign()}{rng.choice([chr(34), chr(39)])}", password(), rng.choice(['"', "'"]) + " " + prose()
        if way < 0.85:
            host = rng.choice(["postgres", "mysql", "https", "amqp", "redis", "ftp"])
            return f"{prose()} {host}://{word()[:rng.randrange(1, 6)]}:", password().replace(" ", "x"), f"@{word()}.example/{word()}"
        issued = rng.choice(["AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + pick(alnum, 36), "sk_live_" + pick(alnum, 24),
                             "xoxb-" + pick("0123456789", 11) + "-" + pick(alnum, 24), "AIza" + pick(alnum + "_-", 35)])
        return rng.choice([prose() + " ", f"{name()}{sign()}", "key "]), issued, " " + prose()

    def mistaken():
        way = rng.randrange(13)
        ext = rng.choice(["py", "txt", "html", "jpg", "csv", "conf"])
        if way == 0:
            before = rng.choice(["see commit ", "commit ", "revision ", "fixed in commit ", "rev ", "sha1 ", "branch at "])
            return before, pick(hexes, rng.choice([32, 40, 40, 40])), " " + prose()
        if way == 1:
            before = rng.choice(["sha256: ", "md5: ", "checksum = ", "sha256sum ", "digest: ", "etag: \"", "hash: "])
            return before, pick(hexes, rng.choice([32, 40, 64])), rng.choice(["", "  ", '"']) + f" {word()}.{ext}"
        if way == 2:
            return prose() + " ", "/".join(["", "usr", word(), f"{word()}{rng.randrange(9)}.{rng.randrange(20)}", f"{word()}_{word()}.{ext}"]), " " + prose()
        if way == 3:
            return prose() + " https:", f"//{word()}.example.com/{date('/')}/{word()}-{word()}-{rng.randrange(9999)}", " " + prose()
        if way == 4:
            return prose() + rng.choice([" photo ", " file ", " "]), f"{rng.choice(['IMG', 'report', 'backup'])}_{date('')}_{rng.randrange(10**6):06d}.{ext}", " " + prose()
        if way == 5:
            return prose() + rng.choice([" on ", " at ", " published "]), f"{date('-')}T{rng.randrange(24):02d}-{rng.randrange(60):02d}-00.{rng.randrange(1000):03d}", " " + prose()
        if way == 6:
            u = pick(hexes, 32)
            return rng.choice(["uuid ", "id: ", "order ", "guid="]), "-".join((u[:8], u[8:12], u[12:16], u[16:20], u[20:])), " " + prose()
        if way == 7:
            return prose() + rng.choice([" version ", " release ", " build ", " "]), f"{word()}-{word()}-{rng.randrange(9)}.{rng.randrange(30)}.{rng.randrange(9)}-post{rng.randrange(9)}", " " + prose()
        if way == 8:
            return prose() + " ", "_".join(word() for _ in range(rng.randrange(3, 5))) + rng.choice(["", f"_v{rng.randrange(9)}"]), rng.choice(["(", " "]) + prose()
        if way == 9:   # a setting without a secret
            value = rng.choice(["required", "optional", "********", "<password>", "YOUR_API_KEY", "your-password-here", "changeme", "string", "None,None",
                                "os.environ", "getpass()", "${PASSWORD}", "{{ token }}", "xxxxxxxxxx", "example", "settings." + word(), "undefined"])
            return f"{prose()} {name()}{sign()}{rng.choice(['', chr(34)])}", value, rng.choice(['"', "", " "]) + prose()
        if way == 10:
            return f"{prose()} {name()}{sign()}", word() + rng.choice(["", "_" + word(), "." + word()]), " " + prose()
        if way == 11:
            return prose() + " ", "-".join(word() for _ in range(rng.randrange(3, 6))), " " + prose()
        return prose() + rng.choice([" isbn ", " order ", " ticket ", " "]), pick("0123456789", rng.randrange(16, 20)), " " + prose()

    return [(*(x := (secret() if i % 2 else mistaken()))[:1], *x[1:], i % 2) for i in range(n)]


def _training(spark, findings, words: frozenset) -> DataFrame:
    rows = []
    for before, value, after, label in findings:
        user = bool(re.search(r"\w://[^\s/@:]*:$", before)) and after.startswith("@")
        rows.append((float(label), *describe(before[-AROUND:], value, after[:AROUND], user, words)))
    return spark.createDataFrame(rows, f"label double, {_COLUMNS}")


def train_forest(found: DataFrame, words: frozenset, findings=None, train_rows: int = TRAIN_ROWS):
    """The forest, from labelled findings and a bounded sample of the corpus' ordinary words."""
    spark = found.sparkSession
    examples = _training(spark, findings if findings is not None else example_findings(), words)
    ordinary = found.filter("value is not null AND digits = 0 AND named = 0 AND user_part = 0 AND issued = 0")
    n = ordinary.count()
    chance = F.pmod(F.xxhash64("value", "row"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ordinary = ordinary.filter(chance < train_rows / max(n, 1)).select(F.lit(0.0).alias("label"), *FEATURES)
    train = examples.withColumn("weight", F.lit(1.0)).unionByName(ordinary.withColumn("weight", F.lit(1000.0 / max(min(n, train_rows), 1000))))
    forest = RandomForestClassifier(featuresCol="__x", labelCol="label", weightCol="weight", probabilityCol="__p", rawPredictionCol="__r",
                                    predictionCol="__c", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="sqrt", seed=7)
    return forest.fit(_vectors(train))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(rows)


def score(forest, rows: DataFrame) -> DataFrame:
    """Add ``probability`` (of being a secret) to rows with features."""
    return forest.transform(_vectors(rows)).withColumn("probability", vector_to_array("__p")[1]).drop("__x", "__p", "__r", "__c")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", findings=None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_candidates, n_secrets, secrets (array of value and probability)."""
    words = dictionary(docs, text)
    found = materialise(candidates(docs, words, doc_id, text), "llm-secret-found")
    forest = train_forest(found, words, findings, train_rows)
    every = score(forest, found.filter("value is not null")).select("row", "doc_id", "value", "probability").unionByName(
        found.filter("value is null").select("row", "doc_id", "value", F.lit(None).cast("double").alias("probability")))
    secret = F.col("probability") >= 0.5
    return (every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.count("value").alias("n_candidates"), F.count(F.when(secret, 1)).alias("n_secrets"),
        F.array_sort(F.collect_list(F.when(secret, F.struct("value", "probability")))).alias("secrets")).drop("row"))
