"""Operator 2: license scans by diagonal voting (native).

All word bigrams of a document are joined to the bigrams of license templates
(a fixed, broadcast table of each bigram once). The matches of a document are
shuffled as one row of 8 bytes a match; behind that, a match at document word d
and template word t votes for the diagonal d - t, and no further step shuffles.
A base phrase stands wherever all its bigrams vote for one diagonal, and so does a
one-line notice. For passages (opening passages, and whole licenses cut into
overlapping segments), neighbouring diagonals (inserted or dropped words) are
merged into a band and the span is verified: the words join by value, not by
hash alone, the band is no wider than a quarter of the passage, and at least
``MIN_COVER`` of the passage's bigrams occur in it. One verified passage or
notice labels the document. In segments, bigrams of two ``FUNCTION_WORDS`` do
not vote; licenses that share a passage are all named for it.

Defined cases: a null text is empty and has no words; texts of one word have
no bigram; rows that repeat a doc_id are judged one by one; a null doc_id is
passed on; an empty table gives an empty result; a document's score is 1 with
a base phrase or a notice, else the best share of a passage found in one of
its bands.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from missive.llm.common import between, lower_ascii

#: Fixed value: words are what stands between runs of these (ASCII but digits and lower-case letters).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening passages of public licenses, of at most 64 words each.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction including without limitation "
           "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in "
                  "compliance with the license you may obtain a copy of the license at",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu "
                  "general public license as published by the free software foundation",
    "cc-by-sa": "this work is licensed under the creative commons attribution sharealike license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
               "was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
           "granted provided that the above copyright notice and this permission notice appear in all copies",
}
#: Notices that name a license in a line; every word must stand.
NOTICES = {
    "mit": ("mit license", "mit licence", "license mit", "license identifier mit", "x11 license"),
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache license v2", "apache license v2 0",
                   "apache 2 0 license", "license identifier apache 2 0", "license apache 2 0",
                   "apache org licenses license 2 0"),
    "apache": ("apache license", "apache licence", "apache software license"),
    "bsd": ("bsd license", "bsd licence", "bsd style license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd",
            "license bsd"),
    "gpl": ("gnu gpl", "gpl license", "gpl version 2", "gpl version 3", "gpl v2", "gpl v3", "gplv2 license",
            "gplv3 license", "under gplv2", "under gplv3", "the gplv2", "the gplv3", "the gpl",
            "license identifier gpl", "license gpl"),
    "lgpl": ("lesser general public license", "library general public license", "gnu lgpl", "license identifier lgpl",
             "the lgpl"),
    "agpl": ("affero general public license", "gnu agpl", "license identifier agpl", "the agpl"),
    "mpl-2.0": ("mozilla public license v 2 0", "mozilla public license version 2 0", "mozilla public license 2 0",
                "license identifier mpl 2 0", "mozilla org mpl 2 0"),
    "mpl": ("mozilla public license",),
    "isc": ("isc license", "isc licence", "license identifier isc"),
    "cc-by": ("creative commons attribution", "creativecommons org licenses by"),
    "cc-by-sa": ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike",
                 "creativecommons org licenses by sa"),
    "cc-by-nc": ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial",
                 "creativecommons org licenses by nc"),
    "cc-by-nd": ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution noderivs",
                 "creative commons attribution no derivatives", "creativecommons org licenses by nd"),
    "cc-by-nc-sa": ("cc by nc sa", "creative commons attribution noncommercial sharealike",
                    "creativecommons org licenses by nc sa"),
    "cc-by-nc-nd": ("cc by nc nd", "creative commons attribution noncommercial noderivatives",
                    "creativecommons org licenses by nc nd"),
    "cc0-1.0": ("cc0 1 0", "creative commons zero", "creative commons cc0", "license identifier cc0",
                "creativecommons org publicdomain zero"),
}
#: Whole licenses in ``license_texts/``, cut into segments of ``SEGMENT`` bigrams (one bit each in a long) every ``STRIDE``.
TEXTS = {"apache-2.0": "apache-2.0", "bsd": "bsd", "cc0-1.0": "cc0-1.0", "gpl-2.0": "gpl", "gpl-3.0": "gpl", "isc": "isc",
         "lgpl-2.1": "lgpl", "lgpl-3.0": "lgpl", "mit": "mit", "mpl-2.0": "mpl-2.0"}
SEGMENT, STRIDE = 62, 31
#: A segment votes with all bigrams but those of two of these words: "of the" would join half of all text.
FUNCTION_WORDS = frozenset("a an and any are as at be but by for from had has have if in is it its may not of on or so such "
                           "that the their these they this to was were which will with you your".split())
#: A match is one long: the place in the document, and in the lowest bits the number of the bigram.
NUMBER_BITS = 20
#: Share of a template's bigrams that a verified span holds.
MIN_COVER = 0.8
#: Diagonals at most so far apart belong to one band.
NEIGHBOUR = 3


def _segments(name: str) -> list[tuple[int, list]]:
    """(words between first and last bigram, [(place, bigram)]) of each segment of a whole license."""
    text = pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode("utf-8")
    words = [w for w in re.split(SEPARATORS, "".join(c.lower() if c.isascii() else c for c in text)) if w]
    grams = list(zip(words, words[1:]))
    last = max(0, len(grams) - SEGMENT)
    out = []
    for start in sorted({*range(0, last, STRIDE), last}):
        part = grams[start:start + SEGMENT]
        out.append((len(part), [(t, g) for t, g in enumerate(part) if not FUNCTION_WORDS.issuperset(g)]))
    return out


def _template_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Each different bigram, numbered; and the places at which numbered bigrams stand in templates."""
    phrase = lambda text: list(enumerate(zip(text.split(" "), text.split(" ")[1:])))
    parts = [("base", label, 0, phrase(text)) for text, label in BASE.items()]
    parts += [("notice", label, 0, phrase(text)) for label, texts in NOTICES.items() for text in texts]
    parts += [("passage", label, len(phrase(text)), phrase(text)) for label, text in TEMPLATES.items()]
    parts += [("passage", label, span, grams) for name, label in TEXTS.items() for span, grams in _segments(name)]
    rows = [(-1, None, "closing", 1, 0, 0, 0, "", "")]  # the closing bigram
    for part, (kind, label, span, grams) in enumerate(parts):
        rows += [(part, label, kind, len(grams), span, t, 1 << i, a, b) for i, (t, (a, b)) in enumerate(grams)]
    number = {}  # of each different bigram
    rows = [(*row, number.setdefault(row[7:], len(number))) for row in rows]
    grams = spark.createDataFrame([(n, a, b) for (a, b), n in number.items()], "n long, ta string, tb string")
    places = spark.createDataFrame([(*row[:7], row[9]) for row in rows],
                                   "part int, label string, kind string, grams int, span int, t int, bit long, n long")
    return grams.withColumn("gram", F.xxhash64("ta", "tb")), places


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    # the row number is made and used in one pass: nothing is joined back by it
    words = docs.select(F.monotonically_increasing_id().alias("row"), docs[doc_id].alias("doc_id"),
                        between(lower_ascii(docs[text]), SEPARATORS).alias("w"))
    # each document ends with one empty bigram, which words never form: its row stands for the document itself
    pairs = F.arrays_zip(F.col("w").alias("a"),
                         F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    closing = F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b")))
    exploded = words.select("row", "doc_id", F.size("w").alias("n_words"), F.posexplode(F.concat(pairs, closing)).alias("d", "g"))
    hits = exploded.select("row", "doc_id", "n_words", "d", F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    # the hash alone is the join key (a plain long); the words are compared on its few matches
    same = F.col("a").between(F.col("ta"), F.col("ta")) & F.col("b").between(F.col("tb"), F.col("tb"))
    grams, places = _template_rows(spark)
    match = F.shiftleft(F.col("d").cast("long"), NUMBER_BITS).bitwiseOR(F.col("n"))
    found = (hits.join(F.broadcast(grams), (F.xxhash64("a", "b") == F.col("gram")) & same)
             .groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
                                 F.collect_list(match).alias("matches")))
    found = (found.select("row", "doc_id", "n_words", F.explode("matches").alias("match"))
             .select("row", "doc_id", "n_words", F.shiftright("match", NUMBER_BITS).cast("int").alias("d"),
                     F.col("match").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).alias("n"))
             .join(F.broadcast(places), "n"))
    votes = found.groupBy("row", "part", "label", "kind", "grams", "span", (F.col("d") - F.col("t")).alias("diag")).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.bit_or("bit").alias("seen"))
    # phrases have one diagonal and count when they are whole: parts of them need not go on
    votes = votes.filter(F.col("kind").isin("passage", "closing") | (F.bit_count("seen") == F.col("grams")))
    by_diag = Window.partitionBy("row", "part").orderBy("diag")
    new = F.when(F.col("diag") - F.lag("diag").over(by_diag) <= NEIGHBOUR, 0).otherwise(1)
    bands = (votes.withColumn("new", new)
             .withColumn("band", F.when(F.col("kind") != "passage", F.col("diag").cast("long"))  # phrases have one diagonal
                         .otherwise(F.sum("new").over(by_diag.rowsBetween(Window.unboundedPreceding, 0)))))
    spans = bands.groupBy("row", "part", "label", "kind", "grams", "span", "band").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.min("diag").alias("diag"),
        (F.max("diag") - F.min("diag")).alias("width"), F.bit_or("seen").alias("seen"))
    cover = F.bit_count("seen") / F.col("grams")
    place = (F.col("kind") == "base") & (cover == 1)
    passage = F.col("kind") == "passage"
    verified = (((F.col("kind") == "notice") & (cover == 1))
                | (passage & (cover >= MIN_COVER) & (F.col("width") * 4 <= F.col("span") + 12)))
    # half a notice is no evidence: it counts when it is whole
    spans = spans.select("row", "doc_id", "n_words", "label", "diag", place.alias("place"), verified.alias("verified"),
                         F.when(passage | verified, cover).alias("cover"))
    labels = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    out = spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(F.col("place"), 1)).alias("n_base"),
        F.min(F.when(F.col("place"), F.col("diag"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("place"), F.col("diag"))).cast("long").alias("last_word"),
        labels(F.col("place")).alias("base_labels"), labels(F.col("place") | F.col("verified")).alias("labels"),
        F.max(F.when(F.col("label").isNotNull(), F.col("cover"))).alias("__cover"))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce("__cover", F.lit(0.0)), F.lit(1.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                      "base_labels", "labels", score.alias("score"))
