"""Noun lemmas as a join.

A lemma map is computed once over the *distinct* tokens: each token yields
candidate stems by the noun detachment rules; candidates found in a lexicon
table are kept and the shortest wins (ties: alphabetical); an exception table
(irregular forms) overrides; a token with no candidate stays as it is. The
map is then looked up for the token arrays part by part (``operators.parts``). Default lexicon: corpus tokens with document frequency >= 2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from missive.operators import parts as P
from missive.session import materialise

# Noun detachment rules (suffix, replacement), applied once.
NOUN_RULES = (
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"),
    ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
)


def _stem(token: Column, old: str, new: str) -> Column:
    """token minus suffix ``old`` plus ``new`` (null when the rule does not apply)."""
    keep = F.length(token) - F.lit(len(old))
    return F.when(token.endswith(old) & (keep > 0), F.concat(F.substring(token, F.lit(1), keep), F.lit(new)))


def build_lexicon(token_rows: DataFrame, tokens_col: str = "tokens", min_df: int = 2) -> DataFrame:
    """(lemma) = tokens occurring in at least ``min_df`` rows (partial aggregation map-side)."""
    per_row = token_rows.select(F.explode(F.array_distinct(tokens_col)).alias("lemma"))
    return per_row.groupBy("lemma").agg(F.count(F.lit(1)).alias("_df")) \
        .filter(F.col("_df") >= min_df).select("lemma")


def lemma_map(token_rows: DataFrame, lexicon: DataFrame, exceptions: DataFrame | None = None,
              tokens_col: str = "tokens") -> DataFrame:
    """(token, lemma) for every distinct token of ``token_rows``."""
    distinct = materialise(token_rows.select(F.explode(tokens_col).alias("_tok")).distinct(), "distinct-tokens")
    # a known stem always beats the token itself (shorter, or earlier by "men"), which stays where none is known
    cands = distinct.select("_tok", F.explode(F.filter(
        F.array(*[_stem(F.col("_tok"), o, n) for o, n in NOUN_RULES]),
        lambda c: c.isNotNull())).alias("cand"))
    known = cands.join(lexicon.select(F.col("lemma").alias("cand")), "cand")
    best = known.groupBy("_tok").agg(
        F.min(F.struct(F.length("cand").alias("n"), F.col("cand").alias("c"))).alias("_b"))
    out = distinct.join(best, "_tok", "left")
    lemma = F.coalesce(F.col("_b.c"), F.col("_tok"))
    if exceptions is not None:
        exc = exceptions.select(F.col("form").alias("_tok"), F.col("lemma").alias("_exc"))
        out = out.join(exc, "_tok", "left")
        lemma = F.coalesce(F.col("_exc"), lemma)
    return out.select(F.col("_tok").alias("token"), lemma.alias("lemma"))


MAX_BROADCAST_LEMMAS = 500_000   # changed tokens; above this the parts' tokens are shuffled to the map


def lemmatize_column(df: DataFrame, tokens_col: str, lemmas: DataFrame, out_col: str = "lemmas", *,
                     key_col: str) -> DataFrame:
    """Replace every token by its lemma, keeping order.

    Rows are dealt to parts (``operators.parts``) and meet the lemmas of their
    different tokens there, of which only those that differ from the token are
    moved; occurrences are not shuffled one by one. ``key_col`` names a unique row key."""
    columns = df.columns

    def replaced(rows: pa.Table, found: pa.Table) -> pa.Table:
        words, lengths = P.flat_words(rows)
        new = words
        if found.num_rows:
            at = P.places(words, found["word"])
            entries = pa.concat_arrays(found["lemma"].chunks).cast(words.type)
            new = pc.if_else(pa.array(at >= 0), entries.take(pa.array(np.maximum(at, 0))), words)
        out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), new)
        keys = pa.concat_arrays(rows["_key"].chunks)
        if keys.null_count or len(keys.unique()) < len(keys):
            out = _of_keys(keys.to_pylist(), out.to_pylist(), out.type)
        return pa.table({**{c: rows["_words" if c == tokens_col else c] for c in columns}, out_col: out})

    rows, parts = P.dealt(df.withColumn("_key", F.col(key_col)).withColumnRenamed(tokens_col, "_words"), F.col("_words"), "lemma-rows", key=F.col("_key"))
    changed = materialise(lemmas.filter("lemma <> token").select(F.col("token").alias("word"), "lemma"), "changed-lemmas")
    if changed.count() <= MAX_BROADCAST_LEMMAS:
        changed = F.broadcast(changed)
    fields = [T_.StructField(c, rows.schema["_words" if c == tokens_col else c].dataType) for c in columns]   # as read back
    schema = T_.StructType([*fields, T_.StructField(out_col, T_.ArrayType(T_.StringType()))])
    return P.look_up(rows, parts, changed, replaced, schema)


def _of_keys(keys: list, lists: list, kind: pa.DataType) -> pa.Array:
    """Rows of one key share their tokens, in the order of place and token; a row without a key has none."""
    shared: dict = {}
    for key, tokens in zip(keys, lists):
        shared.setdefault(key, []).extend(enumerate(tokens))
    shared = {k: [t for _, t in sorted(v, key=lambda x: (x[0], x[1] is not None, x[1] or ""))] for k, v in shared.items()}
    return pa.array([[] if k is None else shared[k] for k in keys], kind)


def lemmatize(df: DataFrame, tokens_col: str = "tokens", out_col: str = "lemmas",
              lexicon: DataFrame | None = None, exceptions: DataFrame | None = None, *,
              key_col: str) -> DataFrame:
    """T13 end to end: default lexicon from the same rows when none is given."""
    df = materialise(df, "lemma-tokens")   # read by the lexicon, the map and the rows: cleaned once
    lex = lexicon if lexicon is not None else build_lexicon(df, tokens_col)
    return lemmatize_column(df, tokens_col, lemma_map(df, lex, exceptions, tokens_col), out_col, key_col=key_col)
