"""DuckDB SQL fragments mirroring the engine's Column expressions.

These are used only to build the independent oracle queries in
``missive.plans.oracle``; the engine itself never parses or runs them.
"""

from __future__ import annotations

from collections.abc import Sequence

from missive.functions import text as T


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values: Sequence[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def normalise_text(col: str) -> str:
    c = f"lower(coalesce(CAST({col} AS VARCHAR), ''))"
    for pat, rep in ((T.TAG_PATTERN, " "), (T.URL_PATTERN, " "), (T.ADDRESS_PATTERN, " "),
                     (T.MONEY_PATTERN, T.MONEY_TOKEN), (T.EXCLAMATION_PATTERN, T.EXCLAMATION_TOKEN),
                     (T.DIGIT_RUN_PATTERN, T.NUMBER_TOKEN)):
        c = f"regexp_replace({c}, {lit(pat)}, {lit(rep)}, 'g')"
    return f"translate({c}, {lit(T.PUNCTUATION)}, '')"


def clean_tokens(col: str, stop_words: Sequence[str] = T.DEFAULT_STOP_WORDS) -> str:
    split = f"string_split_regex({normalise_text(col)}, {lit(T.WS_RUN)})"
    cond = "length(t) > 1"
    if stop_words:
        cond += f" AND t NOT IN {in_list(stop_words)}"
    return f"list_filter({split}, lambda t: {cond})"


def clean_text(col: str, stop_words: Sequence[str] = T.DEFAULT_STOP_WORDS) -> str:
    return f"array_to_string({clean_tokens(col, stop_words)}, ' ')"


def split_clean_text(col: str) -> str:
    return f"list_filter(string_split(coalesce({col}, ''), ' '), lambda t: length(t) > 0)"


def standardise_label(col: str) -> str:
    norm = f"lower(regexp_replace(CAST({col} AS VARCHAR), {lit('^' + T.WS_RUN + '|' + T.WS_RUN + '$')}, '', 'g'))"
    return (f"CASE WHEN {norm} IN {in_list(T.SPAM_SYNONYMS)} THEN 'spam' "
            f"WHEN {norm} IN {in_list(T.HAM_SYNONYMS)} THEN 'ham' ELSE {norm} END")


def vocab_tokens(col: str) -> str:
    return f"regexp_extract_all(coalesce({col}, ''), {lit(T.WORD_RUN_PATTERN)}, 0)"


def bigrams(tokens: str) -> str:
    return (f"list_transform(generate_series(2, len({tokens})), "
            f"lambda i: {tokens}[i - 1] || ' ' || {tokens}[i])")


def _sentinel_text(col: str) -> str:
    """RE2 has no look-around: put a U+0001 sentinel after every non-word
    character so that each match can consume its own boundary character."""
    return f"regexp_replace(coalesce({col}, ''), {lit('([^' + T.WORD_CHAR_CLASS + '])')}, '\\1' || chr(1), 'g')"


def _sentinel_pattern(triggers: Sequence[str]) -> str:
    w = T.WORD_CHAR_CLASS
    alt = "(" + "|".join(t.replace(" ", " \x01") for t in triggers) + ")"
    return f"(?i)(^|[^{w}]){alt}([^{w}]|$)"


def trigger_matches(col: str, triggers: Sequence[str] = T.DEFAULT_TRIGGERS) -> str:
    pattern = _sentinel_pattern(triggers)
    return (f"list_transform(regexp_extract_all({_sentinel_text(col)}, {lit(pattern)}, 2), "
            f"lambda m: lower(replace(m, chr(1), '')))")


def highlight_triggers(col: str, triggers: Sequence[str] = T.DEFAULT_TRIGGERS,
                       open_tag: str = "<mark>", close_tag: str = "</mark>") -> str:
    pattern = _sentinel_pattern(triggers)
    rep = "\\1" + open_tag + "\\2" + close_tag + "\\3"
    return f"replace(regexp_replace({_sentinel_text(col)}, {lit(pattern)}, {lit(rep)}, 'g'), chr(1), '')"
