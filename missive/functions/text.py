"""Text ETL as native Column expressions.

Every function here returns a ``Column`` built from ``pyspark.sql.functions``
only, so the whole cleaning chain stays inside whole-stage codegen: no Python
worker, no Arrow hop. The regular expressions are written so that Java's
regex engine (Spark) and RE2 (the DuckDB oracle) read them the same way and
both agree with Python's Unicode-aware ``\\s``/``\\S``/``\\d`` classes.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as written for results to match).
# ---------------------------------------------------------------------------

# Python's ``str.isspace`` set: ASCII controls TAB..CR, the four separators
# 0x1C-0x1F, NEXT LINE, and every Unicode space separator (category Z).
WS_CLASS = r"\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}"
NON_WS_RUN = rf"[^{WS_CLASS}]+"
WS_RUN = rf"[{WS_CLASS}]+"

# The 32 ASCII punctuation characters (Python ``string.punctuation``).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Cleaning patterns, applied in this order after lower-casing.
TAG_PATTERN = r"<[^>]*>"
URL_PATTERN = rf"https?://{NON_WS_RUN}|www\.{NON_WS_RUN}"
ADDRESS_PATTERN = rf"{NON_WS_RUN}@{NON_WS_RUN}"
MONEY_PATTERN = "[$£€]"
EXCLAMATION_PATTERN = "!"
DIGIT_RUN_PATTERN = r"\p{Nd}+"

MONEY_TOKEN = " moneytoken "
EXCLAMATION_TOKEN = " exclamationtoken "
NUMBER_TOKEN = " numbertoken "

# Label synonyms, checked after lower-case + whitespace trim.
LABEL_SYNONYMS = {
    "1": "spam", "0": "ham",
    "1.0": "spam", "0.0": "ham",
    "yes": "spam", "no": "ham",
    "true": "spam", "false": "ham",
    "positive": "spam", "negative": "ham",
}
VALID_LABELS = ("spam", "ham")
SPAM_SYNONYMS = tuple(k for k, v in LABEL_SYNONYMS.items() if v == "spam")
HAM_SYNONYMS = tuple(k for k, v in LABEL_SYNONYMS.items() if v == "ham")

# Header names that identify the two logical columns of a labelled file.
LABEL_HEADER_NAMES = ("label", "v1", "class", "target", "spam", "category")
TEXT_HEADER_NAMES = ("text", "v2", "message", "email", "body", "sms")

# Word-character run used for n-gram vocabularies (two or more characters).
WORD_RUN_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORD_CHAR_CLASS = r"\p{L}\p{N}_"

# Spam trigger phrases for highlighting (matched case-insensitively, whole words).
DEFAULT_TRIGGERS = (
    "winner", "won", "free", "prize", "cash", "claim",
    "urgent", "selected", "refinance", "viagra", "cialis",
    "gift card", "click here", "click now", "make money", "double income",
    "millions?", "billion", "credit card", "account locked", "suspicious activity",
)

# Apache Spark's default English stop-word list (StopWordsRemover, 181 words).
DEFAULT_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom
this that these those am is are was were be been being have has had having do does did doing
a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again further
then once here there when where why how all any both each few more most other some such no nor
not only own same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've
we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't
won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought
that's there's what's when's where's who's why's would
""".split())


# ---------------------------------------------------------------------------
# Labels (P1, P2)
# ---------------------------------------------------------------------------

def strip_ws(col: Column) -> Column:
    """Trim Unicode whitespace at both ends (Spark's ``trim`` only trims spaces)."""
    return F.regexp_replace(col, rf"^{WS_RUN}|{WS_RUN}$", "")


def standardise_label(col: Column) -> Column:
    """lower(trim(label)) with synonym mapping; other values pass through."""
    norm = F.lower(strip_ws(col.cast("string")))
    return (F.when(norm.isin(*SPAM_SYNONYMS), F.lit("spam"))
            .when(norm.isin(*HAM_SYNONYMS), F.lit("ham"))
            .otherwise(norm))


def is_valid_label(col: Column) -> Column:
    return col.isin(*VALID_LABELS)


# ---------------------------------------------------------------------------
# Cleaning (T1-T12, T14)
# ---------------------------------------------------------------------------

def normalise_text(col: Column) -> Column:
    """Null guard, lower-case, strip markup/links/addresses, insert
    marker tokens, delete ASCII punctuation."""
    c = F.lower(F.coalesce(col.cast("string"), F.lit("")))
    c = F.regexp_replace(c, TAG_PATTERN, " ")
    c = F.regexp_replace(c, URL_PATTERN, " ")
    c = F.regexp_replace(c, ADDRESS_PATTERN, " ")
    c = F.regexp_replace(c, MONEY_PATTERN, MONEY_TOKEN)
    c = F.regexp_replace(c, EXCLAMATION_PATTERN, EXCLAMATION_TOKEN)
    c = F.regexp_replace(c, DIGIT_RUN_PATTERN, NUMBER_TOKEN)
    return F.translate(c, PUNCTUATION, "")


def clean_tokens(col: Column, stop_words: Iterable[str] | None = DEFAULT_STOP_WORDS) -> Column:
    """Cleaned token array (whitespace split, >1 char, no stop words)."""
    toks = F.split(normalise_text(col), WS_RUN)
    stops = tuple(stop_words or ())
    if stops:
        # ``isin`` over a literal list becomes a hash-set lookup (InSet) in Catalyst.
        return F.filter(toks, lambda t: (F.length(t) > 1) & ~t.isin(*stops))
    return F.filter(toks, lambda t: F.length(t) > 1)


def clean_text(col: Column, stop_words: Iterable[str] | None = DEFAULT_STOP_WORDS) -> Column:
    """T1-T14 without lemmas: the cleaned, space-joined string."""
    return F.array_join(clean_tokens(col, stop_words), " ")


def split_clean_text(col: Column) -> Column:
    """Words of an already cleaned string (empty string -> empty array)."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), " "), lambda t: F.length(t) > 0)


# ---------------------------------------------------------------------------
# n-grams (T16)
# ---------------------------------------------------------------------------

def vocab_tokens(col: Column) -> Column:
    """Tokens of two or more word characters, as the TF-IDF vocabulary sees them."""
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD_RUN_PATTERN), 0)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs joined by one space; empty for fewer than two tokens.

    ``zip_with`` over two shifted slices keeps the token array out of the
    lambda, so it is evaluated once per row (a lambda that indexes an outer
    array expression would re-evaluate it per element).
    """
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def uni_and_bigrams(tokens: Column) -> Column:
    return F.concat(tokens, bigrams(tokens))


# ---------------------------------------------------------------------------
# Trigger phrases
# ---------------------------------------------------------------------------

def trigger_alternation(triggers: Sequence[str] = DEFAULT_TRIGGERS) -> str:
    return "(" + "|".join(triggers) + ")"


def highlight_triggers(col: Column, triggers: Sequence[str] = DEFAULT_TRIGGERS,
                       open_tag: str = "<mark>", close_tag: str = "</mark>") -> Column:
    """Wrap whole-word, case-insensitive trigger matches in markup."""
    pattern = (rf"(?iu)(?<![{WORD_CHAR_CLASS}]){trigger_alternation(triggers)}"
               rf"(?![{WORD_CHAR_CLASS}])")
    return F.regexp_replace(col, pattern, f"{open_tag}$1{close_tag}")


def trigger_matches(col: Column, triggers: Sequence[str] = DEFAULT_TRIGGERS) -> Column:
    """Array of lower-cased whole-word trigger matches in a text."""
    pattern = (rf"(?iu)(?<![{WORD_CHAR_CLASS}]){trigger_alternation(triggers)}"
               rf"(?![{WORD_CHAR_CLASS}])")
    return F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), 1),
                       lambda m: F.lower(m))
