"""Text cleaning, URL extraction and word tokenisation as native Column expressions.

Java regex and RE2 treat ``\\s``, ``\\w`` and ``\\d`` as ASCII classes, while the
behaviour reproduced here follows Unicode rules, so every pattern spells its
classes out (``\\p{L}``, ``\\p{Nd}``, the explicit whitespace set below). The
same pattern text is used by the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import STOPWORDS

# ---- fixed values: characters that count as whitespace for str.split() / \s ----
# TAB..CR, FS..US, SPACE, NEL, NBSP, OGHAM SPACE, EN QUAD..HAIR SPACE,
# LINE SEP, PARA SEP, NNBSP, MMSP, IDEOGRAPHIC SPACE
WS_CLASS = ("\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
            "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}")
WS_RUN = f"[{WS_CLASS}]+"
NON_WS_RUN = f"[^{WS_CLASS}]+"

# ---- fixed values: the 32 ASCII punctuation characters !"#$%&'()*+,-./:;<=>?@[\]^_`{|}~ ----
PUNCT_CLASS = "[!-/:-@\\[-`{-~]"

# URLs: a scheme-prefixed run or a www.-prefixed run of non-whitespace, any case.
URL_PATTERN = f"(?i)https?://{NON_WS_RUN}|www\\.{NON_WS_RUN}"

# Default TF-IDF token: a run of two or more Unicode word characters.
WORD_TOKEN_PATTERN = "[\\p{L}\\p{N}_]{2,}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_tokens(text) -> Column:
    """lower -> delete ASCII punctuation -> whitespace split -> drop stopwords and 1-char tokens."""
    stripped = F.regexp_replace(F.lower(_col(text)), PUNCT_CLASS, "")
    parts = F.split(stripped, WS_RUN)
    stops = list(STOPWORDS)
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(stops))


def raw_clean_parts(text) -> Column:
    """Whitespace-split, punctuation-free, lower-cased text (before the token filter)."""
    return F.split(F.regexp_replace(F.lower(_col(text)), PUNCT_CLASS, ""), WS_RUN)


def keep_token(t: Column) -> Column:
    """The token filter of the cleaner, for one token (a plain, codegen'd predicate)."""
    return (F.length(t) > 1) & ~t.isin(list(STOPWORDS))


def clean_text(text) -> Column:
    """The cleaned text: kept tokens joined by one space (null in -> null out)."""
    return F.array_join(clean_tokens(text), " ")


def extract_urls(text) -> Column:
    """All URLs of a text in order, duplicates and trailing punctuation kept."""
    return F.regexp_extract_all(_col(text), F.lit(URL_PATTERN), 0)


def word_tokens(text) -> Column:
    """Lower-cased runs of >= 2 word characters (the TF-IDF tokenizer)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD_TOKEN_PATTERN), 0)


def with_bigrams(tokens) -> Column:
    """Unigrams followed by space-joined adjacent pairs, as one array.

    The lambda reads its own two words only: a token array named inside it would be made again for
    every pair, and a tokenizer over the whole text with it.
    """
    toks = _col(tokens)
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(toks, pairs)


def compose_text(subject, body) -> Column:
    """strip(coalesce(subject,'') + ' ' + coalesce(body,'')) with Unicode whitespace."""
    joined = F.concat_ws(" ", F.coalesce(_col(subject), F.lit("")), F.coalesce(_col(body), F.lit("")))
    return strip_ws(joined)


def strip_ws(c) -> Column:
    return F.regexp_replace(_col(c), f"^{WS_RUN}|{WS_RUN}$", "")
