"""Label normalisation rules as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import LABEL_WORDS, LABEL_WORDS_V1, URL_LABEL_WORDS
from .text import strip_ws


def _map_lit(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def label_v2(raw: Column) -> Column:
    """strip + lower, word/number lookup, then integer strings: 0/1 or null (dropped later)."""
    v = F.lower(strip_ws(raw))
    mapped = _map_lit(LABEL_WORDS)[v]
    as_int = F.when(v.rlike("^-?[0-9]+$"), v.try_cast("bigint"))
    fallback = F.when(as_int.isin(0, 1), as_int.cast("int"))
    return F.coalesce(mapped.cast("int"), fallback)


def label_v1_word(raw: Column) -> Column:
    """Older rule: lower-case, map known spellings to phishing/legit, keep others unchanged."""
    v = F.lower(raw)
    return F.coalesce(_map_lit(LABEL_WORDS_V1)[v], v)


def label_word_to_int(word: Column) -> Column:
    return F.when(word == "phishing", F.lit(1)).when(word == "legit", F.lit(0))


def url_label(raw: Column) -> Column:
    """0/1/legit/phishing words, else the value as an integer (null if not one)."""
    v = F.lower(raw)
    return F.coalesce(_map_lit(URL_LABEL_WORDS)[v].cast("int"), raw.try_cast("int"))
