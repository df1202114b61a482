"""Per-URL lexical and structural features as Column expressions.

Every feature is a function ``Column -> Column`` so the same definitions serve
both layouts used by the operators:

* exploded: one row per URL (``explode`` then a plain ``select``), fully
  whole-stage-codegen'd, and
* in-row: ``transform(urls, u -> struct(...))`` over the URL array of an email,
  which needs no shuffle to get back to one row per email (and is the only form
  a stateless stream can use).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COUNTED_CHARS, PHISH_KEYWORDS, SPECIAL_CHARS_V0, SPECIAL_CHARS_V2, TLD_BUCKETS

Feature = tuple[str, Callable[[Column], Column], str]


def count_sub(c: Column, s: str) -> Column:
    """Non-overlapping occurrences of literal ``s`` in ``c``."""
    removed = F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
    return removed if len(s) == 1 else (removed / len(s)).cast("int")


def count_class(c: Column, negated_class: str) -> Column:
    """Number of characters of ``c`` that are NOT matched by ``negated_class``."""
    return F.length(F.regexp_replace(c, negated_class, ""))


def char_entropy(c: Column) -> Column:
    """Shannon entropy in bits of the character histogram of ``c`` (0 for '')."""
    n = F.length(c)
    total = F.aggregate(
        F.array_distinct(F.split(c, "")), F.lit(0.0),
        lambda acc, ch: acc - _plogp((n - F.length(F.replace(c, ch, F.lit("")))) / n))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def _plogp(p: Column) -> Column:
    return p * F.log2(p)


# ---- parsed URL parts (all from the lower-cased URL) ----
# Features read a struct ``p`` with fields url, low, host, path, nowww computed
# once per URL by ``url_parts``; nothing is re-parsed per feature.

def url_parts(url: Column) -> Column:
    low = F.lower(url)
    rest = F.regexp_replace(low, "(?s)^.*?://", "")
    return F.struct(url.alias("url"), low.alias("low"), rest.alias("rest"))


def finish_parts(p: Column) -> Column:
    """Second step of parsing (host and path need ``rest``)."""
    rest = p.getField("rest")
    host = F.substring_index(rest, "/", 1)
    return F.struct(p.getField("url").alias("url"), p.getField("low").alias("low"),
                    host.alias("host"),
                    rest.substr(F.length(host) + 1, F.length(rest) + 1).alias("path"),
                    F.replace(host, F.lit("www."), F.lit("")).alias("nowww"))


def parts_of(url: Column) -> Column:
    return finish_parts(url_parts(url))


def host(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.lower(url), "(?s)^.*?://", ""), "/", 1)


def tld_bucket(p: Column) -> Column:
    """Deterministic TLD code in [0, 500): first 32 bits of md5(tld) mod 500."""
    tld = F.substring_index(p.nowww, ".", -1)
    head = F.conv(F.substring(F.md5(tld), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(TLD_BUCKETS)).cast("int")


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den).otherwise(F.lit(0.0))


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


_DIGITS = "\\P{Nd}"
_LETTERS = "\\P{L}"
_CHAR_NAMES = ("dot", "hyphen", "underscore", "slash", "qmark", "equal",
               "amp", "at", "excl", "tilde", "comma", "percent")


def _features_54() -> list[Feature]:
    f: list[Feature] = [("url_len", lambda p: F.length(p.url), "int")]
    for name, ch in zip(_CHAR_NAMES, COUNTED_CHARS):
        f.append((f"n_{name}", (lambda p, ch=ch: count_sub(p.url, ch)), "int"))
    f += [
        ("n_digit", lambda p: count_class(p.url, _DIGITS), "int"),
        ("digit_letter_ratio", lambda p: _ratio(count_class(p.url, _DIGITS), count_class(p.url, _LETTERS)), "double"),
        ("is_https", lambda p: _flag(p.low.startswith("https")), "int"),
        ("host_is_ip", lambda p: _flag(p.host.rlike("^(?:\\p{Nd}{1,3}\\.){3}\\p{Nd}{1,3}")), "int"),
        ("n_subdomain", lambda p: F.greatest(F.lit(0), count_sub(p.nowww, ".") - 1), "int"),
        ("subdomain_depth", lambda p: F.greatest(F.lit(0), count_sub(p.nowww, ".") - 1), "int"),
        ("tld_bucket", tld_bucket, "int"),
        ("host_len", lambda p: F.length(p.host), "int"),
        ("domain_age", lambda p: F.lit(0), "int"),
        ("registration_period", lambda p: F.lit(0), "int"),
    ]
    for kw in PHISH_KEYWORDS:
        f.append((f"kw_{kw}", (lambda p, kw=kw: _flag(p.low.contains(kw))), "int"))
    f += [
        ("entropy_url", lambda p: char_entropy(p.url), "double"),
        ("entropy_host", lambda p: char_entropy(p.host), "double"),
        ("url_host_ratio", lambda p: _ratio(F.length(p.url), F.length(p.host)), "double"),
        ("n_redirect", lambda p: F.greatest(F.lit(0), count_sub(p.low, "http") - 1), "int"),
        ("has_port", lambda p: _flag(p.host.rlike(":\\p{Nd}{2,5}\\z")), "int"),
        ("n_extra_dslash", lambda p: F.greatest(F.lit(0), count_sub(p.url, "//") - 1), "int"),
        ("n_www", lambda p: count_sub(p.low, "www"), "int"),
        ("path_len", lambda p: F.length(p.path), "int"),
        ("path_depth", lambda p: count_sub(p.path, "/"), "int"),
        ("path_exec_ext", lambda p: _flag(p.path.endswith(".exe") | p.path.endswith(".zip")
                                          | p.path.endswith(".php") | p.path.endswith(".html")), "int"),
        ("n_upper", lambda p: count_class(p.url, "[^A-Z]"), "int"),
        ("digit_range", lambda p: _flag(p.url.rlike("\\p{Nd}-\\p{Nd}")), "int"),
    ]
    assert len(f) == 54, len(f)
    return f


FEATURES_54: list[Feature] = _features_54()
FEATURE_NAMES_54 = [n for n, _, _ in FEATURES_54]

# Oracle groups (keys of the query catalog), by feature position.
GROUPS_54 = {
    "url_feat_counts": FEATURE_NAMES_54[0:15],
    "url_feat_host": FEATURE_NAMES_54[15:23],
    "url_feat_keywords": FEATURE_NAMES_54[23:42],
    "url_feat_entropy": FEATURE_NAMES_54[42:45],
    "url_feat_structure": FEATURE_NAMES_54[45:54],
}


def _special_class(chars: str) -> str:
    return "[^" + "".join("\\" + c for c in chars) + "]"


FEATURES_5_V0: list[Feature] = [
    ("url_len", lambda p: F.length(p.url), "int"),
    ("n_digit", lambda p: count_class(p.url, _DIGITS), "int"),
    ("n_special", lambda p: count_class(p.url, _special_class(SPECIAL_CHARS_V0)), "int"),
    ("n_dot", lambda p: count_sub(p.url, "."), "int"),
    ("has_https", lambda p: _flag(p.url.contains("https")), "int"),
]

FEATURES_5_V2: list[Feature] = [
    ("url_len", lambda p: F.length(p.url), "int"),
    ("n_digit", lambda p: count_class(p.url, _DIGITS), "int"),
    ("n_special", lambda p: count_class(p.url, _special_class(SPECIAL_CHARS_V2)), "int"),
    ("n_dot", lambda p: count_sub(p.url, "."), "int"),
    ("is_https", lambda p: _flag(p.low.startswith("https")), "int"),
]


def feature_struct(p: Column, spec: list[Feature]) -> Column:
    """All features of ``spec`` (from parsed parts ``p``) as one struct of doubles."""
    return F.struct(*[fn(p).cast("double").alias(n) for n, fn, _ in spec])
