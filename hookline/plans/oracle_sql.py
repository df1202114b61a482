"""DuckDB SQL text for the independent oracle.

The oracle restates each query in plain SQL over the driver's tables. Regex
patterns are shared with the Spark side (same text, both engines checked).
"""

from __future__ import annotations

from ..functions.constants import COUNTED_CHARS, PHISH_KEYWORDS, SPECIAL_CHARS_V0, SPECIAL_CHARS_V2, STOPWORDS
from ..functions.text import PUNCT_CLASS, URL_PATTERN, WORD_TOKEN_PATTERN, WS_RUN
from ..functions.urls import FEATURES_5_V0, FEATURES_54, _CHAR_NAMES

MAIL_CTE = """mail AS (
  SELECT d.doc_id AS email_id, d.source, l.toxic AS y,
         CASE WHEN d.doc_id % 3 = 0 THEN d.text
              WHEN d.doc_id % 3 = 1 THEN concat(d.text, ' ', p.url)
              ELSE concat(d.text, ' ', p.url, ' WWW.', q.url) END AS raw_text
  FROM documents d
  LEFT JOIN labels l ON d.doc_id = l.doc_id
  JOIN pages p ON p.page_id * 4 = d.doc_id - d.doc_id % 4
  JOIN pages q ON q.page_id = d.doc_id % 50)"""

EMAILS_CTE = """emails AS (
  SELECT d.doc_id AS email_id, d.source, l.toxic AS y,
         CASE WHEN d.doc_id % 3 = 0 THEN d.text
              WHEN d.doc_id % 3 = 1 THEN concat(d.text, ' ', p.url)
              ELSE concat(d.text, ' ', p.url, ' WWW.', q.url) END AS raw_text
  FROM documents d
  JOIN labels l ON d.doc_id = l.doc_id
  JOIN pages p ON p.page_id * 4 = d.doc_id - d.doc_id % 4
  JOIN pages q ON q.page_id = d.doc_id % 50)"""

URLS_CTE = """urls AS (
  SELECT page_id AS url_id, url,
         CASE WHEN (url LIKE 'http://%') <> (page_id % 10 = 0) THEN 1 ELSE 0 END AS y
  FROM pages)"""


def agent_score_sql(tag: str, key: str = "doc_id", y: str = "toxic") -> str:
    return (f"least(1.0::DOUBLE, (('0x' || substr(md5(concat('{tag}', cast({key} AS varchar))),1,8))::UBIGINT"
            f" / 4294967296::DOUBLE) * 0.7::DOUBLE + 0.3::DOUBLE * {y})")


SCORED_CTE = f"""scored AS (
  SELECT doc_id AS email_id, toxic AS y,
         {agent_score_sql('sem')} AS p_semantic,
         {agent_score_sql('txt')} AS p_textual,
         {agent_score_sql('lex')} AS p_lexical
  FROM labels)"""


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---- text ----

def clean_tokens_sql(x: str) -> str:
    stops = ", ".join(lit(w) for w in STOPWORDS)
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), {lit(PUNCT_CLASS)}, '', 'g'), {lit(WS_RUN)}),"
            f" lambda t: length(t) > 1 AND NOT list_contains([{stops}], t))")


def clean_text_sql(x: str) -> str:
    return f"array_to_string({clean_tokens_sql(x)}, ' ')"


def extract_urls_sql(x: str) -> str:
    return f"regexp_extract_all({x}, {lit(URL_PATTERN)}, 0)"


def word_tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(WORD_TOKEN_PATTERN)}, 0)"


# ---- URL features ----

def cnt(x: str, s: str) -> str:
    base = f"(length({x}) - length(replace({x}, {lit(s)}, '')))"
    return base if len(s) == 1 else f"({base} // {len(s)})"


def ccls(x: str, negated: str) -> str:
    return f"length(regexp_replace({x}, {lit(negated)}, '', 'g'))"


def flag(cond: str) -> str:
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN ({num})::DOUBLE / {den} ELSE 0.0::DOUBLE END"


def entropy(x: str) -> str:
    p = f"((length({x}) - length(replace({x}, ch, '')))::DOUBLE / length({x}))"
    return (f"CASE WHEN length({x}) = 0 THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_transform("
            f"list_distinct(string_split({x}, '')), lambda ch: -({p} * log2({p})))), 0.0::DOUBLE) END")


def url_parts(u: str) -> dict[str, str]:
    low = f"lower({u})"
    rest = f"regexp_replace({low}, '(?s)^.*?://', '')"
    host = f"split_part({rest}, '/', 1)"
    path = f"substr({rest}, length({host}) + 1)"
    nowww = f"replace({host}, 'www.', '')"
    tld = f"regexp_extract({nowww}, '[^.]*$')"
    return {"low": low, "rest": rest, "host": host, "path": path, "nowww": nowww, "tld": tld}


def url_features_54_sql(u: str) -> dict[str, str]:
    p = url_parts(u)
    out = {"url_len": f"length({u})"}
    for name, ch in zip(_CHAR_NAMES, COUNTED_CHARS):
        out[f"n_{name}"] = cnt(u, ch)
    digits, letters = ccls(u, "\\P{Nd}"), ccls(u, "\\P{L}")
    out["n_digit"] = digits
    out["digit_letter_ratio"] = ratio(digits, letters)
    out["is_https"] = flag(f"starts_with({p['low']}, 'https')")
    out["host_is_ip"] = flag(f"regexp_matches({p['host']}, '^(?:\\p{{Nd}}{{1,3}}\\.){{3}}\\p{{Nd}}{{1,3}}')")
    out["n_subdomain"] = f"greatest(0, {cnt(p['nowww'], '.')} - 1)"
    out["subdomain_depth"] = out["n_subdomain"]
    out["tld_bucket"] = f"((('0x' || substr(md5({p['tld']}), 1, 8))::UBIGINT % 500)::BIGINT)"
    out["host_len"] = f"length({p['host']})"
    out["domain_age"] = "0"
    out["registration_period"] = "0"
    for kw in PHISH_KEYWORDS:
        out[f"kw_{kw}"] = flag(f"contains({p['low']}, {lit(kw)})")
    out["entropy_url"] = entropy(u)
    out["entropy_host"] = entropy(p["host"])
    out["url_host_ratio"] = ratio(f"length({u})", f"length({p['host']})")
    out["n_redirect"] = f"greatest(0, {cnt(p['low'], 'http')} - 1)"
    out["has_port"] = flag(f"regexp_matches({p['host']}, ':\\p{{Nd}}{{2,5}}\\z')")
    out["n_extra_dslash"] = f"greatest(0, {cnt(u, '//')} - 1)"
    out["n_www"] = cnt(p["low"], "www")
    out["path_len"] = f"length({p['path']})"
    out["path_depth"] = cnt(p["path"], "/")
    out["path_exec_ext"] = flag(" OR ".join(f"ends_with({p['path']}, '{e}')" for e in (".exe", ".zip", ".php", ".html")))
    out["n_upper"] = ccls(u, "[^A-Z]")
    out["digit_range"] = flag(f"regexp_matches({u}, '\\p{{Nd}}-\\p{{Nd}}')")
    assert list(out) == [n for n, _, _ in FEATURES_54]
    return out


def _special(chars: str) -> str:
    return "[^" + "".join("\\" + c for c in chars) + "]"


def url_features_5_sql(u: str, version: int) -> dict[str, str]:
    if version == 0:
        return {"url_len": f"length({u})", "n_digit": ccls(u, "\\P{Nd}"),
                "n_special": ccls(u, _special(SPECIAL_CHARS_V0)), "n_dot": cnt(u, "."),
                "has_https": flag(f"contains({u}, 'https')")}
    return {"url_len": f"length({u})", "n_digit": ccls(u, "\\P{Nd}"),
            "n_special": ccls(u, _special(SPECIAL_CHARS_V2)), "n_dot": cnt(u, "."),
            "is_https": flag(f"starts_with(lower({u}), 'https')")}


FEATURE_KIND = {n: k for n, _, k in FEATURES_54}
FEATURE_KIND_5 = {n: k for n, _, k in FEATURES_5_V0}


def out_cast(expr: str, kind: str) -> str:
    """Output typing shared with the Spark side: BIGINT for counts, DOUBLE rounded to 6."""
    return f"CAST({expr} AS BIGINT)" if kind == "int" else f"round(CAST({expr} AS DOUBLE), 6)"
