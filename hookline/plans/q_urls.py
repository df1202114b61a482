"""Catalog entries: URL features, per-email URL aggregates, policies on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import FEATURES_5_V0, FEATURES_5_V2, FEATURES_54, GROUPS_54, char_entropy, host, parts_of
from ..operators.email_urls import agg_names, email_url_features_exploded, email_url_features_inrow, to_model_width
from ..sources.tables import mail, table, urls
from . import oracle_sql as O
from .common import out
from .registry import register

KIND54 = {n: k for n, _, k in FEATURES_54}


def _url_group_sql(names: list[str]) -> str:
    feats = O.url_features_54_sql("url")
    cols = ",\n       ".join(f"{O.out_cast(feats[n], KIND54[n])} AS {n}" for n in names)
    return f"SELECT page_id AS url_id,\n       {cols}\nFROM pages"


def _parsed_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("url_id"), parts_of(F.col("url")).alias("p"))


def _url_group_query(names: list[str]):
    def q(spark, sf_dir):
        p = _parsed_pages(spark, sf_dir)
        spec = {n: (fn, k) for n, fn, k in FEATURES_54}
        return p.select("url_id", *[out(spec[n][0](F.col("p")), spec[n][1], n) for n in names])
    return q


for _key, _names in GROUPS_54.items():
    register(_key, _url_group_sql(_names))(_url_group_query(_names))


def _five_sql(version: int) -> str:
    feats = O.url_features_5_sql("url", version)
    cols = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for n, e in feats.items())
    return f"SELECT page_id AS url_id, {cols} FROM pages"


@register("url_features_5_v0", _five_sql(0))
def url_features_5_v0(spark, sf_dir):
    p = _parsed_pages(spark, sf_dir)
    return p.select("url_id", *[out(fn(F.col("p")), "int", n) for n, fn, _ in FEATURES_5_V0])


@register("url_features_5_v2", _five_sql(2))
def url_features_5_v2(spark, sf_dir):
    p = _parsed_pages(spark, sf_dir)
    return p.select("url_id", *[out(fn(F.col("p")), "int", n) for n, fn, _ in FEATURES_5_V2])


@register("agg_char_entropy", f"""SELECT page_id AS url_id,
       round({O.entropy('url')}, 6) AS entropy_url,
       round({O.entropy(O.url_parts('url')['host'])}, 6) AS entropy_host,
       round({O.entropy('html')}, 6) AS entropy_html
FROM pages""")
def agg_char_entropy(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select(F.col("page_id").alias("url_id"),
                    F.round(char_entropy(F.col("url")), 6).alias("entropy_url"),
                    F.round(char_entropy(host(F.col("url"))), 6).alias("entropy_host"),
                    F.round(char_entropy(F.col("html")), 6).alias("entropy_html"))


# ---- per-email aggregates ----

def _email_agg_sql(feats: dict[str, str], kinds: dict[str, str], source_cte: str, source: str) -> str:
    per_url = ",\n         ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in feats.items())
    aggs = ",\n       ".join([f"round(coalesce(avg(f.{n}), 0), 6) AS mean_{n}" for n in feats]
                             + [f"round(coalesce(max(f.{n}), 0), 6) AS max_{n}" for n in feats])
    return O.with_ctes(source_cte,
                       f"ex AS (SELECT email_id, unnest({O.extract_urls_sql('raw_text')}) AS url FROM {source})",
                       f"f AS (SELECT email_id,\n         {per_url}\n  FROM ex)") + f"""
SELECT m.email_id, m.y, CAST(count(f.email_id) AS BIGINT) AS n_urls,
       {aggs}
FROM {source} m LEFT JOIN f ON m.email_id = f.email_id
GROUP BY m.email_id, m.y"""


def _rounded(df, spec):
    names = agg_names(spec)
    return df.select("email_id", "y", F.col("n_urls").cast("bigint").alias("n_urls"),
                     *[F.round(c, 6).alias(c) for c in names])


@register("agg_email_url_108", _email_agg_sql(O.url_features_54_sql("url"), KIND54, O.MAIL_CTE, "mail"))
def agg_email_url_108(spark, sf_dir):
    return _rounded(email_url_features_inrow(mail(spark, sf_dir)), FEATURES_54)


@register("join_email_urls", _email_agg_sql(O.url_features_54_sql("url"), KIND54, O.MAIL_CTE, "mail"))
def join_email_urls(spark, sf_dir):
    return _rounded(email_url_features_exploded(mail(spark, sf_dir)), FEATURES_54)


@register("agg_email_url_5x2", _email_agg_sql(O.url_features_5_sql("url", 0), {}, O.MAIL_CTE, "mail"))
def agg_email_url_5x2(spark, sf_dir):
    return _rounded(email_url_features_inrow(mail(spark, sf_dir), FEATURES_5_V0), FEATURES_5_V0)


_V2_FEATS = O.url_features_5_sql("url", 2)
_V2_SQL = _email_agg_sql(_V2_FEATS, {}, O.MAIL_CTE, "mail").replace(
    "SELECT m.email_id, m.y, CAST(count(f.email_id) AS BIGINT) AS n_urls,",
    "SELECT m.email_id, m.y, CAST(count(f.email_id) AS BIGINT) AS n_urls,\n"
    "       CASE WHEN count(f.email_id) = 0 THEN 0.5::DOUBLE END AS lex_prior,")


@register("agg_email_url_v2_prior", _V2_SQL)
def agg_email_url_v2_prior(spark, sf_dir):
    df = _rounded(email_url_features_inrow(mail(spark, sf_dir), FEATURES_5_V2), FEATURES_5_V2)
    prior = F.when(F.col("n_urls") == 0, F.lit(0.5)).alias("lex_prior")
    return df.select("email_id", "y", "n_urls", prior, *agg_names(FEATURES_5_V2))


_V2_NAMES = agg_names(FEATURES_5_V2)
_PADDED, _CUT = len(_V2_NAMES) + 2, len(_V2_NAMES) - 4


@register("agg_email_url_v2_width", "WITH agg AS (" + _V2_SQL + ")\nSELECT email_id, lex_prior, "
          + ", ".join([f"{n} AS pad_{i}" for i, n in enumerate(_V2_NAMES)]
                      + [f"0.0::DOUBLE AS pad_{i}" for i in range(len(_V2_NAMES), _PADDED)]
                      + [f"{n} AS cut_{i}" for i, n in enumerate(_V2_NAMES[:_CUT])])
          + f", CAST({_CUT} AS INTEGER) AS cut_width FROM agg")
def agg_email_url_v2_width(spark, sf_dir):
    """The 10-wide vector brought to a wider and to a narrower model; no URL gives the prior."""
    df = agg_email_url_v2_prior(spark, sf_dir)
    v = F.array(*[F.col(n) for n in _V2_NAMES])
    df = df.select("email_id", "lex_prior", to_model_width(v, _PADDED).alias("p"), to_model_width(v, _CUT).alias("c"))
    return df.select("email_id", "lex_prior", *[F.col("p")[i].alias(f"pad_{i}") for i in range(_PADDED)],
                     *[F.col("c")[i].alias(f"cut_{i}") for i in range(_CUT)], F.size("c").alias("cut_width"))


# ---- flagship and the fixed-tier policy ----
from .flagship import flagship, flagship_sql  # noqa: E402

register("flagship_policy_v0", flagship_sql())(flagship)


register("url_features_54", _url_group_sql([n for n, _, _ in FEATURES_54]))(_url_group_query([n for n, _, _ in FEATURES_54]))
