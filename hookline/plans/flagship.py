"""The flagship query: emails -> URL features -> per-email vector -> fixed score -> policy.

The score is a fixed, documented linear prior over the URL vector (no fitted
model), squashed to [0, 1] by the logistic function, so the whole query is
pure column work plus the one shuffle of building the mail view; the fitted
lexical model replaces the prior in ``plans.cv``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PHISH_KEYWORDS
from ..functions.urls import FEATURES_54
from ..operators.email_urls import email_url_features_inrow
from ..operators.policy import policy_v0
from ..sources.tables import emails

# Fixed prior weights over the per-email URL vector (bias, then feature: weight).
PRIOR_BIAS = -2.0
PRIOR_WEIGHTS = {
    "max_url_len": 0.02,
    "max_host_is_ip": 1.5,
    "max_n_at": 0.8,
    "max_n_subdomain": 0.4,
    "max_is_https": -0.5,
    "max_has_port": 0.7,
}
PRIOR_KEYWORD_WEIGHT = 0.8   # per keyword flag that is set on some URL of the email
# The URL features the prior reads; the optimizer cannot prune fields inside a lambda.
_READ = {n[4:] for n in PRIOR_WEIGHTS} | {f"kw_{kw}" for kw in PHISH_KEYWORDS}
PRIOR_FEATURES = [f for f in FEATURES_54 if f[0] in _READ]


def prior_logit(cols: dict[str, Column] | None = None) -> Column:
    c = cols or {}
    get = (lambda n: c.get(n, F.col(n)))
    z = F.lit(PRIOR_BIAS)
    for n, w in PRIOR_WEIGHTS.items():
        z = z + F.lit(w) * get(n)
    for kw in PHISH_KEYWORDS:
        z = z + F.lit(PRIOR_KEYWORD_WEIGHT) * get(f"max_kw_{kw}")
    return z


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = email_url_features_inrow(emails(spark, sf_dir), PRIOR_FEATURES)
    return prior_decision(vec)


def prior_decision(vec: DataFrame) -> DataFrame:
    """Score and action; the action is taken on the unrounded score."""
    s = vec.select("email_id", "y", F.col("n_urls").cast("bigint").alias("n_urls"),
                   (1.0 / (1.0 + F.exp(-prior_logit()))).alias("p"))
    return s.select("email_id", "y", "n_urls", F.round("p", 6).alias("score"), policy_v0(F.col("p")).alias("action"))


def flagship_sql() -> str:
    from . import oracle_sql as O
    feats = O.url_features_54_sql("url")
    needed = [n[4:] for n in PRIOR_WEIGHTS] + [f"kw_{kw}" for kw in PHISH_KEYWORDS]
    per_url = ", ".join(f"CAST({feats[n]} AS DOUBLE) AS {n}" for n in needed)
    z = f"{PRIOR_BIAS}::DOUBLE"
    for n, w in PRIOR_WEIGHTS.items():
        z += f" + {w}::DOUBLE * coalesce(max(f.{n[4:]}), 0)"
    for kw in PHISH_KEYWORDS:
        z += f" + {PRIOR_KEYWORD_WEIGHT}::DOUBLE * coalesce(max(f.kw_{kw}), 0)"
    return O.with_ctes(
        O.EMAILS_CTE,
        f"ex AS (SELECT email_id, unnest({O.extract_urls_sql('raw_text')}) AS url FROM emails)",
        f"f AS (SELECT email_id, {per_url} FROM ex)",
        f"""s AS (SELECT m.email_id, m.y, CAST(count(f.email_id) AS BIGINT) AS n_urls,
                 1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))) AS score
          FROM emails m LEFT JOIN f ON m.email_id = f.email_id GROUP BY m.email_id, m.y)""") + """
SELECT email_id, y, n_urls, round(score, 6) AS score,
       CASE WHEN score >= 0.85 THEN 'quarantine' WHEN score >= 0.5 THEN 'mirror' ELSE 'deliver' END AS action
FROM s"""
