"""URL extraction per email and the per-email mean / max of URL features.

Two layouts with equal results (tested):

* ``email_url_features_inrow``: URL features are computed inside the email row
  over the extracted URL array (``transform`` / ``aggregate``). No shuffle; the
  only form a stateless stream can use. This is the default for batch too: the
  per-email vector is produced where the email already lives.
* ``email_url_features_exploded``: ``explode_outer`` one row per URL, codegen'd
  feature projection, then ``groupBy(email_id)`` (partial aggregation on the map
  side, one row per email crosses the shuffle). Emails without a URL keep a row
  through ``explode_outer`` and get zeros, so no join back is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_urls
from ..functions.urls import FEATURES_54, Feature, feature_struct, finish_parts, parts_of, url_parts


def agg_names(spec: list[Feature]) -> list[str]:
    return [f"mean_{n}" for n, _, _ in spec] + [f"max_{n}" for n, _, _ in spec]


def url_feature_array(urls: Column, spec: list[Feature]) -> Column:
    """``array<struct<features>>``: one struct of feature values per URL of the array."""
    return F.transform(urls, lambda u: feature_struct(parts_of(u), spec))


def inrow_aggregates(feats: Column, n: Column, spec: list[Feature]) -> list[Column]:
    """Mean then max of every feature over the per-URL structs; zeros for no URL."""
    means, maxes = [], []
    for name, _, _ in spec:
        vals = feats.getField(name)
        total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
        means.append(F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias(f"mean_{name}"))
        maxes.append(F.coalesce(F.array_max(vals), F.lit(0.0)).alias(f"max_{name}"))
    return means + maxes


def email_url_features_inrow(df: DataFrame, spec: list[Feature] = FEATURES_54,
                             text_col: str = "raw_text", keep: tuple[str, ...] = ("email_id", "y")) -> DataFrame:
    """Per-email URL vector without leaving the row: extract -> parse -> features -> mean/max.

    Each step is its own projection so the URL array and the per-URL structs are
    computed once per email and then read by all 2 x len(spec) aggregates.
    """
    step = df.select(*keep, extract_urls(text_col).alias("urls"))
    step = step.select(*keep, F.size("urls").alias("n_urls"),
                       F.transform("urls", url_parts).alias("parts0"))
    # host / path / nowww are built in their own pass over the array, so the
    # 54 feature expressions read finished struct fields instead of each
    # re-deriving them (the optimizer would inline a struct built in the lambda).
    step = step.select(*keep, "n_urls", F.transform("parts0", finish_parts).alias("parts"))
    step = step.select(*keep, "n_urls",
                       F.transform("parts", lambda p: feature_struct(p, spec)).alias("feats"))
    return step.select(*keep, "n_urls", *inrow_aggregates(F.col("feats"), F.col("n_urls"), spec))


def to_model_width(vector: Column, width: int) -> Column:
    """A feature vector cut, or filled up with zeros, to the width a model was fitted on."""
    head = F.slice(vector, 1, width)
    return F.concat(head, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(head)))


def score_with_prior(agent, df: DataFrame, cols: list[str], out: str = "p_lexical", prior: float = 0.5) -> DataFrame:
    """Score URL vectors with a linear agent fitted on other columns: ``cols`` in order, cut or
    filled up to the agent's width; an email without URLs scores exactly ``prior``."""
    width = len(agent.cols)
    x = df.withColumn("_v", to_model_width(F.array(*[F.col(c).cast("double") for c in cols]), width))
    named = x.select(*[F.col(c).alias(f"_in_{c}") for c in df.columns],
                     *[F.col("_v")[i].alias(c) for i, c in enumerate(agent.cols)])
    s = agent.score(named, "_score")
    p = F.when(F.col("_in_n_urls") == 0, F.lit(prior)).otherwise(F.col("_score"))
    return s.select(*[F.col(f"_in_{c}").alias(c) for c in df.columns], p.alias(out))


def email_url_features_exploded(df: DataFrame, spec: list[Feature] = FEATURES_54,
                                text_col: str = "raw_text", keep: tuple[str, ...] = ("email_id", "y")) -> DataFrame:
    one = df.select(*keep, F.explode_outer(extract_urls(text_col)).alias("url"))
    parsed = one.select(*keep, "url", parts_of(F.col("url")).alias("p"))
    per_url = parsed.select(*keep, "url", *[fn(F.col("p")).cast("double").alias(n) for n, fn, _ in spec])
    aggs = ([F.count("url").alias("n_urls")]
            + [F.coalesce(F.avg(n), F.lit(0.0)).alias(f"mean_{n}") for n, _, _ in spec]
            + [F.coalesce(F.max(n), F.lit(0.0)).alias(f"max_{n}") for n, _, _ in spec])
    key, rest = keep[0], keep[1:]
    return per_url.groupBy(key).agg(*[F.first(c).alias(c) for c in rest], *aggs) \
                  .select(*keep, "n_urls", *agg_names(spec))


def exploded_urls(df: DataFrame, key: str = "email_id", text_col: str = "raw_text") -> DataFrame:
    """``(key, pos, url)``: one row per URL occurrence, 0-based position."""
    return df.select(key, F.posexplode(extract_urls(text_col)).alias("pos", "url"))
