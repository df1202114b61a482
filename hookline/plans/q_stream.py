"""Catalog entries: the streaming score-and-route path."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.email_urls import email_url_features_inrow
from ..sources.tables import emails, table
from ..streaming.route import run_to_completion
from .flagship import PRIOR_FEATURES, flagship_sql, prior_decision
from .registry import register


def prior_route(df):
    vec = email_url_features_inrow(df, PRIOR_FEATURES)
    return prior_decision(vec)


@register("stream_score_route", flagship_sql())
def stream_score_route(spark, sf_dir):
    """Emails arrive as files; the fixed-prior score and the two-tier policy are applied in-stream."""
    got = run_to_completion(spark, emails(spark, sf_dir), prior_route, "route-prior")
    return got.select("email_id", "y", "n_urls", "score", "action")


@register("stream_score_route_fitted")
def stream_score_route_fitted(spark, sf_dir):
    """Raw mail arrives as files and is cleaned, featurised, encoded and scored in-stream, row by
    row, by fold 1's published agents and thresholds, which every micro-batch looks up anew."""
    from .cv import PublishedScorer, train_and_save
    _, folder, _ = train_and_save(spark, sf_dir, 1)
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")
    arriving = emails(spark, sf_dir).select("email_id", "y", "raw_text").join(vec, "email_id", "left")
    scorer = PublishedScorer(spark, folder, keep=("email_id", "y"))
    got = run_to_completion(spark, arriving, lambda df: scorer(df).withColumn("decided_at", F.current_timestamp()), "route-fitted")
    return got.select("email_id", "y", "p_fused", "p_semantic", "p_textual", "p_lexical", "tau_cal",
                      "tau_block", "action", "sdn_action")
