"""Cross-validated evaluation of fused agent scores.

Inputs are score tables, so the same plan evaluates the deterministic
``scored`` view and the fitted agents of ``plans.cv``:

* ``cal``  -- (train_fold, email_id, y, p_fused) scores of each fold's calibration rows
* ``test`` -- (fold, email_id, y, p_fused) scores of each fold's test rows
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ALPHA, DELTA_BLOCK, FUSION_WEIGHTS, N_FOLDS, SEED
from ..operators.folds import holdout_split, stratified_folds
from ..operators.metrics import confusion, rates
from ..operators.policy import enforcement, late_fusion, policy_tiers, tau_block
from ..operators.calibrate import search_threshold
from ..operators.roc import auc, roc_points


def fuse(scored: DataFrame, weights=FUSION_WEIGHTS) -> DataFrame:
    return scored.withColumn("p_fused", late_fusion(F.col("p_semantic"), F.col("p_textual"),
                                                    F.col("p_lexical"), weights))


def thresholds(cal: DataFrame, alpha: float = ALPHA, delta: float = DELTA_BLOCK) -> DataFrame:
    """(fold, tau_cal, tau_block, feasible, tpr_at_tau, fpr_at_tau): one row per fold."""
    th = search_threshold(cal, ["train_fold"], "p_fused", "y", alpha)
    return th.select(F.col("train_fold").alias("fold"), "tau_cal",
                     tau_block(F.col("tau_cal"), delta).alias("tau_block"),
                     "feasible", "tpr_at_tau", "fpr_at_tau")


def decide(test: DataFrame, th: DataFrame) -> DataFrame:
    """Attach the fold's thresholds (one row a fold, so broadcast without a count) and apply the
    three-tier policy. A fold without a threshold keeps its rows, undecided as ALLOW."""
    t = test.join(F.broadcast(th.select("fold", "tau_cal", "tau_block")), "fold", "left")
    return t.select("*", (F.col("p_fused") >= F.col("tau_cal")).cast("int").alias("y_pred"),
                    policy_tiers(F.col("p_fused"), F.col("tau_cal"), F.col("tau_block")).alias("action")) \
            .withColumn("sdn_action", enforcement(F.col("action")))


def decision_record(decided: DataFrame, digits: int) -> DataFrame:
    """The full record of each decision: agent and fused scores, thresholds, action, enforcement."""
    scores = [F.round(c, digits).alias(c) for c in ("p_fused", "p_semantic", "p_textual", "p_lexical", "tau_cal", "tau_block")]
    return decided.select("fold", "email_id", *scores, "action", "sdn_action")


def fold_metrics(decided: DataFrame, th: DataFrame) -> DataFrame:
    """Per fold: confusion counts, rounded metrics, AUC of the test scores and tau_cal."""
    counts = rates(confusion(decided, ["fold"]))
    a = auc(roc_points(decided, ["fold"], "p_fused", "y", max_groups=N_FOLDS), ["fold"])
    return counts.join(a, "fold", "left").join(th.select("fold", "tau_cal"), "fold", "left") \
                 .select("fold", "TP", "FP", "TN", "FN", "accuracy", "precision", "recall", "f1", "fpr",
                         F.round("auc", 4).alias("auc"), F.round("tau_cal", 4).alias("tau_cal"))


def split_scored(scored: DataFrame, k: int = N_FOLDS, seed: int = SEED):
    """Fold-independent scores -> (folded, cal, test) tables."""
    folded = stratified_folds(scored, "email_id", "y", k, seed)
    hold = holdout_split(folded, "email_id", k, seed=seed)
    cal = hold.where(F.col("is_cal")).select("train_fold", "email_id", "y", "p_fused")
    agents = [c for c in ("p_semantic", "p_textual", "p_lexical") if c in folded.columns]
    test = folded.select("fold", "email_id", "y", *agents, "p_fused")
    return folded, hold, cal, test


def evaluate_scored(scored: DataFrame, weights=FUSION_WEIGHTS, alpha: float = ALPHA,
                    k: int = N_FOLDS, seed: int = SEED) -> dict[str, DataFrame]:
    folded, hold, cal, test = split_scored(fuse(scored, weights), k, seed)
    th = thresholds(cal, alpha)
    decided = decide(test, th)
    return {"folded": folded, "holdout": hold, "thresholds": th, "decided": decided,
            "fold_metrics": fold_metrics(decided, th)}
