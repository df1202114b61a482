"""Score fusion and the action policies, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.constants import ACTIONS, DELTA_BLOCK, FUSION_WEIGHTS, V0_MIRROR, V0_QUARANTINE


def check_weights(weights) -> tuple[float, float, float]:
    w = tuple(float(x) for x in weights)
    if len(w) != 3 or abs(sum(w) - 1.0) >= 1e-6:
        raise ValueError(f"fusion weights must be 3 numbers summing to 1, got {weights}")
    return w


def late_fusion(p_sem: Column, p_txt: Column, p_lex: Column, weights=FUSION_WEIGHTS) -> Column:
    """w_s * p_semantic + w_t * p_textual + w_l * p_lexical (weights checked at plan time)."""
    ws, wt, wl = check_weights(weights)
    return F.lit(ws) * p_sem + F.lit(wt) * p_txt + F.lit(wl) * p_lex


def tau_block(tau_cal: Column, delta: float = DELTA_BLOCK) -> Column:
    return F.least(F.lit(1.0), tau_cal + F.lit(delta))


def policy_v0(score: Column, quarantine: float = V0_QUARANTINE, mirror: float = V0_MIRROR) -> Column:
    """Two fixed tiers: quarantine / mirror / deliver."""
    return (F.when(score >= quarantine, F.lit("quarantine"))
             .when(score >= mirror, F.lit("mirror"))
             .otherwise(F.lit("deliver")))


def policy_tiers(score: Column, tau_cal: Column, tau_blk: Column) -> Column:
    """Calibrated three tiers: BLOCK at or above tau_block, MONITOR at or above tau_cal, else ALLOW."""
    return (F.when(score >= tau_blk, F.lit("BLOCK"))
             .when(score >= tau_cal, F.lit("MONITOR"))
             .otherwise(F.lit("ALLOW")))


def enforcement(action: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, text in reversed(list(ACTIONS.items())):
        out = F.when(action == a, F.lit(text)).otherwise(out)
    return out
