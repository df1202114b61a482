"""Catalog entries: folds, splits, ROC, calibration, policy and metrics on the ``scored`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.constants import ALPHA
from ..operators.folds import fold_complement, fold_complement_by_filter, holdout_cuts, holdout_split, stratified_folds
from ..operators.metrics import confusion, cv_pooled, cv_summary, rates
from ..operators.policy import late_fusion
from ..operators.rank import prefix_sums
from ..operators.roc import auc, roc_points, with_origin
from ..operators.calibrate import search_threshold
from ..session import scratch_path
from ..sources.published import current, publish
from ..sources.tables import agent_score, scored, table, urls
from . import oracle_sql as O
from .evaluate import decide, decision_record, evaluate_scored, fuse, split_scored, thresholds
from .registry import register

W = "0.3333333333333333::DOUBLE"
FUSED = f"{W} * p_semantic + {W} * p_textual + {W} * p_lexical"
NAN = "'nan'::DOUBLE"


def h15(seed_sql: str, key: str) -> str:
    return f"('0x' || substr(md5({seed_sql} || ':' || cast({key} AS varchar)), 1, 15))::UBIGINT"


FOLDS_CTE = f"""s AS (SELECT *, {FUSED} AS p_fused FROM scored),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY {h15("'42'", 'email_id')}, email_id) - 1) % 4 + 1 AS INTEGER) AS fold FROM s)"""
HOLD_CTE = f"""t AS (SELECT f.*, CAST(k.range AS INTEGER) AS train_fold FROM f JOIN range(1, 5) k ON f.fold <> k.range),
hr AS (SELECT *, row_number() OVER (PARTITION BY train_fold ORDER BY {h15('cast(42 + train_fold AS varchar)', 'email_id')}, email_id) AS r,
              count(*) OVER (PARTITION BY train_fold) AS n FROM t),
h AS (SELECT *, r <= floor(0.2::DOUBLE * n) AS is_cal FROM hr)"""


def roc_cte(name: str, source: str, group: str, score: str = "p_fused") -> str:
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    return f"""{name}_inc AS (SELECT {g}{score} AS score, sum(y) AS tp_d, sum(1 - y) AS fp_d FROM {source} GROUP BY {g}{score}),
{name}_cum AS (SELECT *, sum(tp_d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
              sum(fp_d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
              sum(tp_d) OVER ({part}) AS n_pos, sum(fp_d) OVER ({part}) AS n_neg,
              lead(tp_d) OVER w AS ntp, lead(fp_d) OVER w AS nfp
       FROM {name}_inc WINDOW w AS ({part} ORDER BY score DESC)),
{name} AS (SELECT *, CASE WHEN n_pos > 0 THEN tp / n_pos ELSE {NAN} END AS tpr,
                     CASE WHEN n_neg > 0 THEN fp / n_neg ELSE {NAN} END AS fpr,
                     (tp = tp_d AND fp = fp_d) OR ntp IS NULL OR ntp <> tp_d OR nfp <> fp_d AS kept
           FROM {name}_cum)"""


def calib_cte(name: str, pts: str, group: str, pruned: bool = True) -> str:
    cond = f"fpr <= {ALPHA}::DOUBLE AND tp > 0" + (" AND kept" if pruned else "")
    return f"""{name} AS (SELECT {group},
        coalesce(first(score ORDER BY tp DESC, score DESC) FILTER (WHERE {cond}), min(score)) AS tau_cal,
        count(*) FILTER (WHERE {cond}) > 0 AS feasible,
        coalesce(first(tpr ORDER BY tp DESC, score DESC) FILTER (WHERE {cond}), CASE WHEN max(n_pos) > 0 THEN 1.0::DOUBLE ELSE {NAN} END) AS tpr_at_tau,
        coalesce(first(fpr ORDER BY tp DESC, score DESC) FILTER (WHERE {cond}), CASE WHEN max(n_neg) > 0 THEN 1.0::DOUBLE ELSE {NAN} END) AS fpr_at_tau
      FROM {pts} GROUP BY {group})"""


EVAL_CTES = [O.SCORED_CTE, FOLDS_CTE, HOLD_CTE,
             roc_cte("cal_roc", "(SELECT * FROM h WHERE is_cal)", "train_fold"),
             calib_cte("th0", "cal_roc", "train_fold"),
             "th AS (SELECT train_fold AS fold, tau_cal, least(1.0::DOUBLE, tau_cal + 0.1::DOUBLE) AS tau_block, feasible, tpr_at_tau, fpr_at_tau FROM th0)",
             """dec AS (SELECT f.fold, f.email_id, f.y, f.p_fused, th.tau_cal, th.tau_block,
                 CAST(f.p_fused >= th.tau_cal AS INTEGER) AS y_pred,
                 CASE WHEN f.p_fused >= th.tau_block THEN 'BLOCK' WHEN f.p_fused >= th.tau_cal THEN 'MONITOR' ELSE 'ALLOW' END AS action
               FROM f JOIN th ON f.fold = th.fold)""",
             """cm AS (SELECT fold, CAST(sum(CASE WHEN y = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP,
                 CAST(sum(CASE WHEN y = 0 AND y_pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FP,
                 CAST(sum(CASE WHEN y = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN,
                 CAST(sum(CASE WHEN y = 1 AND y_pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FN FROM dec GROUP BY fold)""",
             """mt AS (SELECT *, round(CASE WHEN TP+FP+TN+FN > 0 THEN (TP+TN)::DOUBLE/(TP+FP+TN+FN) ELSE 0.0 END, 4) AS accuracy,
                 round(CASE WHEN TP+FP > 0 THEN TP::DOUBLE/(TP+FP) ELSE 0.0 END, 4) AS precision,
                 round(CASE WHEN TP+FN > 0 THEN TP::DOUBLE/(TP+FN) ELSE 0.0 END, 4) AS recall,
                 round(CASE WHEN 2*TP+FP+FN > 0 THEN (2*TP)::DOUBLE/(2*TP+FP+FN) ELSE 0.0 END, 4) AS f1,
                 round(CASE WHEN FP+TN > 0 THEN FP::DOUBLE/(FP+TN) ELSE 0.0 END * 100.0::DOUBLE, 2) AS fpr FROM cm)""",
             roc_cte("test_roc", "dec", "fold"),
             """ta AS (SELECT fold, CASE WHEN max(n_pos) * max(n_neg) > 0 THEN sum(fp_d::DOUBLE * (2 * tp - tp_d)::DOUBLE) / (2.0 * max(n_pos)::DOUBLE * max(n_neg)::DOUBLE) END AS auc FROM test_roc GROUP BY fold)""",
             """fm AS (SELECT mt.fold, TP, FP, TN, FN, accuracy, precision, recall, f1, fpr, round(ta.auc, 4) AS auc, round(th.tau_cal, 4) AS tau_cal
               FROM mt LEFT JOIN ta ON mt.fold = ta.fold LEFT JOIN th ON mt.fold = th.fold)"""]
EVAL = O.with_ctes(*EVAL_CTES)


def _eval(spark, sf_dir):
    return evaluate_scored(scored(spark, sf_dir))


@register("ml_late_fusion", O.with_ctes(O.SCORED_CTE) + f"SELECT email_id, y, round({FUSED}, 6) AS p_fused FROM scored")
def ml_late_fusion(spark, sf_dir):
    s = fuse(scored(spark, sf_dir))
    return s.select("email_id", "y", F.round("p_fused", 6).alias("p_fused"))


@register("join_agent_scores", O.with_ctes(O.SCORED_CTE) + f"""
SELECT email_id, y, round(p_semantic, 6) AS p_semantic, round(p_textual, 6) AS p_textual,
       round(p_lexical, 6) AS p_lexical, round({FUSED}, 6) AS p_fused FROM scored""")
def join_agent_scores(spark, sf_dir):
    """Each agent scores in its own job; the three tables meet on email_id."""
    lab = table(spark, sf_dir, "labels")
    k, y = F.col("doc_id"), F.col("toxic")
    parts = [lab.select(k.alias("email_id"), agent_score(tag, k, y).alias(name))
             for tag, name in (("sem", "p_semantic"), ("txt", "p_textual"), ("lex", "p_lexical"))]
    j = lab.select(k.alias("email_id"), y.alias("y")).join(parts[0], "email_id").join(parts[1], "email_id") \
           .join(parts[2], "email_id")
    j = fuse(j)
    return j.select("email_id", "y", *[F.round(c, 6).alias(c) for c in ("p_semantic", "p_textual", "p_lexical", "p_fused")])


@register("win_stratified_folds", O.with_ctes(O.SCORED_CTE, FOLDS_CTE) + "SELECT email_id, y, fold FROM f")
def win_stratified_folds(spark, sf_dir):
    return stratified_folds(scored(spark, sf_dir)).select("email_id", "y", "fold")


@register("win_holdout_split", O.with_ctes(O.SCORED_CTE, FOLDS_CTE, HOLD_CTE) +
          "SELECT train_fold, email_id, y, is_cal FROM h")
def win_holdout_split(spark, sf_dir):
    return holdout_split(stratified_folds(scored(spark, sf_dir))).select("train_fold", "email_id", "y", "is_cal")


@register("agg_split_sizes", O.with_ctes(O.SCORED_CTE, FOLDS_CTE, HOLD_CTE) + """
SELECT h.train_fold AS fold, CAST(sum(CASE WHEN NOT is_cal THEN 1 ELSE 0 END) AS BIGINT) AS n_fit,
       CAST(sum(CASE WHEN is_cal THEN 1 ELSE 0 END) AS BIGINT) AS n_cal,
       CAST(any_value(tst.n) AS BIGINT) AS n_test
FROM h JOIN (SELECT fold, count(*) AS n FROM f GROUP BY fold) tst ON tst.fold = h.train_fold
GROUP BY h.train_fold""")
def agg_split_sizes(spark, sf_dir):
    folded = stratified_folds(scored(spark, sf_dir))
    sizes = holdout_cuts(folded).select(F.col("train_fold").alias("fold"),
                                        (F.col("n_train") - F.col("n_cal")).cast("bigint").alias("n_fit"),
                                        F.col("n_cal").cast("bigint").alias("n_cal"))
    tests = folded.groupBy("fold").agg(F.count(F.lit(1)).cast("bigint").alias("n_test"))
    return sizes.join(tests, "fold")


_COMPLEMENT_SQL = O.with_ctes(O.SCORED_CTE, FOLDS_CTE, HOLD_CTE) + "SELECT train_fold, email_id, y, fold FROM t"


@register("join_fold_complement", _COMPLEMENT_SQL)
def join_fold_complement(spark, sf_dir):
    return fold_complement(stratified_folds(scored(spark, sf_dir))).select("train_fold", "email_id", "y", "fold")


@register("set_train_complement", _COMPLEMENT_SQL)
def set_train_complement(spark, sf_dir):
    return fold_complement_by_filter(stratified_folds(scored(spark, sf_dir))).select("train_fold", "email_id", "y", "fold")


@register("filt_subset_gather", O.with_ctes(O.SCORED_CTE, FOLDS_CTE, HOLD_CTE) +
          "SELECT train_fold, email_id, y, round(p_fused, 6) AS p_fused FROM h WHERE is_cal")
def filt_subset_gather(spark, sf_dir):
    _, _, cal, _ = split_scored(fuse(scored(spark, sf_dir)))
    return cal.select("train_fold", "email_id", "y", F.round("p_fused", 6).alias("p_fused"))


@register("join_fold_alignment", O.with_ctes(O.SCORED_CTE, FOLDS_CTE, O.URLS_CTE) + f"""
, uf AS (SELECT url_id, CAST((row_number() OVER (PARTITION BY y ORDER BY {h15("'42'", 'url_id')}, url_id) - 1) % 4 + 1 AS INTEGER) AS fold FROM urls)
SELECT k.fold, CAST(e.n_train AS BIGINT) AS email_train, CAST(e.n_test AS BIGINT) AS email_test,
       CAST(u.n_train AS BIGINT) AS url_train, CAST(u.n_test AS BIGINT) AS url_test
FROM (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 5)) k
JOIN (SELECT k2.range AS fold, sum(CASE WHEN f.fold <> k2.range THEN 1 ELSE 0 END) AS n_train, sum(CASE WHEN f.fold = k2.range THEN 1 ELSE 0 END) AS n_test
      FROM f CROSS JOIN range(1, 5) k2 GROUP BY k2.range) e ON e.fold = k.fold
JOIN (SELECT k3.range AS fold, sum(CASE WHEN uf.fold <> k3.range THEN 1 ELSE 0 END) AS n_train, sum(CASE WHEN uf.fold = k3.range THEN 1 ELSE 0 END) AS n_test
      FROM uf CROSS JOIN range(1, 5) k3 GROUP BY k3.range) u ON u.fold = k.fold""")
def join_fold_alignment(spark, sf_dir):
    """Email fold k trains with URL-table fold k: both tables use the same fold numbering."""
    ef = stratified_folds(scored(spark, sf_dir)).groupBy("fold").count()
    uf = stratified_folds(urls(spark, sf_dir), key="url_id").groupBy("fold").count()
    e_tot, u_tot = F.sum("e_n").over(_all()), F.sum("u_n").over(_all())
    j = ef.select("fold", F.col("count").alias("e_n")).join(uf.select("fold", F.col("count").alias("u_n")), "fold")
    return j.select("fold", (e_tot - F.col("e_n")).cast("bigint").alias("email_train"), F.col("e_n").cast("bigint").alias("email_test"),
                    (u_tot - F.col("u_n")).cast("bigint").alias("url_train"), F.col("u_n").cast("bigint").alias("url_test"))


def _all():
    from pyspark.sql import Window
    return Window.partitionBy()   # over the k-row per-fold table only


@register("win_running_sum", O.with_ctes(O.SCORED_CTE, "s AS (SELECT *, " + FUSED + " AS p_fused FROM scored)",
                                         roc_cte("r", "s", "")) +
          "SELECT round(score, 6) AS score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM r")
def win_running_sum(spark, sf_dir):
    pts = roc_points(fuse(scored(spark, sf_dir)), [], "p_fused", "y")
    return pts.select(F.round("score", 6).alias("score"), F.col("tp").cast("bigint").alias("tp"),
                      F.col("fp").cast("bigint").alias("fp"))


_ROC_SELECT = """SELECT train_fold, round(score, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM"""


@register("agg_roc_curve", EVAL + _ROC_SELECT + """ (
  SELECT train_fold, score, tp, fp, tpr, fpr FROM cal_roc
  UNION ALL SELECT DISTINCT train_fold, 'inf'::DOUBLE, 0, 0, CASE WHEN n_pos > 0 THEN 0.0 ELSE 'nan'::DOUBLE END,
                   CASE WHEN n_neg > 0 THEN 0.0 ELSE 'nan'::DOUBLE END FROM cal_roc)""")
def agg_roc_curve(spark, sf_dir):
    _, _, cal, _ = split_scored(fuse(scored(spark, sf_dir)))
    pts = with_origin(roc_points(cal, ["train_fold"], "p_fused", "y"), ["train_fold"])
    return _roc_out(pts)


def _roc_out(pts):
    return pts.select("train_fold", F.round("score", 6).alias("threshold"), F.col("tp").cast("bigint").alias("tp"),
                      F.col("fp").cast("bigint").alias("fp"), F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@register("win_roc_prune", EVAL + _ROC_SELECT + """ (
  SELECT train_fold, score, tp, fp, tpr, fpr FROM cal_roc WHERE kept
  UNION ALL SELECT DISTINCT train_fold, 'inf'::DOUBLE, 0, 0, CASE WHEN n_pos > 0 THEN 0.0 ELSE 'nan'::DOUBLE END,
                   CASE WHEN n_neg > 0 THEN 0.0 ELSE 'nan'::DOUBLE END FROM cal_roc)""")
def win_roc_prune(spark, sf_dir):
    _, _, cal, _ = split_scored(fuse(scored(spark, sf_dir)))
    pts = roc_points(cal, ["train_fold"], "p_fused", "y", prune=True).where("kept")
    return _roc_out(with_origin(pts, ["train_fold"]))


@register("agg_auc", O.with_ctes(O.SCORED_CTE, "s AS (SELECT *, " + FUSED + " AS p_fused FROM scored)",
                                 *[roc_cte(f"r_{n}", "s", "", n) for n in ("p_semantic", "p_textual", "p_lexical", "p_fused")]) +
          "SELECT " + ", ".join(
              f"(SELECT round(CASE WHEN max(n_pos) * max(n_neg) > 0 THEN sum(fp_d::DOUBLE * (2 * tp - tp_d)::DOUBLE) / (2.0 * max(n_pos)::DOUBLE * max(n_neg)::DOUBLE) END, 6) FROM r_{n}) AS auc_{n[2:]}"
              for n in ("p_semantic", "p_textual", "p_lexical", "p_fused")))
def agg_auc(spark, sf_dir):
    s = fuse(scored(spark, sf_dir))
    names = ("p_semantic", "p_textual", "p_lexical", "p_fused")
    # all four curves in one pass: rows by agent, one group each
    long = s.unpivot("y", list(names), "agent", "score")
    each = auc(roc_points(long, ["agent"], "score", "y", max_groups=len(names)), ["agent"])
    return each.agg(*[F.round(F.max(F.when(F.col("agent") == n, F.col("auc"))), 6).alias(f"auc_{n[2:]}") for n in names])


_CAL_SELECT = "SELECT fold, round(tau_cal, 6) AS tau_cal, feasible, round(tpr_at_tau, 6) AS tpr_at_tau, round(fpr_at_tau, 6) AS fpr_at_tau FROM th"


@register("agg_calibrate", EVAL + _CAL_SELECT)
def agg_calibrate(spark, sf_dir):
    th = _eval(spark, sf_dir)["thresholds"]
    return th.select("fold", F.round("tau_cal", 6).alias("tau_cal"), "feasible",
                     F.round("tpr_at_tau", 6).alias("tpr_at_tau"), F.round("fpr_at_tau", 6).alias("fpr_at_tau"))


@register("argmax_threshold", O.with_ctes(*EVAL_CTES[:4], calib_cte("am", "cal_roc", "train_fold", pruned=False)) +
          "SELECT train_fold AS fold, round(tau_cal, 6) AS tau_cal, feasible FROM am")
def argmax_threshold(spark, sf_dir):
    """Best TPR under the FPR ceiling over every distinct score (no collinear-point pruning)."""
    _, _, cal, _ = split_scored(fuse(scored(spark, sf_dir)))
    th = search_threshold(cal, ["train_fold"], "p_fused", "y", prune=False)
    return th.select(F.col("train_fold").alias("fold"), F.round("tau_cal", 6).alias("tau_cal"), "feasible")


@register("agg_tau_block", EVAL + "SELECT fold, round(tau_cal, 6) AS tau_cal, round(tau_block, 6) AS tau_block FROM th")
def agg_tau_block(spark, sf_dir):
    th = _eval(spark, sf_dir)["thresholds"]
    return th.select("fold", F.round("tau_cal", 6).alias("tau_cal"), F.round("tau_block", 6).alias("tau_block"))


@register("join_fold_threshold", EVAL + "SELECT fold, email_id, round(p_fused, 6) AS p_fused, round(tau_cal, 6) AS tau_cal, round(tau_block, 6) AS tau_block FROM dec")
def join_fold_threshold(spark, sf_dir):
    d = _eval(spark, sf_dir)["decided"]
    return d.select("fold", "email_id", *[F.round(c, 6).alias(c) for c in ("p_fused", "tau_cal", "tau_block")])


@register("proj_threshold_predict", EVAL + "SELECT fold, email_id, y, y_pred FROM dec")
def proj_threshold_predict(spark, sf_dir):
    return _eval(spark, sf_dir)["decided"].select("fold", "email_id", "y", "y_pred")


RECORD = """SELECT d.fold, d.email_id, round(d.p_fused, {n}) AS p_fused, round(s.p_semantic, {n}) AS p_semantic,
  round(s.p_textual, {n}) AS p_textual, round(s.p_lexical, {n}) AS p_lexical, round(d.tau_cal, {n}) AS tau_cal,
  round(d.tau_block, {n}) AS tau_block, d.action,
  CASE action WHEN 'BLOCK' THEN 'quarantine_via_simulated_southbound_API' WHEN 'MONITOR' THEN 'mirror_to_analysis_vlan_tag_for_review'
              ELSE 'deliver_without_intervention' END AS sdn_action
FROM dec d JOIN scored s ON s.email_id = d.email_id"""


@register("ml_policy", EVAL + RECORD.format(n=4))
def ml_policy(spark, sf_dir):
    return decision_record(_eval(spark, sf_dir)["decided"], 4)


@register("agg_confusion", EVAL + "SELECT fold, TP, FP, TN, FN FROM cm")
def agg_confusion(spark, sf_dir):
    return confusion(_eval(spark, sf_dir)["decided"], ["fold"])


@register("agg_prf", EVAL + "SELECT fold, accuracy, precision, recall, f1 FROM mt")
def agg_prf(spark, sf_dir):
    return rates(confusion(_eval(spark, sf_dir)["decided"], ["fold"])).select("fold", "accuracy", "precision", "recall", "f1")


@register("agg_fpr", EVAL + "SELECT fold, fpr FROM mt")
def agg_fpr(spark, sf_dir):
    return rates(confusion(_eval(spark, sf_dir)["decided"], ["fold"])).select("fold", "fpr")


_FM_LONG = """, lg AS (UNPIVOT (SELECT fold, accuracy::DOUBLE AS accuracy, precision::DOUBLE AS precision, recall::DOUBLE AS recall,
                               f1::DOUBLE AS f1, fpr::DOUBLE AS fpr, auc::DOUBLE AS auc FROM fm)
             ON accuracy, precision, recall, f1, fpr, auc INTO NAME metric VALUE value)
"""


@register("agg_cv_summary", EVAL + _FM_LONG + "SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM lg GROUP BY metric")
def agg_cv_summary(spark, sf_dir):
    return cv_summary(_eval(spark, sf_dir)["fold_metrics"])


@register("agg_cv_pooled", EVAL + "SELECT CAST(sum(TP) AS BIGINT) AS TP, CAST(sum(FP) AS BIGINT) AS FP, CAST(sum(TN) AS BIGINT) AS TN, CAST(sum(FN) AS BIGINT) AS FN FROM fm")
def agg_cv_pooled(spark, sf_dir):
    return cv_pooled(_eval(spark, sf_dir)["fold_metrics"])


@register("sink_fold_metrics", EVAL + "SELECT * FROM fm")
def sink_fold_metrics(spark, sf_dir):
    path = scratch_path(spark, "fold-metrics")
    _eval(spark, sf_dir)["fold_metrics"].write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@register("sink_thresholds", EVAL + "SELECT fold, tau_cal, tau_block FROM th")
def sink_thresholds(spark, sf_dir):
    root = scratch_path(spark, "thresholds")
    th = _eval(spark, sf_dir)["thresholds"].select("fold", "tau_cal", "tau_block")
    publish(spark, root, lambda folder: th.write.parquet(f"{folder}/thresholds"))
    return spark.read.parquet(f"{current(spark, root)}/thresholds")


@register("sink_decisions", EVAL + RECORD.format(n=6))
def sink_decisions(spark, sf_dir):
    path = scratch_path(spark, "decisions")
    d = decision_record(_eval(spark, sf_dir)["decided"], 6)
    # the sink also holds the time of the decision, which no two runs share
    d.withColumn("decided_at", F.current_timestamp()).write.mode("overwrite").partitionBy("action").parquet(path)
    return spark.read.parquet(path).select(*d.columns)
