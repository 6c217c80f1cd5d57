"""B4-B5 queries: split report, restriction audit, metrics, threshold sweep,
operating points and the one-time test evaluation, on a fixed linear score
``least(1, amount / 500)`` so every step has an oracle."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import splits as S
from .catalog import ledger, register
from .sql import with_ledger

SCORE_SQL = "least(1.0, amount / 500.0)"
M_CTE = f"""m AS (
  SELECT step, type, isFraud, {SCORE_SQL} AS score,
    CASE WHEN step BETWEEN 1 AND 504 THEN 'train' WHEN step BETWEEN 505 AND 611 THEN 'val'
         WHEN step >= 612 THEN 'test' END AS split
  FROM ledger WHERE type IN ('TRANSFER', 'CASH_OUT'))"""


def scored(spark, sf_dir):
    led = S.with_split(S.modelling_universe(ledger(spark, sf_dir)))
    return led.withColumn("score", F.least(F.lit(1.0), F.col("amount") / 500.0))


@register("split_report", with_ledger(M_CTE) + """
SELECT split, count(*) AS rows, cast(sum(isFraud) AS BIGINT) AS fraud_rows,
  round(sum(isFraud) / count(*) * 100, 6) AS fraud_rate_pct,
  round(CASE WHEN sum(isFraud) > 0 THEN (count(*) - sum(isFraud)) / sum(isFraud) END, 1) AS imbalance_ratio
FROM m WHERE split IS NOT NULL GROUP BY split""")
def split_report(spark, sf_dir):
    """Rows and positives per chronological split."""
    return S.split_report(S.with_split(S.modelling_universe(ledger(spark, sf_dir))))


@register("restriction_audit", with_ledger() + """
SELECT count(*) AS all_types_rows, count(CASE WHEN isFraud = 1 THEN 1 END) AS all_types_fraud_rows,
  round(count(CASE WHEN isFraud = 1 THEN 1 END) / count(*) * 100, 6) AS all_types_fraud_pct,
  count(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') THEN 1 END) AS restricted_rows,
  count(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND isFraud = 1 THEN 1 END) AS restricted_fraud_rows,
  round(count(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND isFraud = 1 THEN 1 END)
        / count(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') THEN 1 END) * 100, 6) AS restricted_fraud_pct,
  round(count(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND isFraud = 1 THEN 1 END)
        / count(CASE WHEN isFraud = 1 THEN 1 END) * 100, 4) AS pct_of_all_fraud_retained_in_restricted,
  round((1 - count(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') THEN 1 END) / count(*)) * 100, 2) AS row_reduction_pct,
  count(CASE WHEN type IN ('TRANSFER', 'CASH_OUT') AND isFraud = 1 THEN 1 END)
    = count(CASE WHEN isFraud = 1 THEN 1 END) AS all_fraud_retained
FROM ledger""")
def restriction_audit(spark, sf_dir):
    """A24 / Q-8: restriction effect; the job asserts no fraud is lost."""
    audit = S.restriction_audit(ledger(spark, sf_dir))
    S.assert_no_fraud_lost(audit)
    return audit


def _eval_sql(split: str, threshold_sql: str, extra_from: str = "", mode_col: str = "") -> str:
    """Evaluate() as SQL for one split at one threshold expression."""
    targets = [50, 70, 80, 90]
    pr = ",\n".join(
        f"""  (SELECT round(max(prec), 6) FROM cc WHERE rec >= {t / 100}) AS precision_at_recall_{t},
  (SELECT round(max(rec), 6) FROM cc WHERE rec >= {t / 100}
     AND prec = (SELECT max(prec) FROM cc WHERE rec >= {t / 100})) AS actual_recall_{t}""" for t in targets)
    ctes = f"""
s AS (SELECT score, sum(isFraud) AS pos, count(*) - sum(isFraud) AS neg FROM m WHERE split = '{split}' GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM s),
t AS (SELECT sum(pos) AS "P", sum(neg) AS "NN" FROM s),
cc AS (SELECT c.*, "P", "NN", tp / (tp + fp) AS prec, CASE WHEN "P" > 0 THEN tp / "P" ELSE 0 END AS rec FROM c, t),
rk AS (
  SELECT round(sum(pos / "P" * prec), 6) AS pr_auc,
         round(sum(pos * ("NN" - fp + 0.5 * neg)) / (max("P") * max("NN")), 6) AS roc_auc,
         cast(max("P") + max("NN") AS BIGINT) AS n_samples, cast(max("P") AS BIGINT) AS n_fraud FROM cc),
cf AS (
  SELECT {mode_col} thr, count(CASE WHEN score >= thr AND isFraud = 1 THEN 1 END) AS tp,
    count(CASE WHEN score < thr AND isFraud = 0 THEN 1 END) AS tn,
    count(CASE WHEN score >= thr AND isFraud = 0 THEN 1 END) AS fp,
    count(CASE WHEN score < thr AND isFraud = 1 THEN 1 END) AS fn
  FROM m, (SELECT {mode_col} {threshold_sql} AS thr {extra_from}) th WHERE split = '{split}' GROUP BY ALL)"""
    sel = f"""
SELECT {"cf.mode," if mode_col else ""} rk.*, cf.tp, cf.tn, cf.fp, cf.fn,
  round(CASE WHEN cf.tp + cf.fp > 0 THEN cf.tp / (cf.tp + cf.fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN cf.tp + cf.fn > 0 THEN cf.tp / (cf.tp + cf.fn) ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * cf.tp + cf.fp + cf.fn > 0 THEN 2 * cf.tp / (2 * cf.tp + cf.fp + cf.fn) ELSE 0 END, 6) AS f1,
{pr},
  cf.thr AS threshold
FROM rk, cf"""
    return ctes, sel


def _eval_query(split, threshold_sql="0.5"):
    ctes, sel = _eval_sql(split, threshold_sql)
    return with_ledger(M_CTE, ctes) + sel


@register("score_metrics_val", _eval_query("val"))
def score_metrics_val(spark, sf_dir):
    """M2-M5: PR-AUC (average precision), ROC-AUC, confusion at 0.5 and
    precision at recall targets on the validation split."""
    d = scored(spark, sf_dir).where(F.col("split") == "val")
    return M.evaluate(d, 0.5)


@register("score_metrics_test", _eval_query("test"))
def score_metrics_test(spark, sf_dir):
    """M2-M5 on the test split."""
    d = scored(spark, sf_dir).where(F.col("split") == "test")
    return M.evaluate(d, 0.5)


SWEEP_CTE = """sw AS (
  SELECT t AS threshold,
    count(CASE WHEN score >= t AND isFraud = 1 THEN 1 END) AS tp, count(CASE WHEN score >= t AND isFraud = 0 THEN 1 END) AS fp,
    count(CASE WHEN score < t AND isFraud = 1 THEN 1 END) AS fn, count(CASE WHEN score < t AND isFraud = 0 THEN 1 END) AS tn
  FROM m, (SELECT cast(round(0.01 + 0.02 * i, 3) AS DOUBLE) AS t FROM range(0, 50) r(i)) ts WHERE split = 'val' GROUP BY t),
swr AS (
  SELECT threshold,
    round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
    round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
    fp, fn, tp, tn, round((tp + fp) / (tp + fp + fn + tn), 8) AS alert_rate FROM sw)"""


@register("threshold_sweep_val", with_ledger(M_CTE, SWEEP_CTE) + "SELECT * FROM swr")
def threshold_sweep_val(spark, sf_dir):
    """M7: 50-threshold sweep on the validation split."""
    return M.threshold_sweep(scored(spark, sf_dir).where(F.col("split") == "val"))


OP_CTE = """op AS (
  SELECT 'high_recall' AS mode, * FROM (
    SELECT * FROM swr WHERE recall >= 0.9 OR NOT EXISTS (SELECT 1 FROM swr WHERE recall >= 0.9)
    ORDER BY CASE WHEN EXISTS (SELECT 1 FROM swr WHERE recall >= 0.9) THEN precision ELSE recall END DESC, threshold
    LIMIT 1)
  UNION ALL
  SELECT 'balanced', * FROM (SELECT * FROM swr ORDER BY f1 DESC, threshold LIMIT 1)
  UNION ALL
  SELECT 'high_precision', * FROM (
    SELECT * FROM swr WHERE precision >= 0.8 OR NOT EXISTS (SELECT 1 FROM swr WHERE precision >= 0.8)
    ORDER BY CASE WHEN EXISTS (SELECT 1 FROM swr WHERE precision >= 0.8) THEN recall ELSE precision END DESC, threshold
    LIMIT 1))"""


@register("operating_points_val", with_ledger(M_CTE, SWEEP_CTE, OP_CTE) + "SELECT * FROM op")
def operating_points_val(spark, sf_dir):
    """High-recall, balanced and high-precision points from the sweep."""
    return M.operating_points(M.threshold_sweep(scored(spark, sf_dir).where(F.col("split") == "val")))


def _test_by_mode_sql():
    ctes, sel = _eval_sql("test", "threshold", extra_from="FROM op", mode_col="mode,")
    return with_ledger(M_CTE, SWEEP_CTE, OP_CTE, ctes) + sel


@register("test_by_mode", _test_by_mode_sql())
def test_by_mode(spark, sf_dir):
    """Each operating point's threshold applied once to the test split."""
    sc = scored(spark, sf_dir)
    points = M.operating_points(M.threshold_sweep(sc.where(F.col("split") == "val"))).select("mode", "threshold")
    test = sc.where(F.col("split") == "test")
    pts = [(r["mode"], r["threshold"]) for r in points.collect()]     # the three operating points
    return M.evaluate_at(test, pts)
