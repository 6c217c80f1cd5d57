"""B0-B2 queries: destination history, transaction features, step table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import history as H
from ..operators import steps as ST
from .catalog import features_table, ledger, r, register, supplier_ledger
from .sql import with_ledger

# ---------------------------------------------------------------- B0: W1+W2+J1
DEST_HISTORY_SQL = with_ledger("""
h AS (
  SELECT a.event_id, a.step, a.nameDest, a.amount,
         count(b.event_id) AS n, count(DISTINCT b.nameOrig) AS u,
         cast(coalesce(sum(cast(b.amount AS decimal(28,9))), 0) AS DOUBLE) AS tot, coalesce(max(b.amount), 0) AS mx
  FROM ledger a LEFT JOIN ledger b ON a.nameDest = b.nameDest AND b.step < a.step
  GROUP BY a.event_id, a.step, a.nameDest, a.amount
)""") + """
SELECT event_id, step, nameDest,
  cast(n AS BIGINT) AS hist_dest_txn_count,
  cast(u AS BIGINT) AS hist_dest_unique_origin_count,
  round(tot, 4) AS hist_dest_total_amount,
  round(mx, 4) AS hist_dest_max_amount,
  round(CASE WHEN n > 0 THEN tot / n ELSE 0 END, 6) AS hist_dest_avg_amount,
  cast(CASE WHEN n = 0 THEN 1 ELSE 0 END AS INT) AS destination_is_new,
  round(least(1000.0, CASE WHEN n > 0 AND tot / n > 0 THEN amount / (tot / n) ELSE 1.0 END), 6)
    AS amount_to_dest_avg_ratio
FROM h"""


def _dest_history_out(df):
    return df.select(
        "event_id", "step", "nameDest", "hist_dest_txn_count", "hist_dest_unique_origin_count",
        r("hist_dest_total_amount", 4).alias("hist_dest_total_amount"),
        r("hist_dest_max_amount", 4).alias("hist_dest_max_amount"),
        r("hist_dest_avg_amount").alias("hist_dest_avg_amount"),
        "destination_is_new", r("amount_to_dest_avg_ratio").alias("amount_to_dest_avg_ratio"))


@register("dest_history", DEST_HISTORY_SQL)
def dest_history(spark, sf_dir):
    """For every transaction: how many earlier-step payments, from how many
    distinct senders, of what total and maximum, its destination received."""
    return _dest_history_out(H.with_destination_features(ledger(spark, sf_dir), method="preagg"))


@register("dest_history_range", DEST_HISTORY_SQL)
def dest_history_range(spark, sf_dir):
    """Same answer through the direct range-frame plan (no pre-aggregation)."""
    return _dest_history_out(H.with_destination_features(ledger(spark, sf_dir), method="range"))


# ------------------------------------- heavier history bench: lineitem ledger
SUPPLIER_SQL = """
WITH sl AS (
  SELECT l.l_orderkey AS k, date_diff('day', DATE '1995-01-01', cast(l.l_shipdate AS DATE)) AS step,
    l.l_extendedprice AS amount, concat('C', cast(o.o_custkey AS varchar)) AS nameOrig,
    concat('S', cast(l.l_suppkey AS varchar)) AS nameDest
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
ps AS (SELECT nameDest, step, count(*) AS n, sum(amount) AS c, max(amount) AS mx
       FROM sl GROUP BY nameDest, step),
fs AS (SELECT nameDest, min(step) AS step FROM sl GROUP BY nameDest, nameOrig),
nu AS (SELECT nameDest, step, count(*) AS u FROM fs GROUP BY nameDest, step),
h AS (
  SELECT a.nameDest, a.step, coalesce(sum(b.n), 0) AS n, coalesce(sum(b.c), 0) AS tot,
         coalesce(max(b.mx), 0) AS mx,
         (SELECT count(*) FROM fs WHERE fs.nameDest = a.nameDest AND fs.step < a.step) AS u
  FROM ps a LEFT JOIN ps b ON a.nameDest = b.nameDest AND b.step < a.step GROUP BY a.nameDest, a.step)
SELECT nameDest, step, cast(sum(n) AS BIGINT) AS rows_at_step_x_prior_count,
  cast(count(*) AS BIGINT) AS txn_rows, cast(max(u) AS BIGINT) AS hist_dest_unique_origin_count,
  round(max(tot), 2) AS hist_dest_total_amount, round(max(mx), 2) AS hist_dest_max_amount
FROM sl JOIN h USING (nameDest, step) GROUP BY nameDest, step"""


@register("supplier_history", SUPPLIER_SQL)
def supplier_history(spark, sf_dir):
    """W1 + W2 on the lineitem ledger (supplier = destination, day steps):
    per (supplier, day), the rows that day, the sum over those rows of their
    prior count, and the prior distinct customers, total and maximum."""
    d = H.prior_history(supplier_ledger(spark, sf_dir))
    return d.groupBy("nameDest", "step").agg(
        F.sum("hist_dest_txn_count").cast("long").alias("rows_at_step_x_prior_count"),
        F.count(F.lit(1)).alias("txn_rows"),
        F.max("hist_dest_unique_origin_count").cast("long").alias("hist_dest_unique_origin_count"),
        F.round(F.max("hist_dest_total_amount"), 2).alias("hist_dest_total_amount"),
        F.round(F.max("hist_dest_max_amount"), 2).alias("hist_dest_max_amount"))


# ------------------------------------------------------- B1: all 25 features
FEATURE_CTES = """
h AS (
  SELECT a.event_id, count(b.event_id) AS n, count(DISTINCT b.nameOrig) AS u,
         cast(coalesce(sum(cast(b.amount AS decimal(28,9))), 0) AS DOUBLE) AS tot, coalesce(max(b.amount), 0) AS mx
  FROM ledger a LEFT JOIN ledger b ON a.nameDest = b.nameDest AND b.step < a.step
  GROUP BY a.event_id
),
ts AS (SELECT type, step, count(*) AS n, sum(cast(amount AS decimal(28,9))) AS s FROM ledger GROUP BY type, step),
th AS (
  SELECT a.type, a.step, sum(b.n) AS n, cast(sum(b.s) AS DOUBLE) AS s
  FROM ts a LEFT JOIN ts b ON a.type = b.type AND b.step < a.step GROUP BY a.type, a.step
),
cut AS (SELECT cast(floor(max(step) * 0.8) AS int) AS c FROM ledger),
p95 AS (
  SELECT type, quantile_cont(amount, 0.95) AS p FROM ledger WHERE step <= (SELECT c FROM cut) GROUP BY type
),
f AS (
  SELECT l.*, h.n, h.u, h.tot, h.mx, CASE WHEN h.n > 0 THEN h.tot / h.n ELSE 0 END AS av,
         CASE WHEN th.n > 0 THEN th.s / th.n END AS tav, p95.p
  FROM ledger l JOIN h USING (event_id) LEFT JOIN th USING (type, step) LEFT JOIN p95 USING (type)
),
feat AS (
  SELECT event_id, step, type, amount, nameOrig, nameDest, oldbalanceOrg, newbalanceOrig,
    oldbalanceDest, newbalanceDest, isFraud, isFlaggedFraud,
    ln(1 + amount) AS log_amount,
    oldbalanceOrg - newbalanceOrig AS balance_change_orig,
    oldbalanceOrg - amount - newbalanceOrig AS balance_error_orig,
    cast(newbalanceOrig = 0 AS INT) AS drained_to_zero,
    cast(oldbalanceOrg = 0 AS INT) AS origin_balance_zero_before,
    least(1000.0, CASE WHEN oldbalanceOrg > 0 THEN amount / oldbalanceOrg ELSE 1000.0 END)
      AS amount_to_origin_balance_ratio,
    newbalanceDest - oldbalanceDest AS balance_change_dest,
    oldbalanceDest + amount - newbalanceDest AS balance_error_dest,
    cast(oldbalanceDest = 0 AND newbalanceDest = 0 AND amount > 0 AS INT) AS dest_balance_artifact_flag,
    cast(step % 24 AS INT) AS hour_of_day,
    cast(floor(step / 24.0) AS INT) AS day_index,
    sin(2 * pi() * (step % 24) / 24.0) AS hour_sin,
    cos(2 * pi() * (step % 24) / 24.0) AS hour_cos,
    cast(type = 'TRANSFER' AS INT) AS is_transfer,
    cast(type = 'CASH_OUT' AS INT) AS is_cash_out,
    cast(type IN ('TRANSFER', 'CASH_OUT') AS INT) AS eligible_for_fraud_model,
    cast(n AS BIGINT) AS hist_dest_txn_count,
    cast(u AS BIGINT) AS hist_dest_unique_origin_count,
    tot AS hist_dest_total_amount, av AS hist_dest_avg_amount, mx AS hist_dest_max_amount,
    cast(n = 0 AS INT) AS destination_is_new,
    least(1000.0, CASE WHEN av > 0 THEN amount / av ELSE 1.0 END) AS amount_to_dest_avg_ratio,
    least(1000.0, CASE WHEN tav IS NOT NULL AND tav > 0 THEN amount / tav ELSE 1.0 END)
      AS amount_to_type_avg_ratio,
    cast(coalesce(amount > p, false) AS INT) AS high_amount_indicator
  FROM f
)"""


def with_features(*ctes: str) -> str:
    """WITH prefix exposing the engineered ledger as ``feat``."""
    return with_ledger(FEATURE_CTES, *ctes)


_FEATURE_ROUND = {
    "log_amount": 6, "balance_change_orig": 4, "balance_error_orig": 4,
    "amount_to_origin_balance_ratio": 6, "balance_change_dest": 4, "balance_error_dest": 4,
    "hour_sin": 6, "hour_cos": 6, "hist_dest_total_amount": 4, "hist_dest_avg_amount": 6,
    "hist_dest_max_amount": 4, "amount_to_dest_avg_ratio": 6, "amount_to_type_avg_ratio": 6,
}
_ENGINEERED = [
    "log_amount", "balance_change_orig", "balance_error_orig", "drained_to_zero",
    "origin_balance_zero_before", "amount_to_origin_balance_ratio", "balance_change_dest",
    "balance_error_dest", "dest_balance_artifact_flag", "hour_of_day", "day_index", "hour_sin",
    "hour_cos", "is_transfer", "is_cash_out", "eligible_for_fraud_model", "hist_dest_txn_count",
    "hist_dest_unique_origin_count", "hist_dest_total_amount", "hist_dest_avg_amount",
    "hist_dest_max_amount", "destination_is_new", "amount_to_dest_avg_ratio",
    "amount_to_type_avg_ratio", "high_amount_indicator",
]
FEATURES_SQL = with_features() + "SELECT event_id, step, type, isFraud, " + ", ".join(
    f"round({c}, {_FEATURE_ROUND[c]}) AS {c}" if c in _FEATURE_ROUND else c for c in _ENGINEERED) + " FROM feat"



def rounded_features(feats):
    cols = ["event_id", "step", "type", "isFraud"]
    out = []
    for c in cols + FE.ENGINEERED_COLUMNS:
        out.append(r(c, _FEATURE_ROUND[c]).alias(c) if c in _FEATURE_ROUND else F.col(c))
    return feats.select(*out)


@register("transaction_features", FEATURES_SQL)
def transaction_features(spark, sf_dir):
    """L1: the 25 engineered columns for every transaction."""
    feats, _, _ = FE.transaction_features(ledger(spark, sf_dir))
    return rounded_features(feats)


# ------------------------------------------------------------ B2: step table
STEP_CTES = """
fe AS (SELECT step, amount, isFraud, is_transfer, is_cash_out, high_amount_indicator AS high FROM feat),
agg AS (
  SELECT step, count(*) AS transaction_count, sum(is_transfer) AS transfer_count,
         sum(is_cash_out) AS cash_out_count, sum(amount) AS total_amount, avg(amount) AS average_amount,
         quantile_cont(amount, 0.5) AS median_amount, sum(high) AS high_amount_count,
         sum(isFraud) AS gt_fraud_count
  FROM fe GROUP BY step
),
w AS (
  SELECT *, gt_fraud_count / transaction_count AS gt_fraud_rate, step % 24 AS hod,
    coalesce(avg(transaction_count) OVER sh, avg(transaction_count) OVER al, transaction_count) AS btxn,
    coalesce(avg(average_amount) OVER sh, avg(average_amount) OVER al, average_amount) AS bamt
  FROM agg
  WINDOW sh AS (PARTITION BY step % 24 ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         al AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
w2 AS (
  SELECT *, avg(gt_fraud_rate) OVER (PARTITION BY hod ORDER BY step
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gtr
  FROM w
),
stp AS (
  SELECT step,
    cast(transaction_count AS BIGINT) AS transaction_count, cast(transfer_count AS BIGINT) AS transfer_count,
    cast(cash_out_count AS BIGINT) AS cash_out_count, total_amount, average_amount, median_amount,
    cast(high_amount_count AS BIGINT) AS high_amount_count, cast(gt_fraud_count AS BIGINT) AS gt_fraud_count,
    gt_fraud_rate, cast(hod AS INT) AS hour_of_day, cast(floor(step / 24.0) AS INT) AS day_index,
    btxn AS hist_avg_txn_count_same_hour, bamt AS hist_avg_amount_same_hour,
    coalesce(transaction_count / nullif(btxn, 0), 1.0) AS txn_count_vs_hour_baseline_ratio,
    coalesce(average_amount / nullif(bamt, 0), 1.0) AS amount_vs_hour_baseline_ratio,
    gtr AS gt_hist_avg_fraud_rate_same_hour
  FROM w2
)"""


def round_select(cols_round: dict, cols: list[str], src: str) -> str:
    return "SELECT " + ", ".join(f"round({c}, {cols_round[c]}) AS {c}" if c in cols_round else c
                                 for c in cols) + f" FROM {src}"


_STEP_ROUND = {"total_amount": 4, "average_amount": 6, "median_amount": 6, "gt_fraud_rate": 6,
               "hist_avg_txn_count_same_hour": 6, "hist_avg_amount_same_hour": 6,
               "txn_count_vs_hour_baseline_ratio": 6, "amount_vs_hour_baseline_ratio": 6,
               "gt_hist_avg_fraud_rate_same_hour": 6}


def rounded(df, spec):
    return df.select(*[r(c, spec[c]).alias(c) if c in spec else F.col(c) for c in df.columns])


def build_step_table(spark, sf_dir):
    return ST.step_table(features_table(spark, sf_dir))


STEP_COLUMNS = [
    "step", "transaction_count", "transfer_count", "cash_out_count", "total_amount", "average_amount",
    "median_amount", "high_amount_count", "gt_fraud_count", "gt_fraud_rate", "hour_of_day", "day_index",
    "hist_avg_txn_count_same_hour", "hist_avg_amount_same_hour", "txn_count_vs_hour_baseline_ratio",
    "amount_vs_hour_baseline_ratio", "gt_hist_avg_fraud_rate_same_hour"]
STEP_TABLE_SQL = with_features(STEP_CTES) + round_select(_STEP_ROUND, STEP_COLUMNS, "stp")


@register("step_table", STEP_TABLE_SQL)
def step_table(spark, sf_dir):
    """A21 + W4-W6: one row per step with same-hour baselines (flagship)."""
    return rounded(build_step_table(spark, sf_dir), _STEP_ROUND)
