"""B8 queries with oracles: frozen statistics, online features, phrases,
destination concentration, structured root cause and banded decisions on the
fixed linear score (the fitted-model decisions are in q_models)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phrases as PH
from ..operators import decide as D
from ..operators import features as FE
from ..operators import quality as Q
from ..operators import rootcause as RC
from ..operators.train import FEATURES
from .catalog import features_table, ledger, r, register, written_table
from .q_features import with_features
from .q_quality import FAULTY_CTE, faulty_requests, ledger_requests
from .q_spikes import EXT_CTES, TEST, extended_steps
from .sql import with_ledger

P95_CUTOFF_SQL = "(SELECT cast(floor(max(step) * 0.8) AS int) FROM ledger)"
MEAN_CUTOFF = 504
FROZEN_CTE = f"""fz AS (
  SELECT type, quantile_cont(CASE WHEN step <= {P95_CUTOFF_SQL} THEN amount END, 0.95) AS p95_amount,
         avg(CASE WHEN step <= {MEAN_CUTOFF} THEN amount END) AS mean_amount
  FROM ledger GROUP BY type)"""


def compute_frozen_stats(spark, sf_dir):
    led = ledger(spark, sf_dir)
    return FE.frozen_type_stats(led, FE.frozen_cutoff(led), MEAN_CUTOFF)


def frozen_stats(spark, sf_dir):
    """The frozen per-type table (at most 5 rows) as the decision jobs read
    it, written once per session; ``frozen_type_stats`` itself computes."""
    return written_table(spark, sf_dir, "frozen-type-stats", compute_frozen_stats, sort=None)


@register("frozen_type_stats", with_ledger(FROZEN_CTE) +
          "SELECT type, round(p95_amount, 6) AS p95_amount, round(mean_amount, 6) AS mean_amount FROM fz")
def frozen_type_stats(spark, sf_dir):
    """A19 + A20 + F3 (S6 content): frozen p95 (steps <= 80% of range) and mean
    (steps <= end of train) of amount per type."""
    return compute_frozen_stats(spark, sf_dir).select("type", r("p95_amount").alias("p95_amount"),
                                              r("mean_amount").alias("mean_amount"))


_OF_ROUND = {"amount": 4, "log_amount": 6, "balance_change_orig": 4, "balance_error_orig": 4,
             "amount_to_origin_balance_ratio": 6, "balance_change_dest": 4, "balance_error_dest": 4,
             "hour_sin": 6, "hour_cos": 6, "hist_dest_total_amount": 4, "hist_dest_avg_amount": 4,
             "hist_dest_max_amount": 4, "amount_to_dest_avg_ratio": 6, "amount_to_type_avg_ratio": 6}


def online_feature_rows(spark, sf_dir):
    v = Q.validate(ledger_requests(spark, sf_dir))
    return D.online_features(v, frozen_stats(spark, sf_dir))


_OF_SQL = with_ledger(FROZEN_CTE) + "SELECT event_id, " + ", ".join([
    "round(amount, 4) AS amount", "round(ln(1 + amount), 6) AS log_amount",
    "round(oldbalanceOrg - newbalanceOrig, 4) AS balance_change_orig",
    "round(oldbalanceOrg - amount - newbalanceOrig, 4) AS balance_error_orig",
    "cast(newbalanceOrig = 0 AS INT) AS drained_to_zero", "cast(oldbalanceOrg = 0 AS INT) AS origin_balance_zero_before",
    "round(least(1000.0, CASE WHEN oldbalanceOrg > 0 THEN amount / oldbalanceOrg ELSE 1000.0 END), 6) "
    "AS amount_to_origin_balance_ratio",
    "round(newbalanceDest - oldbalanceDest, 4) AS balance_change_dest",
    "round(oldbalanceDest + amount - newbalanceDest, 4) AS balance_error_dest",
    "cast(oldbalanceDest = 0 AND newbalanceDest = 0 AND amount > 0 AS INT) AS dest_balance_artifact_flag",
    "cast(step % 24 AS INT) AS hour_of_day", "round(sin(2 * pi() * (step % 24) / 24.0), 6) AS hour_sin",
    "round(cos(2 * pi() * (step % 24) / 24.0), 6) AS hour_cos", "cast(type = 'TRANSFER' AS INT) AS is_transfer",
    "cast(0 AS BIGINT) AS hist_dest_txn_count", "cast(0 AS BIGINT) AS hist_dest_unique_origin_count",
    "0.0 AS hist_dest_total_amount", "0.0 AS hist_dest_avg_amount", "0.0 AS hist_dest_max_amount",
    "1 AS destination_is_new", "1.0 AS amount_to_dest_avg_ratio",
    "round(least(1000.0, CASE WHEN mean_amount > 0 THEN amount / mean_amount ELSE 1.0 END), 6) "
    "AS amount_to_type_avg_ratio",
    "cast(coalesce(amount > p95_amount, false) AS INT) AS high_amount_indicator"]) + \
    " FROM ledger LEFT JOIN fz USING (type)"


@register("online_features_frozen", _OF_SQL)
def online_features_frozen(spark, sf_dir):
    """The 23 model features for requests, frozen per-type statistics,
    history from the request (absent -> 0)."""
    f = online_feature_rows(spark, sf_dir)
    return f.select("event_id", *[r(c, _OF_ROUND[c]).alias(c) if c in _OF_ROUND else F.col(c) for c in FEATURES])


# ------------------------------------------------------------------ phrases
def _phrase_sql(c):
    money = f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || 'Rs.' || format('{{:,.0f}}', abs({c})))"
    money_neg = f"(CASE WHEN -{c} < 0 THEN '-' ELSE '' END || 'Rs.' || format('{{:,.0f}}', abs(-{c})))"
    f1 = f"format('{{:.1f}}', cast({c} AS DOUBLE))"
    f2 = f"format('{{:.2f}}', cast({c} AS DOUBLE))"
    i = f"cast(cast(trunc({c}) AS BIGINT) AS VARCHAR)"
    t = {
        "amount": f"'the transaction amount is ' || {money}",
        "log_amount": f"'the log-scaled transaction amount is ' || {f2}",
        "balance_change_orig": f"CASE WHEN {c} >= 0 THEN 'the origin account balance decreased by ' || {money} "
                               f"ELSE 'the origin account balance increased by ' || {money_neg} END",
        "balance_error_orig": f"CASE WHEN abs({c}) < 1e-6 THEN 'the origin balance exactly matches the expected debit "
                              f"formula (oldbalance - amount = newbalance)' ELSE 'the origin balance deviates from the "
                              f"expected debit formula by ' || {money} END",
        "drained_to_zero": f"CASE WHEN {c} = 1 THEN 'the transaction drains the origin account to exactly zero' "
                           f"ELSE 'the origin account is not fully drained by this transaction' END",
        "origin_balance_zero_before": f"CASE WHEN {c} = 1 THEN 'the origin account already had a zero balance before "
                                      f"this transaction' ELSE 'the origin account had a non-zero balance before this "
                                      f"transaction' END",
        "amount_to_origin_balance_ratio": f"'the transaction amount is ' || {f1} || 'x the origin account''s "
                                          f"pre-transaction balance'",
        "balance_change_dest": f"CASE WHEN {c} >= 0 THEN 'the destination account balance increased by ' || {money} "
                               f"ELSE 'the destination account balance decreased by ' || {money_neg} END",
        "balance_error_dest": f"CASE WHEN abs({c}) < 1e-6 THEN 'the destination balance exactly matches the expected "
                              f"credit formula (oldbalance + amount = newbalance)' ELSE 'the destination balance "
                              f"deviates from the expected credit formula by ' || {money} END",
        "dest_balance_artifact_flag": f"CASE WHEN {c} = 1 THEN 'the destination''s balance fields are both zero (an "
                                      f"untracked/mule-like destination pattern)' ELSE 'the destination''s balance "
                                      f"fields look normally tracked' END",
        "hour_of_day": f"'it occurred at hour ' || {i} || ' of the simulated 24-hour cycle'",
        "hour_sin": "'part of this transaction''s cyclical time-of-day encoding'",
        "hour_cos": "'part of this transaction''s cyclical time-of-day encoding'",
        "is_transfer": f"CASE WHEN {c} = 1 THEN 'it is a TRANSFER transaction' ELSE 'it is a CASH_OUT transaction' END",
        "hist_dest_txn_count": f"'this destination has ' || {i} || ' prior recorded transactions'",
        "hist_dest_unique_origin_count": f"'this destination has received from ' || {i} || ' distinct senders "
                                         f"historically'",
        "hist_dest_total_amount": f"'this destination has received ' || {money} || ' historically'",
        "hist_dest_avg_amount": f"'this destination typically receives around ' || {money}",
        "hist_dest_max_amount": f"'the largest amount this destination has ever received is ' || {money}",
        "destination_is_new": f"CASE WHEN {c} = 1 THEN 'the destination account has no prior transaction history "
                              f"(brand new)' ELSE 'the destination account has prior transaction history' END",
        "amount_to_dest_avg_ratio": f"'the amount is ' || {f1} || 'x this destination''s historical average received "
                                    f"amount'",
        "amount_to_type_avg_ratio": f"'the amount is ' || {f1} || 'x the historical average amount for this "
                                    f"transaction type'",
        "high_amount_indicator": f"CASE WHEN {c} = 1 THEN 'the amount exceeds the historical 95th-percentile threshold "
                                 f"for this transaction type' ELSE 'the amount is within the normal range for this "
                                 f"transaction type' END",
    }
    return t[c]


@register("feature_phrases", with_features() + "SELECT event_id, " +
          " || ' | ' || ".join(f"({_phrase_sql(c)})" for c in FEATURES) + " AS phrases FROM feat")
def feature_phrases(spark, sf_dir):
    """The plain-words description of all 23 feature values of every
    transaction (joined by ' | ')."""
    feats = features_table(spark, sf_dir)
    return feats.select("event_id", F.array_join(F.array(*[PH.phrase_for(c)
                                                          for c in FEATURES]), " | ").alias("phrases"))


# ------------------------------------------------------ A27, R2, decisions
DC_CTES = """dd AS (SELECT step, nameDest, count(*) AS c, sum(amount) AS a FROM ledger GROUP BY step, nameDest),
dt AS (SELECT step, sum(c) AS tc, sum(a) AS ta FROM dd GROUP BY step),
dtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY c DESC, nameDest) AS rn FROM dd)
         WHERE rn = 1),
dc AS (
  SELECT step, nameDest AS top_destination, c AS top_destination_txn_count, cast(tc AS BIGINT) AS total_txns_in_step,
         round(c / tc, 4) AS txn_count_share, round(CASE WHEN ta > 0 THEN a / ta END, 4) AS amount_share
  FROM dtop JOIN dt USING (step))"""


@register("destination_concentration", with_ledger(DC_CTES) + "SELECT * FROM dc")
def destination_concentration(spark, sf_dir):
    """Per step, the busiest destination and its share of count and amount."""
    return RC.destination_concentration(ledger(spark, sf_dir))


def _rc_sql():
    facs = ", ".join(
        f"('{lab}', {i}, cast({cnt} AS DOUBLE), cast({base} AS DOUBLE), cast({cnt} AS VARCHAR))"
        for i, (cnt, base, lab) in enumerate(RC.TYPE_COUNT_FACTORS))
    return with_features(EXT_CTES, DC_CTES, f"""
pick AS (SELECT * FROM ext WHERE gt_fraud_spike = 1 AND step BETWEEN {TEST[0]} AND {TEST[1]}),
fa AS (
  SELECT p.step, f.label, f.o, f.actual, f.baseline, f.atext, f.actual / f.baseline AS ratio
  FROM pick p, LATERAL (VALUES {facs}) f(label, o, actual, baseline, atext)
  WHERE f.baseline IS NOT NULL AND f.baseline > 0 AND f.actual / f.baseline >= 1.5),
cands AS (
  SELECT step, label, round(ratio, 3) AS r3, o,
         label || ' was ' || format('{{:.1f}}', ratio) || 'x its hour-of-day baseline (' || atext || ' actual vs. '
         || format('{{:.1f}}', baseline) || ' expected).' AS ev FROM fa
  UNION ALL
  SELECT step, 'destination concentration', NULL, 99,
         'A single destination (' || top_destination || ') received ' || top_destination_txn_count || '/'
         || total_txns_in_step || ' (' || format('{{:.0f}}', txn_count_share * 100) || '%) of this step''s transactions.'
  FROM dc JOIN pick USING (step) WHERE txn_count_share >= 0.3),
rca AS (
  SELECT step, string_agg(label, ',' ORDER BY r3 IS NULL, r3 DESC, o) AS factors,
         first(label ORDER BY r3 IS NULL, r3 DESC, o) AS primary_driver,
         string_agg(ev, ' | ' ORDER BY o) AS evs FROM cands GROUP BY step)""") + f"""
SELECT p.step, p.hour_of_day, coalesce(a.primary_driver, 'no single driver identified') AS primary_driver,
  coalesce(a.factors, '') AS contributor_factors,
  concat_ws(' | ', a.evs, 'Step occurred at hour_of_day=' || p.hour_of_day || ' of the simulated 24-hour cycle.',
            CASE WHEN a.step IS NULL THEN '{RC.NO_DRIVER_TEXT}' END) AS evidence
FROM pick p LEFT JOIN rca a USING (step)"""


@register("root_cause_structured", _rc_sql())
def root_cause_structured(spark, sf_dir):
    """R2 + R3 + A27: structured root cause of every ground-truth spike in the
    test window, with destination concentration from its transactions."""
    e = extended_steps(spark, sf_dir)
    pick = e.where((F.col("gt_fraud_spike") == 1) & F.col("step").between(*TEST))
    out = RC.analyze(pick, ledger(spark, sf_dir))
    return out.select("step", "hour_of_day", "primary_driver",
                      F.array_join(F.transform("contributors", lambda c: c["factor"]), ",").alias("contributor_factors"),
                      F.array_join("evidence", " | ").alias("evidence"))


def linear_decisions(spark, sf_dir):
    modes = D.modes_table(spark)
    spikes = extended_steps(spark, sf_dir)

    def score_fn(df):
        return df.withColumn("pred_prob", F.least(F.lit(1.0), F.col("amount") / 500.0))

    return D.decide(ledger_requests(spark, sf_dir), frozen_stats(spark, sf_dir), modes, score_fn, spikes)


@register("risk_decisions_linear", with_features(EXT_CTES) + f"""
SELECT l.event_id, 'ok' AS status, round(least(1.0, l.amount / 500.0), 6) AS risk_score,
  CASE WHEN least(1.0, l.amount / 500.0) >= 0.43 THEN 'HIGH' WHEN least(1.0, l.amount / 500.0) >= 0.17 THEN 'MEDIUM'
       ELSE 'LOW' END AS risk_band,
  CASE WHEN least(1.0, l.amount / 500.0) >= 0.17 THEN 'REVIEW'
       WHEN coalesce(e.stat_method_pred = 1, false) THEN 'REVIEW' ELSE 'ALLOW' END AS recommended_action,
  'BALANCED' AS mode, cast(0.43 AS DOUBLE) AS threshold_used, least(1.0, l.amount / 500.0) >= 0.43 AS alert,
  cast(CASE WHEN least(1.0, l.amount / 500.0) < 0.17 AND coalesce(e.stat_method_pred = 1, false) THEN 1 ELSE 0 END
       AS INT) AS n_reasons,
  coalesce(e.stat_method_pred = 1, false) AS is_spike
FROM ledger l LEFT JOIN ext e USING (step)""")
def risk_decisions_linear(spark, sf_dir):
    """E3-E6 + T6/J4 + E5 override on the fixed linear score: status, band,
    action (LOW in a z-score spike step -> REVIEW with the spike reason)."""
    d = linear_decisions(spark, sf_dir)
    return d.select("event_id", "status", "risk_score", "risk_band", "recommended_action", "mode", "threshold_used",
                    "alert", F.size("top_reasons").alias("n_reasons"),
                    F.col("spike_context.is_spike").alias("is_spike"))


@register("risk_decisions_faulty", with_features(EXT_CTES, FAULTY_CTE, """
fd AS (SELECT faults.*, least(1.0, amount / 500.0) AS sc, coalesce(e.stat_method_pred = 1, false) AS spike,
         CASE WHEN errs IS NOT NULL THEN 'invalid_input' WHEN k = 9 THEN 'degraded' ELSE 'ok' END AS status
       FROM faults LEFT JOIN ext e USING (step))""") + f"""
SELECT event_id, status, CASE WHEN status = 'ok' THEN round(sc, 6) END AS risk_score,
  CASE WHEN status = 'ok' THEN CASE WHEN sc >= 0.43 THEN 'HIGH' WHEN sc >= 0.17 THEN 'MEDIUM' ELSE 'LOW' END END AS risk_band,
  CASE WHEN status = 'ok' THEN CASE WHEN sc >= 0.17 OR spike THEN 'REVIEW' ELSE 'ALLOW' END
       WHEN status = 'degraded' THEN 'MANUAL_REVIEW' END AS recommended_action,
  CASE WHEN k = 9 THEN 'TURBO' WHEN k = 11 THEN 'HIGH_RECALL' ELSE 'BALANCED' END AS mode,
  CASE WHEN status = 'ok' THEN sc >= CASE WHEN k = 11 THEN {dict(D.DEFAULT_MODES)["HIGH_RECALL"]} ELSE 0.43 END END AS alert,
  CASE WHEN errs IS NOT NULL THEN 'Transaction failed validation: ' || errs
       WHEN k = 9 THEN 'Unknown operating mode ''TURBO''. Valid modes: [''BALANCED'', ''HIGH_PRECISION'', ''HIGH_RECALL'']' END AS message,
  CASE WHEN status != 'ok' THEN 'MANUAL_REVIEW' END AS fallback
FROM fd""")
def risk_decisions_faulty(spark, sf_dir):
    """Decisions on requests with missing, negative, non-finite,
    unknown and oversized values and modes: status, action, message, fallback."""
    def score_fn(df):
        return df.withColumn("pred_prob", F.least(F.lit(1.0), F.col("amount") / 500.0))

    d = D.decide(faulty_requests(spark, sf_dir), frozen_stats(spark, sf_dir), D.modes_table(spark), score_fn, extended_steps(spark, sf_dir))
    return d.select("event_id", "status", "risk_score", "risk_band", "recommended_action", "mode", "alert", "message", "fallback")
