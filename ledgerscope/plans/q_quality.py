"""B4 queries: the data-quality suite."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import quality as Q
from ..session import ensure_checkpoint_dir
from ..sources.ledger import RAW_COLUMNS
from .catalog import features_table, ledger, r, register, steps_table
from .q_features import STEP_CTES, with_features
from .sql import with_ledger

NUMERIC = ["event_id", "step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest",
           "isFraud", "isFlaggedFraud"] + [c for c in FE.ENGINEERED_COLUMNS]
FLOATING = {"amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "log_amount",
            "balance_change_orig", "balance_error_orig", "amount_to_origin_balance_ratio", "balance_change_dest",
            "balance_error_dest", "hour_sin", "hour_cos", "hist_dest_total_amount", "hist_dest_avg_amount",
            "hist_dest_max_amount", "amount_to_dest_avg_ratio", "amount_to_type_avg_ratio"}


def features(spark, sf_dir):
    return features_table(spark, sf_dir)


@register("row_count_check", with_features() + """
SELECT (SELECT count(*) FROM ledger) AS raw_rows, (SELECT count(*) FROM feat) AS engineered_rows,
       (SELECT count(*) FROM ledger) = (SELECT count(*) FROM feat) AS match""")
def row_count_check(spark, sf_dir):
    """Q-1: engineered rows equal raw rows."""
    led = ledger(spark, sf_dir)
    return Q.row_counts(led, FE.transaction_features(led)[0])


def _null_inf_sql():
    parts = []
    for c in NUMERIC:
        nan = f" OR isnan({c})" if c in FLOATING else ""
        inf = f"count(CASE WHEN isinf({c}) THEN 1 END)" if c in FLOATING else "cast(NULL AS BIGINT)"
        parts.append(f"SELECT '{c}' AS column_name, count(CASE WHEN {c} IS NULL{nan} THEN 1 END) AS null_count, "
                     f"{inf} AS inf_count FROM feat")
    return with_features() + "\nUNION ALL ".join(parts)


@register("null_inf_counts", _null_inf_sql())
def null_inf_counts(spark, sf_dir):
    """Q-2: null / NaN / infinite counts per numeric engineered column."""
    return Q.null_inf_counts(features(spark, sf_dir).select(*NUMERIC))


@register("negative_counts", with_features() + "SELECT " + ", ".join(
    f"count(CASE WHEN {c} < 0 THEN 1 END) AS negative_{c}" for c in Q.MONEY_COLUMNS) + " FROM feat")
def negative_counts(spark, sf_dir):
    """Q-3: negative amount / balance counts."""
    return Q.negative_counts(features(spark, sf_dir))


@register("categorical_checks", with_features() + """
SELECT array_to_string(list_sort(list_distinct(list(type))), ',') AS type_categories,
  min(hour_of_day) AS hour_min, max(hour_of_day) AS hour_max, min(day_index) AS day_min, max(day_index) AS day_max,
  bool_and(type IN ('PAYMENT', 'TRANSFER', 'CASH_OUT', 'CASH_IN', 'DEBIT')) AS types_in_domain, """ + ", ".join(
    f"coalesce(bool_and({c} IN (0, 1)), true) AS {c}_is_binary" for c in Q.BINARY_FLAGS) + " FROM feat")
def categorical_checks(spark, sf_dir):
    """Q-4 / O3: domains, ranges and binary flags."""
    return Q.categorical_checks(features(spark, sf_dir))


@register("feature_ranges", with_features() + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean "
    f"FROM feat" for c in Q.RANGE_COLUMNS))
def feature_ranges(spark, sf_dir):
    """Q-5: min / max / mean of 15 features."""
    out = Q.feature_ranges(features(spark, sf_dir))
    return out.select("feature", r("min", 4).alias("min"), r("max", 4).alias("max"), r("mean", 4).alias("mean"))


@register("ratio_caps", with_features() + "SELECT " + ", ".join(
    f"max({c}) <= 1000 AS {c}_max_le_1000" for c in Q.RATIO_COLUMNS) + " FROM feat")
def ratio_caps(spark, sf_dir):
    """Q-6: ratio sentinel cap respected."""
    return Q.ratio_caps(features(spark, sf_dir))


def _auc_sql():
    long = "\nUNION ALL ".join(f"SELECT '{c}' AS feature, cast({c} AS DOUBLE) AS v, isFraud FROM feat"
                               for c in Q.LEAKAGE_COLUMNS)
    return with_features(f"lg AS ({long})", """
s AS (SELECT feature, v, sum(isFraud) AS pos, count(*) - sum(isFraud) AS neg FROM lg GROUP BY feature, v),
c AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY v DESC) AS fp,
             sum(pos) OVER (PARTITION BY feature) AS "P", sum(neg) OVER (PARTITION BY feature) AS "NN" FROM s)""") + """
SELECT feature, round(CASE WHEN max("P") > 0 AND max("NN") > 0 THEN
  sum(pos * ("NN" - fp + 0.5 * neg)) / (max("P") * max("NN")) END, 6) AS auc FROM c GROUP BY feature"""


@register("single_feature_auc", _auc_sql())
def single_feature_auc(spark, sf_dir):
    """Q-7: leakage audit, ROC-AUC of each column alone against the label."""
    return Q.single_feature_auc(features(spark, sf_dir))


@register("label_reconciliation", with_features(STEP_CTES) + """
SELECT (SELECT cast(sum(gt_fraud_count) AS BIGINT) FROM agg) AS step_table_fraud, (SELECT count(*) FROM agg) AS steps,
  (SELECT cast(sum(isFraud) AS BIGINT) FROM feat) AS transaction_fraud,
  (SELECT sum(gt_fraud_count) FROM agg) = (SELECT sum(isFraud) FROM feat) AS match""")
def label_reconciliation(spark, sf_dir):
    """Q-9: fraud total of the step table equals the transactions'."""
    feats = features_table(spark, sf_dir)
    return Q.label_reconciliation(steps_table(spark, sf_dir), feats)


def ledger_requests(spark, sf_dir):
    """The ledger presented as scoring requests: loosely typed (strings),
    type in lower case with padding, as a client might send it."""
    return as_requests(ledger(spark, sf_dir))


def as_requests(led, extra=()):
    return led.select(
        "event_id", F.col("step").cast("string").alias("step"),
        F.concat(F.lit(" "), F.lower("type"), F.lit(" ")).alias("type"),
        F.col("amount").cast("string").alias("amount"),
        *[F.col(c) for c in Q.BALANCE_FIELDS], "nameOrig", "nameDest", *extra)


def events_requests(spark, sf_dir):
    """Raw events presented as requests: no balances, the event type as the
    transaction type. Most rows are invalid, each with all its errors."""
    led = ledger(spark, sf_dir)
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "event_type")
    return led.select("event_id", "step", "amount").join(ev, "event_id").select(
        "event_id", "step", F.col("event_type").alias("type"), "amount")


def _validation_out(v):
    return v.select("event_id", "is_valid", F.size("errors").alias("n_errors"),
                    F.array_join("errors", " | ").alias("errors"), "clean_type",
                    r("clean_amount", 4).alias("clean_amount"))


@register("validate_ledger_requests", with_ledger() + """
SELECT event_id, true AS is_valid, 0 AS n_errors, '' AS errors, upper(trim(' ' || lower(type) || ' ')) AS clean_type,
  round(amount, 4) AS clean_amount FROM ledger""")
def validate_ledger_requests(spark, sf_dir):
    """Q-10 on the ledger sent as string-typed requests: all valid, normalised."""
    return _validation_out(Q.validate(ledger_requests(spark, sf_dir)))


@register("validate_events_as_requests", with_ledger("""
e AS (SELECT l.event_id, l.step, l.amount, ev.event_type AS type FROM ledger l JOIN events ev USING (event_id)),
v AS (SELECT event_id, amount, type, list_filter([
    'missing required field(s): oldbalanceOrg, newbalanceOrig, oldbalanceDest, newbalanceDest',
    CASE WHEN step < 1 THEN 'invalid step: ' || step || ' (must be >= 1)' END,
    CASE WHEN upper(trim(type)) NOT IN ('PAYMENT', 'TRANSFER', 'CASH_OUT', 'CASH_IN', 'DEBIT') THEN
      'unknown transaction type: ''' || type || ''' (must be one of [''CASH_IN'', ''CASH_OUT'', ''DEBIT'', ''PAYMENT'', ''TRANSFER''])' END,
    CASE WHEN amount < 0 THEN 'invalid amount: ' || amount || ' (must be >= 0)' END], lambda x: x IS NOT NULL) AS errs
  FROM e)""") + """
SELECT event_id, len(errs) = 0 AS is_valid, cast(len(errs) AS INT) AS n_errors, array_to_string(errs, ' | ') AS errors,
  CASE WHEN len(errs) = 0 THEN upper(trim(type)) END AS clean_type,
  CASE WHEN len(errs) = 0 THEN round(amount, 4) END AS clean_amount FROM v""")
def validate_events_as_requests(spark, sf_dir):
    """Q-10 on raw events sent as requests: every error of every row listed."""
    return _validation_out(Q.validate(events_requests(spark, sf_dir)))


#: One request in twelve each: as it is, or with one of these faults (two for 10).
_FAULTY = ["as is", "no step", "negative amount", "amount not a number", "unknown type", "step 0", "huge step", "broken step",
           "amount is text", "unknown mode", "no type, negative balance", "another mode"]


def faulty_requests(spark, sf_dir):
    """The ledger's requests, most of them made faulty by their id."""
    req = ledger_requests(spark, sf_dir)
    k = F.col("event_id") % len(_FAULTY)
    step = F.when(k == 5, "0").when(k == 6, "99999999999").when(k == 7, "2.5").when(k != 1, F.col("step"))
    amount = F.when(k == 2, F.concat(F.lit("-"), "amount")).when(k == 3, "nan").when(k == 8, "12 rupees").otherwise(F.col("amount"))
    kind = F.when(k == 4, "gift").when(k != 10, F.col("type"))
    return (req.withColumn("step", step).withColumn("amount", amount).withColumn("type", kind)
            .withColumn("newbalanceOrig", F.when(k == 10, F.lit(-1.0)).otherwise(F.col("newbalanceOrig")))
            .withColumn("mode", F.when(k == 9, "TURBO").when(k == 11, "HIGH_RECALL").otherwise("BALANCED")))


FAULTY_CTE = """
faulty AS (SELECT l.*, event_id % 12 AS k FROM ledger l),
faults AS (SELECT *, CASE k
    WHEN 1 THEN 'missing required field(s): step'
    WHEN 2 THEN 'invalid amount: ''-' || amount || ''' (must be >= 0)'
    WHEN 3 THEN 'invalid amount: ''nan'' (must be a finite number)'
    WHEN 4 THEN 'unknown transaction type: ''gift'' (must be one of [''CASH_IN'', ''CASH_OUT'', ''DEBIT'', ''PAYMENT'', ''TRANSFER''])'
    WHEN 5 THEN 'invalid step: 0 (must be >= 1)'
    WHEN 6 THEN 'invalid step: 99999999999 (must be <= 2147483647)'
    WHEN 7 THEN 'invalid step: ''2.5'' (must be an integer)'
    WHEN 8 THEN 'invalid amount: ''12 rupees'' (must be a finite number)'
    WHEN 10 THEN 'missing required field(s): type; invalid newbalanceOrig: -1.0 (must be >= 0)' END AS errs FROM faulty)"""


@register("request_quarantine", with_ledger(FAULTY_CTE) + """
SELECT event_id, errs IS NULL AS is_valid, coalesce(errs, '') AS errors, count(*) FILTER (errs IS NULL) OVER () AS n_valid,
  count(*) FILTER (errs IS NOT NULL) OVER () AS n_refused FROM faults""")
def request_quarantine(spark, sf_dir):
    """Q-10: valid and refused requests from one scan, with their counts."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/requests-{uuid.uuid4().hex}"
    valid, refused, n = Q.quarantine(faulty_requests(spark, sf_dir), path)
    return valid.unionByName(refused).select("event_id", "is_valid", F.array_join("errors", "; ").alias("errors"),
                                             F.lit(n["valid"]).alias("n_valid"), F.lit(n["refused"]).alias("n_refused"))
