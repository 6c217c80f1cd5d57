"""Row-level feature expressions (P1-P18), shared by batch and online scoring.

Every function returns a Column (built from one Spark SQL expression, which
is also the cheapest way to build it from Python); nothing here shuffles.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentinels used instead of inf/NaN.
RATIO_CAP = 1000.0        # ratio with a zero denominator, and the cap on every ratio
NEUTRAL_RATIO = 1.0       # "no history yet"

# The five transaction types and the two the model scores.
VALID_TYPES = ["PAYMENT", "TRANSFER", "CASH_OUT", "CASH_IN", "DEBIT"]
MODEL_TYPES = ["TRANSFER", "CASH_OUT"]


def q(name: str) -> str:
    """Backquoted column reference for SQL text."""
    return f"`{name}`"


def c(name) -> Column:
    return F.col(name) if isinstance(name, str) else name


def flag(cond: Column) -> Column:
    """Boolean -> 0/1 int (null stays null)."""
    return cond.cast("int")


def ratio_sql(num: str, den: str, fallback: float) -> str:
    """least(RATIO_CAP, den > 0 ? num/den : fallback); a NaN or null denominator
    takes the fallback (Spark orders NaN above every number, so guard it)."""
    return (f"least({RATIO_CAP}, CASE WHEN {den} IS NOT NULL AND NOT isnan({den}) AND {den} > 0 "
            f"THEN {num} / {den} ELSE {fallback} END)")


def capped_ratio(num: Column, den: Column, fallback: float) -> Column:
    ok = den.isNotNull() & ~F.isnan(den) & (den > 0)
    return F.least(F.lit(RATIO_CAP), F.when(ok, num / den).otherwise(F.lit(fallback)))


# The engineered row-level columns as SQL.
BASIC_SQL = [
    ("log_amount", "log1p(amount)"),
    ("balance_change_orig", "oldbalanceOrg - newbalanceOrig"),
    ("balance_error_orig", "oldbalanceOrg - amount - newbalanceOrig"),
    ("drained_to_zero", "cast(newbalanceOrig = 0 as int)"),
    ("origin_balance_zero_before", "cast(oldbalanceOrg = 0 as int)"),
    ("amount_to_origin_balance_ratio", ratio_sql("amount", "oldbalanceOrg", RATIO_CAP)),
    ("balance_change_dest", "newbalanceDest - oldbalanceDest"),
    ("balance_error_dest", "oldbalanceDest + amount - newbalanceDest"),
    ("dest_balance_artifact_flag", "cast(oldbalanceDest = 0 AND newbalanceDest = 0 AND amount > 0 as int)"),
    ("hour_of_day", "cast(pmod(step, 24) as int)"),
    ("day_index", "cast(floor(step / 24) as int)"),
    ("hour_sin", f"sin({2 * math.pi!r} * pmod(step, 24) / 24.0)"),
    ("hour_cos", f"cos({2 * math.pi!r} * pmod(step, 24) / 24.0)"),
    ("is_transfer", "cast(type = 'TRANSFER' as int)"),
    ("is_cash_out", "cast(type = 'CASH_OUT' as int)"),
    ("eligible_for_fraud_model", "cast(type IN ('TRANSFER', 'CASH_OUT') as int)"),
]
_BASIC = dict(BASIC_SQL)


def _e(name: str) -> Column:
    return F.expr(_BASIC[name])


def log_amount() -> Column:                                     # P1
    return _e("log_amount")


def balance_change_orig() -> Column:                            # P2
    return _e("balance_change_orig")


def balance_error_orig() -> Column:                             # P3
    return _e("balance_error_orig")


def drained_to_zero() -> Column:                                # P4
    return _e("drained_to_zero")


def origin_balance_zero_before() -> Column:                     # P5
    return _e("origin_balance_zero_before")


def amount_to_origin_balance_ratio() -> Column:                 # P6
    return _e("amount_to_origin_balance_ratio")


def balance_change_dest() -> Column:                            # P7
    return _e("balance_change_dest")


def balance_error_dest() -> Column:                             # P8
    return _e("balance_error_dest")


def dest_balance_artifact_flag() -> Column:                     # P9
    return _e("dest_balance_artifact_flag")


def hour_of_day(step: str = "step") -> Column:                  # P10
    return F.expr(f"cast(pmod({q(step)}, 24) as int)")


def day_index(step: str = "step") -> Column:                    # P10
    return F.expr(f"cast(floor({q(step)} / 24) as int)")


def day_number(step: str = "step") -> Column:
    """Phase-1 day: (step - 1) // 24 + 1."""
    return F.expr(f"cast(floor(({q(step)} - 1) / 24) + 1 as int)")


def hour_sin() -> Column:                                       # P11
    return _e("hour_sin")


def hour_cos() -> Column:                                       # P11
    return _e("hour_cos")


def is_transfer() -> Column:                                    # P12
    return _e("is_transfer")


def is_cash_out() -> Column:                                    # P12
    return _e("is_cash_out")


def eligible_for_fraud_model() -> Column:                       # P12
    return _e("eligible_for_fraud_model")


def destination_is_new(count: str = "hist_dest_txn_count") -> Column:          # P13
    return F.expr(f"cast({q(count)} = 0 as int)")


def amount_to_dest_avg_ratio(avg: str = "hist_dest_avg_amount") -> Column:     # P14
    return F.expr(ratio_sql("amount", q(avg), NEUTRAL_RATIO))


def amount_to_type_avg_ratio(avg: str = "hist_type_avg_amount") -> Column:     # P15
    return F.expr(ratio_sql("amount", q(avg), NEUTRAL_RATIO))


def high_amount_indicator(threshold: str = "p95_amount") -> Column:            # P16
    """Strictly above the frozen per-type p95; unknown type -> 0."""
    return F.expr(f"cast(coalesce(amount > {q(threshold)}, false) as int)")


def amount_bucket(amount: str = "amount") -> Column:                           # P17
    a = q(amount)
    # Right-open amount buckets and their labels.
    cuts = [(1000, "0-1K"), (10000, "1K-10K"), (50000, "10K-50K"), (100000, "50K-100K"),
            (200000, "100K-200K"), (500000, "200K-500K"), (1000000, "500K-1M")]
    whens = " ".join(f"WHEN {a} < {hi} THEN '{label}'" for hi, label in cuts)
    return F.expr(f"CASE WHEN {a} < 0 THEN NULL {whens} ELSE '1M+' END")


def account_prefix(col: str) -> Column:                                        # P18
    return F.expr(f"substring({q(col)}, 1, 1)")


def basic_feature_columns() -> list[Column]:
    """P1-P12 in output order."""
    return [F.expr(f"{sql} AS {name}") for name, sql in BASIC_SQL]


def with_basic_features(df):
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in BASIC_SQL])
