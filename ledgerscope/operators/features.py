"""Transaction features (L1): P1-P16 with leakage-safe history and frozen
per-type statistics (A19, A20, F3, J3)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import history
from .quantiles import exact_quantiles

# Share of the step range used to freeze the p95 thresholds.
FROZEN_FRACTION = 0.8

# Engineered columns in output order (25).
ENGINEERED_COLUMNS = [
    "log_amount", "balance_change_orig", "balance_error_orig", "drained_to_zero",
    "origin_balance_zero_before", "amount_to_origin_balance_ratio", "balance_change_dest",
    "balance_error_dest", "dest_balance_artifact_flag", "hour_of_day", "day_index", "hour_sin",
    "hour_cos", "is_transfer", "is_cash_out", "eligible_for_fraud_model", "hist_dest_txn_count",
    "hist_dest_unique_origin_count", "hist_dest_total_amount", "hist_dest_avg_amount",
    "hist_dest_max_amount", "destination_is_new", "amount_to_dest_avg_ratio",
    "amount_to_type_avg_ratio", "high_amount_indicator",
]


def frozen_cutoff(df: DataFrame, fraction: float = FROZEN_FRACTION, time: str = "step") -> int:
    """int(max_step * fraction), one scalar aggregate."""
    max_step = df.agg(F.max(time)).first()[0]
    return int(int(max_step) * fraction)


def frozen_p95(df: DataFrame, cutoff_step: int, key: str = "type", amount: str = "amount") -> DataFrame:
    """Exact, interpolated 95th percentile of amount per type, steps <= cutoff."""
    return exact_quantiles(df.where(F.col("step") <= cutoff_step), [key], amount, [0.95], ["p95_amount"])


def frozen_mean(df: DataFrame, cutoff_step: int, key: str = "type", amount: str = "amount") -> DataFrame:
    """Mean amount per type, steps <= cutoff."""
    return df.where(F.col("step") <= cutoff_step).groupBy(key).agg(F.avg(amount).alias("mean_amount"))


def frozen_type_stats(df: DataFrame, p95_cutoff: int, mean_cutoff: int) -> DataFrame:
    """S6 content: one row per type with p95 (steps <= p95_cutoff) and mean
    (steps <= mean_cutoff). At most 5 rows (the type domain). The two small
    per-type tables are unioned and folded by type (a full outer combination
    without a join)."""
    none = F.lit(None).cast("double")
    p = frozen_p95(df, p95_cutoff).select("type", "p95_amount", none.alias("mean_amount"))
    m = frozen_mean(df, mean_cutoff).select("type", none.alias("p95_amount"), "mean_amount")
    return p.unionByName(m).groupBy("type").agg(F.first("p95_amount", ignorenulls=True).alias("p95_amount"),
                                                F.first("mean_amount", ignorenulls=True).alias("mean_amount"))


def with_high_amount(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """J3 + P16: broadcast the per-type thresholds (bounded by the 5-type domain)."""
    t = F.broadcast(thresholds.select("type", "p95_amount"))
    return df.join(t, "type", "left").withColumn(
        "high_amount_indicator", X.high_amount_indicator()).drop("p95_amount")


def transaction_features(ledger: DataFrame, method: str = "preagg",
                         fraction: float = FROZEN_FRACTION, cutoff_step: int | None = None,
                         thresholds: DataFrame | None = None):
    """L1: returns (features, cutoff_step, thresholds). ``features`` keeps the
    input columns and adds the 25 engineered ones in the reference order."""
    base_cols = ledger.columns
    out = X.with_basic_features(ledger)
    out = history.with_destination_features(out, method=method)
    out = history.with_type_avg_ratio(out)
    if thresholds is None:
        cutoff_step = frozen_cutoff(ledger, fraction) if cutoff_step is None else cutoff_step
        thresholds = frozen_p95(ledger, cutoff_step)
    out = with_high_amount(out, thresholds)
    return out.select(*base_cols, *ENGINEERED_COLUMNS), cutoff_step, thresholds
