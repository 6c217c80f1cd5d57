"""Hourly step table (A21) with same-hour baselines (W4-W8), and the generic
hour-of-day baseline used by the spike detectors.

The step table has one row per step present in the data, so windows without a
partition key (the global fallbacks) run on at most #steps rows. A step with no
transactions has no row: "previous" means the previous existing row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from .combine import join_null_safe
from .quantiles import exact_quantiles


def _same_hour_prior():
    return Window.partitionBy("hour_of_day").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)


def _all_prior():
    return Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)


def baseline_ratio(x: Column, base: Column) -> Column:
    """X / base, 1.0 when the base is 0 or null."""
    return F.coalesce(F.when(base != 0, x / base), F.lit(1.0))


def step_table(features: DataFrame) -> DataFrame:
    """A21 + W4 + W5 + W6. ``features`` needs step, amount, is_transfer,
    is_cash_out, high_amount_indicator and isFraud. A step without any amount
    keeps its row, with a null median."""
    aggs = [
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum("is_transfer").cast("long").alias("transfer_count"),
        F.sum("is_cash_out").cast("long").alias("cash_out_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("average_amount"),
        F.sum("high_amount_indicator").cast("long").alias("high_amount_count"),
        F.sum("isFraud").cast("long").alias("gt_fraud_count"),
    ]
    agg = join_null_safe(features.groupBy("step").agg(*aggs),
                         exact_quantiles(features, ["step"], "amount", [0.5], ["median_amount"]), ["step"], "left")
    agg = (agg.withColumn("gt_fraud_rate", F.col("gt_fraud_count") / F.col("transaction_count"))
              .withColumn("hour_of_day", X.hour_of_day())
              .withColumn("day_index", X.day_index()))
    sh, al = _same_hour_prior(), _all_prior()
    txn_base = F.coalesce(F.avg("transaction_count").over(sh), F.avg("transaction_count").over(al),
                          F.col("transaction_count").cast("double"))
    amt_base = F.coalesce(F.avg("average_amount").over(sh), F.avg("average_amount").over(al),
                          F.col("average_amount"))
    out = (agg.withColumn("hist_avg_txn_count_same_hour", txn_base)
              .withColumn("hist_avg_amount_same_hour", amt_base)
              .withColumn("gt_hist_avg_fraud_rate_same_hour", F.avg("gt_fraud_rate").over(sh)))
    out = (out.withColumn("txn_count_vs_hour_baseline_ratio",
                          baseline_ratio(F.col("transaction_count"), F.col("hist_avg_txn_count_same_hour")))
              .withColumn("amount_vs_hour_baseline_ratio",
                          baseline_ratio(F.col("average_amount"), F.col("hist_avg_amount_same_hour"))))
    return out.select(
        "step", "transaction_count", "transfer_count", "cash_out_count", "total_amount",
        "average_amount", "median_amount", "high_amount_count", "gt_fraud_count", "gt_fraud_rate",
        "hour_of_day", "day_index", "hist_avg_txn_count_same_hour", "hist_avg_amount_same_hour",
        "txn_count_vs_hour_baseline_ratio", "amount_vs_hour_baseline_ratio",
        "gt_hist_avg_fraud_rate_same_hour")


def add_hour_baseline(steps: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """Same-hour prior mean and sample std of ``col``; the mean falls back
    to the all-hours prior mean then the own value, the std to the all-hours
    prior std then 0 (independently). Ratio as W5; z = 0 when std is 0."""
    prefix = prefix or col
    sh, al = _same_hour_prior(), _all_prior()
    x = F.col(col).cast("double")
    mean = F.coalesce(F.avg(x).over(sh), F.avg(x).over(al), x)
    std = F.coalesce(F.stddev_samp(x).over(sh), F.stddev_samp(x).over(al), F.lit(0.0))
    m, s = f"hist_avg_{prefix}_same_hour", f"hist_std_{prefix}_same_hour"
    out = steps.withColumn(m, mean).withColumn(s, std)
    out = out.withColumn(f"{prefix}_vs_hour_baseline_ratio", baseline_ratio(x, F.col(m)))
    return out.withColumn(f"{prefix}_zscore_vs_hour_baseline",
                          F.coalesce(F.when(F.col(s) != 0, (x - F.col(m)) / F.col(s)), F.lit(0.0)))
