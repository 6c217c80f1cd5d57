"""Spike detection over the hourly step table (A22, J5, W7, W8, T2, T3, T5,
R1, R4). The step table has one row per step, so everything here is small;
the per-step model signal (A22) is an aggregate over all scored rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .steps import add_hour_baseline

# The ground-truth spike rule, the z-score rule and the
# root-cause driver threshold.
MIN_ABS_FRAUD_COUNT = 3
SPIKE_MULTIPLIER = 2.0
Z_SCORE_THRESHOLD = 2.0
DRIVER_RATIO_THRESHOLD = 1.5

# The detector's input features (ratios to the hour baseline).
PREDICTIVE_SPIKE_FEATURES = [
    "txn_count_vs_hour_baseline_ratio", "amount_vs_hour_baseline_ratio",
    "transfer_count_vs_hour_baseline_ratio", "cash_out_count_vs_hour_baseline_ratio",
    "high_amount_count_vs_hour_baseline_ratio", "predicted_high_risk_count_vs_hour_baseline_ratio",
]


def step_model_signal(scored: DataFrame, threshold: float, score: str = "pred_prob") -> DataFrame:
    """Per step, rows at or above the threshold and the score sum."""
    return scored.groupBy("step").agg(
        F.count(F.when(F.col(score) >= threshold, 1)).alias("predicted_high_risk_count"),
        F.sum(score).alias("predicted_risk_score_sum"))


def extend_step_table(steps: DataFrame, signal: DataFrame) -> DataFrame:
    """W7 for three counts, W8 + T2 (ground-truth spike), J5 (model signal,
    missing -> 0), then W7 for the model signal."""
    out = steps
    for c in ["transfer_count", "cash_out_count", "high_amount_count"]:
        out = add_hour_baseline(out, c)
    exp = F.coalesce(F.col("gt_hist_avg_fraud_rate_same_hour") * F.col("transaction_count"), F.lit(0.0))
    out = out.withColumn("gt_expected_fraud_count_same_hour", exp)
    # ground-truth spike = at least 3 fraud rows and at least 2x the expected count
    out = out.withColumn("gt_fraud_spike", ((F.col("gt_fraud_count") >= MIN_ABS_FRAUD_COUNT) &
                                            (F.col("gt_fraud_count") >= SPIKE_MULTIPLIER * exp)).cast("int"))
    out = (out.join(signal, "step", "left")
              .withColumn("predicted_high_risk_count", F.coalesce("predicted_high_risk_count", F.lit(0)).cast("long"))
              .withColumn("predicted_risk_score_sum", F.coalesce("predicted_risk_score_sum", F.lit(0.0))))
    return add_hour_baseline(out, "predicted_high_risk_count")


def zscore_flag(steps: DataFrame, threshold: float = Z_SCORE_THRESHOLD) -> DataFrame:
    """T3 + F8: flag when the model-signal z-score is at least the threshold (inclusive)."""
    return steps.withColumn("stat_method_pred",
                            (F.col("predicted_high_risk_count_zscore_vs_hour_baseline") >= threshold).cast("int"))


def evaluate_detector(steps: DataFrame, name: str, pred: str, scope: tuple[int, int] | None = None) -> DataFrame:
    """T5: confusion of a step flag against the ground-truth spike, with
    precision, recall (4 places), false-alert and alert rate (6 places);
    zero denominators give 0. Delay is 0 by design (same-step monitoring)."""
    d = steps if scope is None else steps.where(F.col("step").between(*scope))
    y, p = F.col("gt_fraud_spike") == 1, F.col(pred) == 1
    tp, fp = F.count(F.when(y & p, 1)), F.count(F.when(~y & p, 1))
    fn, tn = F.count(F.when(y & ~p, 1)), F.count(F.when(~y & ~p, 1))
    n = F.count(F.lit(1))

    def div(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    return d.agg(
        F.lit(name).alias("method"), F.lit("all_steps" if scope is None else "test_only").alias("scope"),
        n.alias("n_steps"), F.count(F.when(y, 1)).alias("n_ground_truth_spikes"),
        F.count(F.when(p, 1)).alias("n_predicted_spikes"), tp.alias("tp"), fp.alias("fp"),
        fn.alias("fn"), tn.alias("tn"),
        F.round(div(tp, tp + fp), 4).alias("precision"), F.round(div(tp, tp + fn), 4).alias("recall"),
        F.round(div(fp, fp + tn), 6).alias("false_alert_rate"), F.round(div(tp + fp, n), 6).alias("alert_rate"),
        F.lit(0).alias("detection_delay_steps"))


def _one_decimal(x):
    return F.format_number(x, 1)


def root_cause_batch(steps: DataFrame, flagged: DataFrame) -> DataFrame:
    """R1 + R4: for every flagged step (``rank`` by step), compare three
    counts with their same-hour baselines; ratio >= 1.5 is a driver, the
    strongest (ties: factor order) is named in a sentence. Baselines that are
    null or <= 0 are skipped."""
    ranked = flagged.select("step").distinct().withColumn("rank", F.row_number().over(Window.orderBy("step")))
    rows = steps.join(ranked, "step")
    factors = [("transfer_count", "hist_avg_transfer_count_same_hour", "TRANSFER", 0),
               ("cash_out_count", "hist_avg_cash_out_count_same_hour", "CASH_OUT", 1),
               ("high_amount_count", "hist_avg_high_amount_count_same_hour", "high-amount", 2)]
    cands = []
    for count, base, label, order in factors:
        b = F.col(base)
        ratio = F.col(count) / b
        ok = b.isNotNull() & (b > 0) & (ratio >= DRIVER_RATIO_THRESHOLD)
        cands.append(F.when(ok, F.struct(F.lit(label).alias("label"), ratio.alias("ratio"),
                                         F.col(count).cast("double").alias("actual"), b.alias("baseline"),
                                         F.lit(order).alias("o"))))
    drivers = F.filter(F.array(*cands), lambda x: x.isNotNull())
    drivers = F.array_sort(drivers, lambda a, b: F.when(a["ratio"] > b["ratio"], -1)
                           .when(a["ratio"] < b["ratio"], 1)
                           .otherwise(a["o"] - b["o"]))
    top = F.try_element_at(drivers, F.lit(1))
    sentence = F.concat(
        F.lit("Step "), F.col("step").cast("string"), F.lit(" (hour_of_day="), F.col("hour_of_day").cast("string"),
        F.lit(", day_index="), F.col("day_index").cast("string"),
        F.lit("): risk activity increased primarily because "), top["label"],
        F.lit(" transactions were "), _one_decimal(top["ratio"]),
        F.lit("x above the historical hour-of-day baseline ("), F.format_number(top["actual"], 0),
        F.lit(" actual vs. "), _one_decimal(top["baseline"]), F.lit(" expected)."))
    sentence = F.regexp_replace(sentence, ",(?=\\d{3})", "")   # plain numbers, no thousands separators
    return rows.select(
        "step", "rank", "hour_of_day", "day_index", "transaction_count",
        F.round("txn_count_vs_hour_baseline_ratio", 3).alias("txn_count_vs_baseline"),
        "transfer_count", F.round("transfer_count_vs_hour_baseline_ratio", 3).alias("transfer_count_vs_baseline"),
        "cash_out_count", F.round("cash_out_count_vs_hour_baseline_ratio", 3).alias("cash_out_count_vs_baseline"),
        "high_amount_count",
        F.round("high_amount_count_vs_hour_baseline_ratio", 3).alias("high_amount_count_vs_baseline"),
        "predicted_high_risk_count",
        F.round("predicted_high_risk_count_vs_hour_baseline_ratio", 3).alias("predicted_high_risk_vs_baseline"),
        "gt_fraud_count", F.round(F.col("gt_fraud_rate") * 100, 4).alias("gt_fraud_rate_pct"),
        F.when(F.size(drivers) > 0, sentence).otherwise(
            F.lit("No single transaction-type driver exceeded 1.5x its hour-of-day baseline.")).alias("explanation"))
