"""Ledger profile (phase 1): data quality counts, class balance, fraud by type
and amount bucket, balance patterns, per-step and per-hour behaviour, naive
spikes and entity reuse (A1-A16, A25, A26, K1-K3, O1-O3, T1).

Every report is a tidy DataFrame built from aggregations; a global report is a
single-row ``agg`` (partial aggregation on every task, one tiny final merge).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from .combine import join_null_safe, side_by_side
from .quantiles import exact_quantiles


def _cnt(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _pct(num: Column, den: Column, n: int) -> Column:
    return F.round(F.when(den > 0, num / den * 100), n)


def null_counts(df: DataFrame) -> DataFrame:
    """A1 / Q-2: nulls (and NaN for floating columns) per column, plus a total row."""
    exprs = []
    for f in df.schema.fields:
        miss = F.col(f.name).isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(f.name)
        exprs.append(_cnt(miss).alias(f.name))
    row = df.agg(*exprs)
    stacked = row.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).cast("long").alias("null_count"))
        for f in df.schema.fields])).alias("s")).select("s.*")
    total = row.select(F.lit("_total").alias("column_name"),
                       sum((F.col(f.name) for f in df.schema.fields), F.lit(0)).cast("long").alias("null_count"))
    return stacked.unionByName(total)


def duplicate_counts(df: DataFrame, key_subset: list[str]) -> DataFrame:
    """A2: rows beyond the first of each full-row group and of each key group.
    Both groupings are unioned (tagged) and folded by one aggregate."""
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c")).select(F.lit(0).alias("g"), "c")
    sub = df.groupBy(*key_subset).agg(F.count(F.lit(1)).alias("c")).select(F.lit(1).alias("g"), "c")
    return full.unionByName(sub).agg(
        F.sum(F.when(F.col("g") == 0, F.col("c"))).cast("long").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("g") == 0, F.col("c") - 1)), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.coalesce(F.sum(F.when(F.col("g") == 1, F.col("c") - 1)), F.lit(0)).cast("long")
        .alias("duplicate_rows_on_key_subset"))


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """A3: counts per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def entity_summary(df: DataFrame) -> DataFrame:
    """A3: distinct origins/destinations/steps, step range."""
    return df.agg(
        F.countDistinct("nameOrig").alias("unique_nameOrig"),
        F.countDistinct("nameDest").alias("unique_nameDest"),
        F.countDistinct("step").alias("n_steps"),
        F.min("step").alias("step_min"), F.max("step").alias("step_max"))


def prefix_counts(df: DataFrame) -> DataFrame:
    """First character of each account id, per role."""
    o = df.select(F.lit("nameOrig").alias("role"), X.account_prefix("nameOrig").alias("prefix"))
    d = df.select(F.lit("nameDest").alias("role"), X.account_prefix("nameDest").alias("prefix"))
    return o.unionByName(d).groupBy("role", "prefix").agg(F.count(F.lit(1)).alias("n"))


def accounts_both_roles(df: DataFrame) -> DataFrame:
    """Ids seen as both origin and destination (intersect of distinct ids)."""
    o = df.select(F.col("nameOrig").alias("id"))
    d = df.select(F.col("nameDest").alias("id"))
    return o.intersect(d).agg(F.count(F.lit(1)).alias("accounts_both_orig_and_dest"))


def class_balance(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """A5."""
    n = F.count(F.lit(1))
    f = _cnt(F.col(label) == 1)
    l_ = _cnt(F.col(label) == 0)
    return df.agg(l_.alias("n_legit"), f.alias("n_fraud"),
                  F.round(f / n * 100, 6).alias("fraud_percentage"),
                  F.round(F.when(f > 0, l_ / f), 1).alias("imbalance_ratio_legit_to_fraud"))


def flag_audit(df: DataFrame) -> DataFrame:
    """Existing rule (isFlaggedFraud) against the label."""
    fl, fr = F.col("isFlaggedFraud") == 1, F.col("isFraud") == 1
    n_fraud = _cnt(fr)
    tp = _cnt(fl & fr)
    return df.agg(
        _cnt(fl).alias("total_flagged"), tp.alias("flagged_and_actually_fraud"),
        _cnt(fl & ~fr).alias("flagged_but_not_fraud"), _cnt(~fl & fr).alias("fraud_but_not_flagged"),
        F.round(F.when(n_fraud > 0, tp / n_fraud), 6).alias("recall_of_flag_on_fraud"),
        F.min(F.when(fl, F.col("amount"))).alias("flagged_amount_min"),
        F.max(F.when(fl, F.col("amount"))).alias("flagged_amount_max"))


def fraud_by(df: DataFrame, key: Column | str, name: str) -> DataFrame:
    """Total, fraud and fraud-rate percent per key (null keys dropped)."""
    k = F.col(key) if isinstance(key, str) else key
    return (df.select(k.alias(name), "isFraud").where(F.col(name).isNotNull())
              .groupBy(name).agg(F.count(F.lit(1)).alias("total_txn"),
                                 F.sum("isFraud").cast("long").alias("fraud_txn"))
              .withColumn("fraud_rate_pct", F.round(F.col("fraud_txn") / F.col("total_txn") * 100, 6)))


def fraud_types(df: DataFrame) -> DataFrame:
    """O1: distinct types that have any fraud."""
    return df.where(F.col("isFraud") == 1).select("type").distinct()


# Amount percentiles reported by the profile.
AMOUNT_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999]
AMOUNT_PROB_NAMES = ["p1", "p5", "p25", "p50", "p75", "p90", "p95", "p99", "p99_9"]


def amount_summary(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Min, max, mean, median, sample std and exact interpolated
    percentiles of amount, plus the zero-amount count (per key if given)."""
    keys = list(keys or [])
    grouped = keys or ["_g"]
    src = df if keys else df.withColumn("_g", F.lit(0))
    q = exact_quantiles(src, grouped, "amount", [0.5] + AMOUNT_PROBS, ["median"] + AMOUNT_PROB_NAMES)
    basic = src.groupBy(*grouped).agg(
        F.min("amount").alias("min"), F.max("amount").alias("max"),
        F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("std"),
        _cnt(F.col("amount") == 0).alias("zero_amount_count"))
    if not keys:
        return side_by_side(basic.drop("_g"), q.drop("_g"))
    return join_null_safe(basic, q, grouped, "left")     # a group without any amount has no quantiles


def balance_patterns(df: DataFrame) -> DataFrame:
    """Balance-formula match percents and zero/mismatch patterns."""
    eo = F.abs(F.col("oldbalanceOrg") - F.col("amount") - F.col("newbalanceOrig"))
    ed = F.abs(F.col("oldbalanceDest") + F.col("amount") - F.col("newbalanceDest"))
    oz = (F.col("oldbalanceOrg") == 0) & (F.col("newbalanceOrig") == 0) & (F.col("amount") > 0)
    dz = (F.col("oldbalanceDest") == 0) & (F.col("newbalanceDest") == 0) & (F.col("amount") > 0)
    n = F.count(F.lit(1))
    fr = F.col("isFraud")

    def rate(cond, empty_zero):
        v = F.round(F.avg(F.when(cond, fr)) * 100, 4)
        return F.coalesce(v, F.lit(0.0)) if empty_zero else v

    return df.agg(
        F.round(_cnt(eo < 0.01) / n * 100, 4).alias("orig_balance_exact_match_pct"),
        F.round(_cnt(ed < 0.01) / n * 100, 4).alias("dest_balance_exact_match_pct"),
        _cnt(oz).alias("orig_zero_pattern_count"), rate(oz, True).alias("orig_zero_pattern_fraud_rate_pct"),
        _cnt(dz).alias("dest_zero_pattern_count"), rate(dz, True).alias("dest_zero_pattern_fraud_rate_pct"),
        _cnt(eo > 0.01).alias("orig_mismatch_count"), rate(eo > 0.01, False).alias("orig_mismatch_fraud_rate_pct"),
        _cnt(ed > 0.01).alias("dest_mismatch_count"), rate(ed > 0.01, False).alias("dest_mismatch_fraud_rate_pct"),
        F.round(F.avg(fr) * 100, 4).alias("overall_fraud_rate_pct"))


def zero_balances(df: DataFrame) -> DataFrame:
    """Zero counts per balance column and the share of fraud that drains a
    funded origin to zero."""
    fr = F.col("isFraud") == 1
    drained = (F.col("newbalanceOrig") == 0) & (F.col("oldbalanceOrg") > 0)
    nf = _cnt(fr)
    return df.agg(*[_cnt(F.col(c) == 0).alias(f"{c}_zero") for c in
                    ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]],
                  F.round(F.when(nf > 0, _cnt(fr & drained) / nf * 100), 2)
                  .alias("fraud_drains_origin_to_zero_pct"))


def per_step(df: DataFrame) -> DataFrame:
    """Per-step count, fraud, total, mean, fraud-rate percent."""
    return (df.groupBy("step").agg(F.count(F.lit(1)).alias("txn_count"),
                                   F.sum("isFraud").cast("long").alias("fraud_count"),
                                   F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount"))
              .withColumn("fraud_rate_pct", F.col("fraud_count") / F.col("txn_count") * 100))


def per_step_distribution(steps: DataFrame) -> DataFrame:
    """Distribution of per-step values."""
    return steps.agg(
        F.min("txn_count").alias("txn_count_min"), F.max("txn_count").alias("txn_count_max"),
        F.round(F.avg("txn_count"), 2).alias("txn_count_mean"),
        F.round(F.stddev_samp("txn_count"), 2).alias("txn_count_std"),
        F.round(F.min("fraud_rate_pct"), 4).alias("fraud_rate_min"),
        F.round(F.max("fraud_rate_pct"), 4).alias("fraud_rate_max"),
        F.round(F.avg("fraud_rate_pct"), 4).alias("fraud_rate_mean"),
        F.round(F.stddev_samp("fraud_rate_pct"), 4).alias("fraud_rate_std"),
        _cnt(F.col("fraud_count") == 0).alias("steps_with_zero_fraud"))


def _ranked_top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Top-n by ``order``: per-partition top-n then a merge of n x partitions
    rows (TakeOrderedAndProject); the rank is numbered on those n rows only."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_steps(steps: DataFrame, n: int = 10) -> DataFrame:
    """K1: top-n steps by fraud rate, fraud count and volume; ties -> lowest step."""
    out = None
    for ranking, col in [("fraud_rate", "fraud_rate_pct"), ("fraud_count", "fraud_count"),
                         ("txn_volume", "txn_count")]:
        part = _ranked_top(steps, [F.desc(col), F.asc("step")], n).select(
            F.lit(ranking).alias("ranking"), "rank", "step", "txn_count", "fraud_count",
            F.round("fraud_rate_pct", 6).alias("fraud_rate_pct"))
        out = part if out is None else out.unionByName(part)
    return out


def hourly_profile(steps: DataFrame) -> DataFrame:
    """Per hour of day, summed over steps."""
    return (steps.groupBy(X.hour_of_day().alias("hour_of_day"))
                 .agg(F.sum("txn_count").cast("long").alias("total_txn"),
                      F.sum("fraud_count").cast("long").alias("total_fraud"))
                 .withColumn("fraud_rate_pct", F.round(F.col("total_fraud") / F.col("total_txn") * 100, 4)))


def naive_spikes(steps: DataFrame):
    """T1 + K3: steps above mean + 2*std (strict) for fraud rate and volume.
    Returns (summary, flagged steps ranked per kind). The thresholds
    are windows over the whole per-step table (one row per step, bounded)."""
    allw = Window.partitionBy()
    fr_t = F.avg("fraud_rate_pct").over(allw) + 2 * F.stddev_samp("fraud_rate_pct").over(allw)
    vol_t = F.avg("txn_count").over(allw) + 2 * F.stddev_samp("txn_count").over(allw)
    flagged = steps.select("step", "fraud_rate_pct", "txn_count", fr_t.alias("fr_t"), vol_t.alias("vol_t")).select(
        "step", "fr_t", "vol_t", (F.col("fraud_rate_pct") > F.col("fr_t")).alias("fr_spike"),
        (F.col("txn_count") > F.col("vol_t")).alias("vol_spike"))
    summary = flagged.agg(
        F.round(F.first("fr_t"), 4).alias("fraud_rate_threshold_mean_plus_2std"),
        _cnt(F.col("fr_spike")).alias("n_steps_flagged_as_fraud_spike"),
        F.round(F.first("vol_t"), 2).alias("volume_threshold_mean_plus_2std"),
        _cnt(F.col("vol_spike")).alias("n_steps_flagged_as_volume_spike"))
    kinds = flagged.select(
        F.explode(F.array(F.when(F.col("fr_spike"), F.lit("fraud_rate")),
                          F.when(F.col("vol_spike"), F.lit("volume")))).alias("kind"), "step"
    ).where(F.col("kind").isNotNull())
    w = Window.partitionBy("kind").orderBy("step")
    return summary, kinds.withColumn("rank", F.row_number().over(w))


def entity_reuse(df: DataFrame) -> DataFrame:
    """How often origin and destination ids repeat (one pass over the
    union of both roles, then one aggregate)."""
    ids = df.select(F.lit("o").alias("role"), F.col("nameOrig").alias("id")).unionByName(
        df.select(F.lit("d").alias("role"), F.col("nameDest").alias("id")))
    c = ids.groupBy("role", "id").agg(F.count(F.lit(1)).alias("c"))
    o, d = F.col("role") == "o", F.col("role") == "d"
    return c.agg(
        _cnt(o & (F.col("c") > 1)).alias("nameOrig_appears_more_than_once"),
        F.max(F.when(o, F.col("c"))).alias("nameOrig_max_txn_count"),
        F.round(_cnt(o & (F.col("c") == 1)) / _cnt(o) * 100, 2).alias("nameOrig_single_txn_pct"),
        _cnt(d & (F.col("c") > 1)).alias("nameDest_appears_more_than_once"),
        F.max(F.when(d, F.col("c"))).alias("nameDest_max_txn_count"),
        F.round(_cnt(d & (F.col("c") > 1)) / _cnt(d) * 100, 2).alias("nameDest_repeat_pct"))


def top_destinations(df: DataFrame, n: int = 10) -> DataFrame:
    """K2: busiest destinations, ties by id ascending."""
    c = df.groupBy("nameDest").agg(F.count(F.lit(1)).alias("txn_count"))
    return _ranked_top(c, [F.desc("txn_count"), F.asc("nameDest")], n)


def flag_rate_by_class(feats: DataFrame, flag_col: str = "drained_to_zero") -> DataFrame:
    """Percent of rows with the flag set, per class."""
    return feats.groupBy("isFraud").agg(F.round(F.avg(flag_col) * 100, 6).alias(f"{flag_col}_rate_pct"))


def flag_rate_by_type_class(feats: DataFrame, flag_col: str = "high_amount_indicator") -> DataFrame:
    """Percent with the flag by (type, class), pivoted on the class."""
    p = feats.groupBy("type").pivot("isFraud", [0, 1]).agg(F.avg(flag_col) * 100)
    return p.select("type", F.round(F.col("0"), 6).alias("legit_rate_pct"),
                    F.round(F.col("1"), 6).alias("fraud_rate_pct"))


def class_histogram(df: DataFrame, value: Column, bins: int, label: str = "isFraud") -> DataFrame:
    """Density histogram per class with ``bins`` equal bins over that
    class's own min..max (last bin closed); density = n / (N * width).
    Empty bins are kept."""
    v = df.select(F.col(label).alias("cls"), value.alias("v")).where(F.col("v").isNotNull())
    rng = v.groupBy("cls").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                               F.count(F.lit(1)).alias("n_class"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))
               ).otherwise(F.lit(0)).cast("int")
    counts = v.join(F.broadcast(rng), "cls").groupBy("cls", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select("cls", "lo", "hi", "n_class", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, ["cls", "bin"], "left").fillna(0, subset=["n"])
    return out.select(
        F.col("cls").alias(label), "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.col("n").cast("long").alias("n"),
        F.when(width > 0, F.col("n") / (F.col("n_class") * width)).alias("density"))
