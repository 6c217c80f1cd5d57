"""Strictly-prior history per key.

Totals are exact sums (``exact``), so neither the order of the rows nor the
number of partitions shows in them.

"Prior" means rows of the same key at an earlier time step; rows of the same
step never see each other. Two plans are offered:

* ``preagg`` (default): aggregate to one row per (key, step) first (partial
  aggregation collapses hot keys map-side), run the cumulative window on that
  small table (rows per key <= number of steps), then left-join back on
  (key, step). A key holding a third of all rows costs one window partition of
  at most #steps rows; the join back is spread over (key, step) and AQE splits
  a hot (key, step) partition or broadcasts the history side when it is small.
* ``range``: a range frame directly over the rows, partitioned by key. One
  shuffle, no join, but every row of a hot key goes to one task: only for
  inputs without skew.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import exact


def _prior(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


def per_key_step(df: DataFrame, key: str, time: str, amount: str, counterparty: str | None) -> DataFrame:
    """A17 (+W2): per (key, step) count, total, max and, if a counterparty is
    given, how many counterparties were first seen by the key at that step."""
    rows = df.select("*", *exact.parts(amount, "_sum"))
    per = rows.groupBy(key, time).agg(F.count(F.lit(1)).alias("_n"), *exact.sums("_sum"), F.max(amount).alias("_max"))
    if counterparty is None:
        return per
    # W2 without a row-level window: the first step of each (key, counterparty)
    # pair is a min() aggregate, so a hot pair collapses map-side too.
    firsts = (df.groupBy(key, counterparty).agg(F.min(time).alias(time))
              .groupBy(key, time).agg(F.count(F.lit(1)).alias("_new")))
    return per.join(firsts, [key, time], "left").fillna(0, subset=["_new"])


def prior_history_table(df: DataFrame, key: str = "nameDest", time: str = "step",
                        amount: str = "amount", counterparty: str | None = "nameOrig",
                        prefix: str = "hist_dest") -> DataFrame:
    """One row per (key, step) with the strictly-prior count, distinct
    counterparties, total, max and average (defaults 0)."""
    per = per_key_step(df, key, time, amount, counterparty)
    w = _prior(Window.partitionBy(key).orderBy(time))
    cnt = F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long")
    cols = [F.col(key), F.col(time), *exact.sums("_sum", w),
            cnt.alias(f"{prefix}_txn_count")]
    if counterparty is not None:
        cols.append(F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("long")
                    .alias(f"{prefix}_unique_origin_count"))
    cols += [F.coalesce(F.max("_max").over(w), F.lit(0.0)).alias(f"{prefix}_max_amount")]
    kept = [c for c in (f"{prefix}_txn_count", f"{prefix}_unique_origin_count") if counterparty is not None or not c.endswith("origin_count")]
    out = per.select(*cols).select(key, time, *kept, exact.total_of("_sum").alias(f"{prefix}_total_amount"), f"{prefix}_max_amount")
    return out.withColumn(
        f"{prefix}_avg_amount",
        F.when(F.col(f"{prefix}_txn_count") > 0,
               F.col(f"{prefix}_total_amount") / F.col(f"{prefix}_txn_count")).otherwise(F.lit(0.0)))


def prior_history(df: DataFrame, key: str = "nameDest", time: str = "step",
                  amount: str = "amount", counterparty: str | None = "nameOrig",
                  prefix: str = "hist_dest", method: str = "preagg") -> DataFrame:
    """W1 + J1: attach the strictly-prior history of ``key`` to every row."""
    if method == "range":
        return _prior_history_range(df, key, time, amount, counterparty, prefix)
    hist = prior_history_table(df, key, time, amount, counterparty, prefix)
    return df.join(hist, [key, time], "left")


def _prior_history_range(df, key, time, amount, counterparty, prefix):
    w = Window.partitionBy(key).orderBy(time).rangeBetween(Window.unboundedPreceding, -1)
    out = df
    if counterparty is not None:
        # first sighting of the pair; ties inside the first step all count once
        first_step = F.min(time).over(Window.partitionBy(key, counterparty))
        rn = F.row_number().over(Window.partitionBy(key, counterparty).orderBy(time, amount))
        out = out.withColumn("_new", ((F.col(time) == first_step) & (rn == 1)).cast("int"))
    cnt = F.coalesce(F.count(F.lit(1)).over(w), F.lit(0)).cast("long")
    out = out.withColumn(f"{prefix}_txn_count", cnt)
    if counterparty is not None:
        out = out.withColumn(f"{prefix}_unique_origin_count",
                             F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("long")).drop("_new")
    out = out.select("*", *exact.parts(amount, "_p")).select(*[c for c in out.columns], *exact.sums("_p", w),
                                                             F.coalesce(F.max(amount).over(w), F.lit(0.0)).alias(f"{prefix}_max_amount"))
    out = out.withColumn(f"{prefix}_total_amount", exact.total_of("_p")).drop(*exact.columns("_p"))
    return out.withColumn(
        f"{prefix}_avg_amount",
        F.when(F.col(f"{prefix}_txn_count") > 0,
               F.col(f"{prefix}_total_amount") / F.col(f"{prefix}_txn_count")).otherwise(F.lit(0.0)))


def with_destination_features(df: DataFrame, method: str = "preagg") -> DataFrame:
    """W1, W2, J1, then P13 and P14."""
    out = prior_history(df, method=method)
    return (out.withColumn("destination_is_new", X.destination_is_new())
               .withColumn("amount_to_dest_avg_ratio", X.amount_to_dest_avg_ratio()))


def type_expanding_mean(df: DataFrame, key: str = "type", time: str = "step",
                        amount: str = "amount") -> DataFrame:
    """A18 + W3: per (type, step) mean amount over strictly earlier steps of the
    same type (null when there is none). One row per (type, step)."""
    per = (df.select(key, time, *exact.parts(amount, "_sum"))
           .groupBy(key, time).agg(F.count(F.lit(1)).alias("_n"), *exact.sums("_sum")))
    w = _prior(Window.partitionBy(key).orderBy(time))
    per = per.select(key, time, F.sum("_n").over(w).cast("long").alias("hist_type_txn_count"), *exact.sums("_sum", w))
    n = F.col("hist_type_txn_count")
    return per.select(key, time, n, F.when(n > 0, exact.total_of("_sum") / n).alias("hist_type_avg_amount"))


#: Rows of (type, step, mean) up to which the table is broadcast, about 30 MB.
BROADCAST_ROWS = 1_000_000


def with_type_avg_ratio(df: DataFrame) -> DataFrame:
    """J2 + P15. The (type, step) table has one row per type and step: counted
    and broadcast, so the ledger is not shuffled on a few thousand keys. A table
    past the bound is left to Spark's own choice of join."""
    hist = type_expanding_mean(df).select("type", "step", "hist_type_avg_amount").checkpoint()
    if hist.count() <= BROADCAST_ROWS:
        hist = F.broadcast(hist)
    out = df.join(hist, ["type", "step"], "left")
    return out.withColumn("amount_to_type_avg_ratio", X.amount_to_type_avg_ratio()).drop("hist_type_avg_amount")
