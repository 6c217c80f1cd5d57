"""Exact grouped quantiles with linear interpolation (pandas/NumPy 'linear',
DuckDB ``quantile_cont``, Spark ``percentile``).

Spark's exact ``percentile`` keeps every distinct value of a group in one task.
Here one path serves every size: rows collapse to one count per (group, value),
exact running totals over range partitions give each value its ranks, and one
conditional aggregate per group picks the values at the target ranks. No group
sits in one task, however many rows it holds, and infinities are plain values.

Null and NaN values have no rank; a group without values has no row.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cumulative import running_totals


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    names: list[str] | None = None, with_count: bool = False) -> DataFrame:
    names = names or [f"q{i}" for i in range(len(probs))]
    for p in probs:
        _check_prob(p)
    by = list(keys) or ["_g"]       # no keys: one global group under a constant key
    base = df if keys else df.withColumn("_g", F.lit(0))
    counts = (base.select(*by, F.col(value).cast("double").alias("_v"))
              .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
              .groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")))
    ranked = running_totals(counts, by, "_v", ["_c"], totals=True).withColumnRenamed("all__c", "_n")
    picks = []
    for i, p in enumerate(probs):
        low = F.floor((F.col("_n") - 1) * F.lit(float(p)))
        for side, rank in (("a", low), ("b", F.least(low + 1, F.col("_n") - 1))):
            picks.append(F.min(F.when(F.col("cum__c") > rank, F.col("_v"))).alias(f"_{side}{i}"))
    out = ranked.groupBy(*by, "_n").agg(*picks)
    cols = [F.col(k) for k in keys]
    for i, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        # equal neighbours need no interpolation (and infinite ones allow none)
        cols.append(F.when((a == b) | (frac == 0), a).otherwise(a + frac * (b - a)).alias(name))
    return out.select(*cols, *([F.col("_n")] if with_count else []))


def _check_prob(p: float) -> None:
    if not (0.0 <= p <= 1.0) or math.isnan(p):
        raise ValueError(f"probability out of range: {p}")
