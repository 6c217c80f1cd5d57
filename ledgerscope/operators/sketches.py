"""A3, A8, A19, A21 as an option for very large ledgers: mergeable sketches.

A sketch per step is built in one pass with partial aggregation and can be
kept as a table; days, any range of steps and the whole ledger are unions of
those, without the transactions being read again. Distinct counts are HLL
sketches (relative standard error about 1 / sqrt(2 ^ lg_k)), quantiles KLL
sketches (rank error about 1.3 % at k = 200). The exact operators stay the
default (``profile.entity_summary``, ``quantiles.exact_quantiles``).

Defined results: null values are in no sketch and NaN is in no quantile sketch;
a null key is a group of its own; a group without values counts 0 and has null
quantiles; an empty table gives no group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
KLL_K = 200


def distinct_error(lg_k: int = LG_K, sigmas: float = 4.0) -> float:
    """Relative error that an estimate stays within, at so many standard errors."""
    return sigmas * 1.04 / 2 ** (lg_k / 2)


def step_sketches(df: DataFrame, distinct: list[str], quantile: str | None = None, keys: tuple = ("step",), lg_k: int = LG_K, k: int = KLL_K) -> DataFrame:
    """One row per key: distinct_<column> for each named column and, with
    ``quantile``, quantile_<column> of its values as doubles."""
    aggs = [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(lg_k)).alias(f"distinct_{c}") for c in distinct]
    if quantile is not None:
        v = F.col(quantile).cast("double")
        aggs.append(F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(k)).alias(f"quantile_{quantile}"))
    return df.groupBy(*keys).agg(*aggs)


def union(sketches: DataFrame, keys: list) -> DataFrame:
    """The sketches of wider groups: one row per key, or one row without keys."""
    made = [c for c in sketches.columns if c.startswith(("distinct_", "quantile_"))]
    return sketches.groupBy(*keys).agg(*[
        (F.hll_union_agg(c) if c.startswith("distinct_") else F.kll_merge_agg_double(c)).alias(c) for c in made])


def distinct(col: str) -> Column:
    """Estimated distinct values of a sketch column, 0 for none."""
    return F.coalesce(F.hll_sketch_estimate(f"distinct_{col}"), F.lit(0).cast("long"))


def quantile(col: str, rank: float) -> Column:
    """The value at a rank between 0 and 1, null where the sketch holds no value."""
    c = F.col(f"quantile_{col}")
    return F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(rank)))
