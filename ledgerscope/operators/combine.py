"""Put single-row results next to each other without a join.

Joining one-row aggregates on a constant key is folded by the optimizer into a
nested-loop (cartesian) join. Instead each one-row DataFrame becomes one struct
column of a tagged union, and one global aggregate (``first`` ignoring nulls)
folds the union back to a single row: a handful of rows through one small
exchange, whatever the size of the inputs the aggregates were computed from.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(*rows: DataFrame) -> DataFrame:
    """One row holding every column of the given one-row DataFrames (column
    names must not repeat across them)."""
    types = [F.struct(*d.columns) for d in rows]
    schemas = [d.select(t.alias("_s")).schema["_s"].dataType for d, t in zip(rows, types)]
    parts = []
    for i, d in enumerate(rows):
        cols = [(F.struct(*d.columns) if j == i else F.lit(None).cast(schemas[j])).alias(f"_s{j}")
                for j in range(len(rows))]
        parts.append(d.select(*cols))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    folded = u.agg(*[F.first(f"_s{j}", ignorenulls=True).alias(f"_s{j}") for j in range(len(rows))])
    return folded.select(*[f"_s{j}.*" for j in range(len(rows))])


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right`` where all keys are equal, null with null."""
    on = F.expr(" AND ".join(f"_l.`{k}` <=> _r.`{k}`" for k in keys))
    return (left.alias("_l").join(right.alias("_r"), on, how)
            .select(*[F.col(f"_l.`{c}`") for c in left.columns], *[F.col(f"_r.`{c}`") for c in right.columns if c not in keys]))
