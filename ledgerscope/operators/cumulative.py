"""Exact running totals over a global order, without one task per key.

A window ``partitionBy(key).orderBy(x)`` sends every row of a key to one task.
Here the rows are range-partitioned on (keys, order), each range partition
computes its own running sums, and the totals of earlier partitions of the same
key are added as offsets. The offset table has at most #partitions + #keys
rows. Without keys it is broadcast, as the partition count bounds it; with keys
Spark judges its size, and the join and the running sums share one exchange.
The range-partitioned input is checkpointed so both uses see the same partition
ids; totals per key come from it as well, not from a second pass over the input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .combine import join_null_safe


def running_totals(df: DataFrame, keys: list[str], order: str, sums: list[str],
                   descending: bool = False, num_partitions: int | None = None,
                   totals: bool = False) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows of the same keys whose ``order``
    is at or before the current row (ascending, or descending if asked).
    ``totals`` also adds ``all_<c>``, the sum over all rows of the keys. A null
    key is a key of its own. ``df`` must have one row per (keys, order)."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = F.col(order).desc() if descending else F.col(order).asc()
    ranged = (df.repartitionByRange(n, *[F.col(k) for k in keys], o)
                .withColumn("_pid", F.spark_partition_id())
                .checkpoint())
    tot = ranged.groupBy("_pid", *keys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    wk = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("_pid", *keys, *[F.coalesce(F.sum(f"_t_{c}").over(wk), F.lit(0)).alias(f"_o_{c}")
                                       for c in sums],
                      *[F.sum(f"_t_{c}").over(Window.partitionBy(*keys)).alias(f"all_{c}") for c in sums if totals])
    wi = Window.partitionBy("_pid", *keys).orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    if keys:
        out = join_null_safe(ranged, offs, ["_pid", *keys], "inner" if totals else "left")
    else:
        out = ranged.join(F.broadcast(offs), "_pid", "inner" if totals else "left")
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.sum(c).over(wi) + F.col(f"_o_{c}"))
    return out.drop("_pid", *[f"_o_{c}" for c in sums])
