"""Point lookups in a table laid out for them.

The table is range-partitioned and sorted by its lookup column, so a value's
rows lie in few row groups, known by their minimum and maximum; other columns
that rows are looked up by get a bloom filter per row group. A lookup is an IN
filter that reaches the parquet scan: row groups that can't hold any of the
wanted values are not read.

Defined results: each row of the table comes at most once, however often its
value is wanted; a null value finds nothing and rows without a value are never
found; values that the table doesn't have, or no values at all, give no rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group: small, so a lookup reads little around what it wants.
ROW_GROUP_BYTES = 8 * 1024 * 1024
#: Different wanted values that a filter holds; more of them are a semi join.
MAX_VALUES = 10_000


def write_for_lookup(df: DataFrame, path: str, by: str, then: tuple = (), bloom: tuple = (), row_group_bytes: int = ROW_GROUP_BYTES,
                     distinct: int = 100_000) -> None:
    """Write ``df`` sorted by ``by``. ``then`` are further columns that split a
    value of very many rows over several ranges; ``bloom`` are other columns to
    look up, with about ``distinct`` different values in a row group."""
    order = [by, *then]
    w = (df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
         .option("parquet.block.size", row_group_bytes).option("parquet.bloom.filter.enabled", "false"))
    for c in bloom:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", distinct)
    w.parquet(path)


def lookup(spark: SparkSession, path: str, column: str, wanted: DataFrame, max_values: int = MAX_VALUES) -> DataFrame:
    """The rows of the table at ``path`` whose ``column`` is among the values of
    ``wanted`` (its column of that name). At most ``max_values`` different values
    come to the driver and become the scan's filter; beyond that the same rows
    come from a semi join, which reads the whole table."""
    table = spark.read.parquet(path)
    kind = table.schema[column].dataType
    values = wanted.select(F.col(column).cast(kind).alias(column)).where(F.col(column).isNotNull()).distinct()
    few = values.limit(max_values + 1).collect()
    if len(few) > max_values:
        return table.join(values, column, "left_semi").select(*table.columns)
    return table.where(F.col(column).isin([v[0] for v in few]) if few else F.lit(False))


def rows_read(df: DataFrame) -> int:
    """Rows of the row groups that a lookup without a shuffle read: runs it and
    takes the scan's own count, before the filter."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    leaves = execution.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
