"""Artifacts (S4-S8; S9 is in lookup.py): engineered tables, frozen statistics, models, metadata
and scored predictions, written to a shared folder and read back.

Paths must be on storage every executor sees (the cluster's shared folder).
"""
from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

#: Rows of one file of a derived table. A row group is never split between tasks
#: and such rows pack into a few MB, so a larger file keeps later tasks few and uneven.
ROWS_PER_FILE = 250_000


def bounded_files(writer: DataFrameWriter) -> DataFrameWriter:
    """The writer with files of at most ``ROWS_PER_FILE`` rows, without a shuffle."""
    return writer.option("maxRecordsPerFile", ROWS_PER_FILE)


def write_partitioned(df: DataFrame, path: str, column: str) -> None:
    """Partitioned parquet write. Rows are first rebalanced on the partition
    column (AQE splits a large value into advisory-size tasks and merges small
    ones), so each task writes into few directories: files ~ values x splits,
    not tasks x values."""
    df.hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)


def write_features(df: DataFrame, path: str) -> None:
    """Engineered transactions, partitioned by day so time-range reads prune."""
    write_partitioned(df, path, "day_index")


def write_table(df: DataFrame, path: str) -> None:
    """Small tables (step table, frozen statistics)."""
    df.write.mode("overwrite").parquet(path)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    """S6 read side: at most 5 rows; callers broadcast it. (S3: every reader
    selects its columns; Catalyst prunes the parquet scan.)"""
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One tidy report section as JSON lines (report sections are small;
    ``repartition(1)`` keeps the work before it parallel, unlike coalesce)."""
    df.repartition(1).write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Fitted pipeline in Spark ML's own format."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """Model metadata as a one-row JSON table."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode(
        "overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_predictions(scored: DataFrame, path: str) -> None:
    """Scored rows keyed by split."""
    write_partitioned(scored, path, "split")
