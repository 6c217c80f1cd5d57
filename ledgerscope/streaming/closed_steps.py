"""ST2 with closed windows and a late side table.

``stream_step_counts`` updates open windows and ignores late rows. Here an hour
comes out once, when it is closed, and a row that comes after its hour was
closed is kept apart, so the closed hours and the late rows together are all
rows. An hour also has its median amount, from a quantile sketch in the state.

An hour is closed when the latest event time of the micro-batches so far is
``delay`` or more past its end. A row is late if its hour was closed before its
micro-batch, or if it has no time. The state is the open hours' partial sums
(exact, order-free) and sketches, one version per batch id under the checkpoint
folder; a retried micro-batch rewrites its own versions. A micro-batch's work
follows its own rows and the open hours.

Defined results: a null amount is counted and in no sum or median; an hour
without amounts has a null total, average and median; an empty source gives no
hours and no late rows; repeated rows count as often as they come.
"""
from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exact
from ..operators.sketches import KLL_K
from .jobs import _exists, _run

_COUNTS = ["transaction_count", "transfer_count", "cash_out_count", "gt_fraud_count", "amounts"]


def _partials(rows: DataFrame) -> DataFrame:
    """One row of mergeable sums per hour of the batch."""
    amount = F.col("amount").cast("double")
    d = rows.select(F.date_trunc("hour", "ts").alias("hour"), "type", "isFraud", amount.alias("amount"), *exact.parts("amount", "total"))
    return d.groupBy("hour").agg(
        F.count(F.lit(1)).alias("transaction_count"), F.count_if(F.col("type") == "TRANSFER").alias("transfer_count"),
        F.count_if(F.col("type") == "CASH_OUT").alias("cash_out_count"),
        F.coalesce(F.sum(F.col("isFraud").cast("long")), F.lit(0)).alias("gt_fraud_count"), F.count("amount").alias("amounts"),
        *exact.sums("total"), F.kll_sketch_agg_double(F.when(~F.isnan("amount"), F.col("amount")), F.lit(KLL_K)).alias("sketch"))


def _merged(partials: DataFrame) -> DataFrame:
    return partials.groupBy("hour").agg(*[F.sum(c).alias(c) for c in _COUNTS], *exact.sums("total"),
                                        F.kll_merge_agg_double("sketch").alias("sketch"))


def _finished(hours: DataFrame) -> DataFrame:
    some = F.col("amounts") > 0
    total = exact.total_of("total")
    return hours.select("hour", "transaction_count", "transfer_count", "cash_out_count", F.when(some, total).alias("total_amount"),
                        F.when(some, total / F.col("amounts")).alias("average_amount"),
                        F.when(F.kll_sketch_get_n_double("sketch") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).alias("median_amount"),
                        "gt_fraud_count")


def stream_closed_steps(spark: SparkSession, source_dir: str, schema, out_dir: str, ckpt_dir: str, delay_s: int = 3600,
                        max_files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(closed hours, late rows, hours still open) after what is in the source."""
    state = os.path.join(ckpt_dir, "step_state")

    def at(name: str, batch_id: int) -> str:
        return os.path.join(state, name, f"batch_id={batch_id}")

    def frontier(before: int | None = None):
        """Batch id and latest event time (microseconds) of the last version, before a batch if given."""
        if not _exists(spark, os.path.join(state, "frontier")):
            return None
        d = spark.read.schema("latest long, batch_id long").parquet(os.path.join(state, "frontier"))
        return (d if before is None else d.where(F.col("batch_id") < before)).orderBy(F.desc("batch_id")).first()

    def closed(hour: str | Column, latest: int) -> Column:
        """Whether an hour is closed at a latest event time."""
        return F.unix_micros(hour) + (3600 + delay_s) * 1_000_000 <= latest

    def sink(batch: DataFrame, batch_id: int):
        prev = frontier(batch_id)
        late = F.col("ts").isNull()
        if prev is not None and prev["latest"] is not None:
            late = late | closed(F.date_trunc("hour", "ts"), prev["latest"])
        batch = batch.persist()
        try:
            batch.where(late).write.mode("overwrite").parquet(at("late", batch_id))
            top = batch.agg(F.max(F.unix_micros("ts"))).first()[0]
            hours = _partials(batch.where(~late))
            if prev is not None:
                hours = hours.unionByName(spark.read.parquet(at("open", prev["batch_id"])))
                top = max((t for t in (top, prev["latest"]) if t is not None), default=None)
            hours = _merged(hours).withColumn("closed", F.lit(False) if top is None else closed("hour", top))
            hours.write.mode("overwrite").parquet(at("hours", batch_id))
        finally:
            batch.unpersist()
        hours = spark.read.parquet(at("hours", batch_id))
        hours.where("NOT closed").drop("closed").write.mode("overwrite").parquet(at("open", batch_id))
        _finished(hours.where("closed")).write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))
        spark.createDataFrame([(top,)], "latest long").coalesce(1).write.mode("overwrite").parquet(at("frontier", batch_id))

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    _run(reader.parquet(source_dir).writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(ckpt_dir, "closed_steps")),
         "st2_closed_steps")
    last = frontier()
    if last is None:        # an empty source
        rows = spark.createDataFrame([], schema)
        none = _finished(_merged(_partials(rows)))
        return none, rows, none
    late = spark.read.schema(schema).parquet(os.path.join(state, "late")).select(*[f.name for f in schema])
    return spark.read.parquet(out_dir).drop("batch_id"), late, _finished(spark.read.parquet(at("open", last["batch_id"])))
