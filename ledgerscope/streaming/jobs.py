"""Structured Streaming versions of the scoring, step-table and history jobs
(ST1-ST3). Each run uses ``trigger(availableNow=True)`` so it processes what is
in the source folder and stops; the same code runs continuously with a
processing-time trigger. Checkpoints and state live under the folder given
(on a cluster: the shared folder named by ``spark.checkpoint.dir``).
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import history as H


def _run(writer, name: str):
    q = writer.queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


# ------------------------------------------------------------------- ST1
def stream_decisions(spark: SparkSession, source_dir: str, schema, out_dir: str, ckpt_dir: str,
                     frozen: DataFrame, modes: DataFrame, score_fn, spikes: DataFrame | None = None,
                     contrib_fn=None) -> DataFrame:
    """ST1: requests arriving as files are decided with the batch code; the
    frozen table (<= 5 rows) and the spike table (one row per step) are
    stream-static broadcast joins."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    out = D.decide(src, frozen, modes, score_fn, spikes, contrib_fn=contrib_fn)
    flat = out.select(*[c for c in out.columns if c not in ("explanation", "spike_context", "top_reasons")],
                      F.to_json("top_reasons").alias("top_reasons"),
                      F.to_json("explanation").alias("explanation"),
                      F.to_json("spike_context").alias("spike_context"))
    _run(flat.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", os.path.join(ckpt_dir, "decisions")).outputMode("append"), "st1_decisions")
    return spark.read.parquet(out_dir)


# ------------------------------------------------------------------- ST2
def stream_step_counts(spark: SparkSession, source_dir: str, schema, out_dir: str, ckpt_dir: str,
                       epoch_s: int, delay: str = "1 hour") -> DataFrame:
    """ST2: hourly tumbling windows on event time with a watermark; windows
    older than the watermark are final and their state is dropped; rows later
    than that are ignored (the late-data rule). Update mode; each micro-batch
    appends its updated windows with the batch id, and readers keep the last
    version of every window."""
    src = spark.readStream.schema(schema).parquet(source_dir).withWatermark("ts", delay)
    agg = src.groupBy(F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.sum((F.col("type") == "TRANSFER").cast("int")).cast("long").alias("transfer_count"),
        F.sum((F.col("type") == "CASH_OUT").cast("int")).cast("long").alias("cash_out_count"),
        F.sum("amount").alias("total_amount"), F.avg("amount").alias("average_amount"),
        F.sum("isFraud").cast("long").alias("gt_fraud_count"))

    def sink(batch: DataFrame, batch_id: int):
        step = (F.floor((F.unix_seconds(F.col("w.start")) - F.lit(epoch_s)) / 3600).cast("int") + 1)
        (batch.select(step.alias("step"), "*").drop("w").withColumn("batch_id", F.lit(batch_id))
              .write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}")))

    _run(agg.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(ckpt_dir, "steps"))
         .outputMode("update"), "st2_steps")
    return latest_versions(spark, out_dir, ["step"])


def latest_versions(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last written version of every key (one row per key)."""
    df = spark.read.parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "batch_id")


# ------------------------------------------------------------------- ST3
def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the (shared) file system, via Hadoop's API."""
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jp)


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - an absent folder means "no state yet"
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def _with_history(rows: DataFrame, totals: DataFrame | None, pairs: DataFrame) -> DataFrame:
    """``rows`` with their strictly-prior history: the totals of the steps closed
    before plus what earlier steps among ``rows`` add. ``pairs``: the
    (destination, origin) pairs first seen among ``rows``, with their first step."""
    hist = H.prior_history_table(rows, counterparty=None)
    new_per = pairs.groupBy("nameDest", "step").agg(F.count(F.lit(1)).alias("_new"))
    w = Window.partitionBy("nameDest").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    u = (hist.select("nameDest", "step").join(new_per, ["nameDest", "step"], "left").fillna(0, subset=["_new"])
             .select("nameDest", "step", F.coalesce(F.sum("_new").over(w), F.lit(0)).alias("_u")))
    h = hist.join(u, ["nameDest", "step"])
    if totals is None:
        h = h.select("*", *[F.lit(0).alias(c) for c in ("t_n", "t_sum", "t_max", "t_u")])
    else:
        h = h.join(totals, "nameDest", "left").fillna(0, subset=["t_n", "t_sum", "t_max", "t_u"])
    n = F.col("hist_dest_txn_count") + F.col("t_n")
    total = F.col("hist_dest_total_amount") + F.col("t_sum")
    h = h.select("nameDest", "step", n.cast("long").alias("hist_dest_txn_count"),
                 (F.col("_u") + F.col("t_u")).cast("long").alias("hist_dest_unique_origin_count"),
                 total.alias("hist_dest_total_amount"),
                 F.greatest("hist_dest_max_amount", F.col("t_max").cast("double")).alias("hist_dest_max_amount"),
                 F.when(n > 0, total / n).otherwise(F.lit(0.0)).alias("hist_dest_avg_amount"))
    return rows.join(h, ["nameDest", "step"], "left")


def late_rows(spark: SparkSession, schema, ckpt_dir: str) -> DataFrame:
    """The rows a history run put apart: of a closed step, or without a step."""
    late = os.path.join(ckpt_dir, "dest_state", "late")
    return spark.read.schema(schema).parquet(late).drop("batch_id") if _exists(spark, late) else spark.createDataFrame([], schema)


def stream_dest_history(spark: SparkSession, source_dir: str, schema, out_dir: str, ckpt_dir: str,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """ST3: strictly-prior destination history on a stream.

    The highest step seen is open: its rows are held as state, since more of
    them may come, and written out when a row of a later step closes it. A row
    of a closed step, or without a step, is late: it goes to ``late`` under the
    state folder and changes no history. The result is the sink's rows plus the
    rows of the open step, whose history is already settled (all earlier steps
    are closed).

    State lives in tables under the checkpoint folder, keyed by batch id:
    ``rows`` (the batch's rows and the held ones, marked open or not),
    ``totals`` (per destination over all closed steps: rows, sum, max, distinct
    origins; one version per batch) and ``seen`` (the (destination, origin)
    pairs first seen in each batch; append-only, so a hot destination's origins
    are never one state value). A retried batch rewrites the same versions.
    """
    state = os.path.join(ckpt_dir, "dest_state")

    def at(name: str, batch_id: int) -> str:
        return os.path.join(state, name, f"batch_id={batch_id}")

    def save(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def before(batch_id: int | None = None):
        """The last version's meta row, before ``batch_id`` if given."""
        meta = _read_or_none(spark, os.path.join(state, "meta"))
        if meta is not None and batch_id is not None:
            meta = meta.where(F.col("batch_id") < batch_id)
        return None if meta is None else meta.orderBy(F.desc("batch_id")).first()

    def known(prev):
        """Totals and seen pairs as of a version."""
        if prev is None:
            return None, None
        seen = _read_or_none(spark, os.path.join(state, "seen"))
        if seen is not None:
            seen = seen.where(F.col("batch_id") <= prev["batch_id"]).select("nameDest", "nameOrig")
        return spark.read.parquet(at("totals", prev["batch_id"])), seen

    def first_seen(rows: DataFrame, seen: DataFrame | None) -> DataFrame:
        pairs = rows.groupBy("nameDest", "nameOrig").agg(F.min("step").alias("step"))
        if seen is None:
            return pairs
        same = (pairs["nameDest"].eqNullSafe(seen["nameDest"])) & (pairs["nameOrig"].eqNullSafe(seen["nameOrig"]))
        return pairs.join(seen, same, "left_anti")

    def held(prev) -> DataFrame:
        return spark.read.schema(schema).parquet(at("open", prev["batch_id"]))

    def sink(batch: DataFrame, batch_id: int):
        prev = before(batch_id)
        frontier = prev["frontier"] if prev else None
        fits = F.col("step").isNotNull() if frontier is None else F.coalesce(F.col("step") >= frontier, F.lit(False))
        save(batch.where(~fits), at("late", batch_id))
        rows = batch.where(fits)
        if prev is not None:
            rows = rows.unionByName(held(prev))
        save(rows, at("rows", batch_id))
        rows = spark.read.schema(schema).parquet(at("rows", batch_id))
        top = rows.agg(F.max("step")).first()[0]
        save(rows.where(F.col("step") == top), at("open", batch_id))
        closed = rows.where(F.col("step") < top)
        totals, seen = known(prev)
        save(first_seen(closed, seen), at("seen", batch_id))
        pairs = spark.read.parquet(at("seen", batch_id))
        save(_with_history(closed, totals, pairs), os.path.join(out_dir, f"batch_id={batch_id}"))

        per = closed.groupBy("nameDest").agg(F.count(F.lit(1)).alias("t_n"), F.sum(F.col("amount").cast("double")).alias("t_sum"),
                                             F.max(F.col("amount").cast("double")).alias("t_max"), F.lit(0).cast("long").alias("t_u"))
        per = per.unionByName(pairs.groupBy("nameDest").agg(F.count(F.lit(1)).alias("t_u")), allowMissingColumns=True)
        if totals is not None:
            per = per.unionByName(totals)
        save(per.groupBy("nameDest").agg(
            F.coalesce(F.sum("t_n"), F.lit(0)).alias("t_n"), F.coalesce(F.sum("t_sum"), F.lit(0.0)).alias("t_sum"),
            F.coalesce(F.max("t_max"), F.lit(0.0)).alias("t_max"), F.coalesce(F.sum("t_u"), F.lit(0)).alias("t_u")),
            at("totals", batch_id))
        save(spark.createDataFrame([(frontier if top is None else top,)], "frontier int"), at("meta", batch_id))

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    _run(src.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(ckpt_dir, "history")),
         "st3_history")
    last = before()
    if last is None:        # an empty source
        return _with_history(spark.createDataFrame([], schema), None, first_seen(spark.createDataFrame([], schema), None))
    totals, seen = known(last)
    rows = held(last)
    settled = _with_history(rows, totals, first_seen(rows, seen))
    return spark.read.parquet(out_dir).drop("batch_id").unionByName(settled)
