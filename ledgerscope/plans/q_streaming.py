"""B9 queries: the streaming jobs run over the ledger written as a file
source (under the session's checkpoint folder), returning the sink's rows.
Acceptance: each equals its batch counterpart, so the batch oracles apply."""
from __future__ import annotations

import os
import re
import time
import uuid

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import decide as D
from ..session import ensure_checkpoint_dir
from ..sources.artifacts import bounded_files
from ..sources.ledger import EVENTS_EPOCH_S
from ..sources.published import publish_table
from ..streaming import closed_steps as CS
from ..streaming import jobs as SJ
from ..streaming import keyed_history as KH
from ..streaming import refreshed as RF
from .catalog import ledger, r, register
from .q_decide import frozen_stats
from .q_features import DEST_HISTORY_SQL, _dest_history_out
from .q_quality import ledger_requests
from .q_features import with_features
from .q_spikes import EXT_CTES, extended_steps
from .catalog import ORACLES
from .sql import with_ledger
from . import q_decide as _qd  # noqa: F401

RISK_SQL = ORACLES["risk_decisions_linear"]


#: So a history run has several micro-batches and carries state between them.
FILES_PER_BATCH = 2


def _scratch(spark):
    base = ensure_checkpoint_dir(spark)
    d = os.path.join(base, f"stream-{uuid.uuid4().hex}")
    return d, os.path.join(d, "source"), os.path.join(d, "sink"), os.path.join(d, "ckpt")


def _write_source(df, path, by):
    """Lay the rows down as files in time order, as many as Spark makes of them.
    Tasks end in any order and the file source goes by file time, so the times
    are set by range, a second apart, before a stream reads the files."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
    spark = df.sparkSession
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = {f.getPath().getName(): f.getPath() for f in fs.listStatus(jp)}
    # part-<range>-<job>-c<file of the range>
    parts = sorted((int(m[1]), int(m[2]), n) for n in files if (m := re.match(r"part-(\d+)-.*?c(\d+)\.", n)))
    start = int(time.time() - len(parts)) * 1000
    for i, (_, _, name) in enumerate(parts):
        fs.setTimes(files[name], start + 1000 * i, -1)


@register("dest_history_stream", DEST_HISTORY_SQL)
def dest_history_stream(spark, sf_dir):
    """ST3: strictly-prior destination history computed by the streaming job."""
    _, src, sink, ck = _scratch(spark)
    led = ledger(spark, sf_dir).select("event_id", "step", "nameDest", "nameOrig", "amount")
    # ranges of (step, id) end inside steps: the rows of one step come in two files
    _write_source(led, src, ["step", "event_id"])
    out = SJ.stream_dest_history(spark, src, led.schema, sink, ck, max_files_per_trigger=FILES_PER_BATCH)
    late = SJ.late_rows(spark, led.schema, ck)
    n_late = late.where("step IS NOT NULL").count()
    if n_late:      # a store that does not keep the file times
        raise RuntimeError(f"dest_history_stream: {n_late} rows came after their step was closed")
    # nothing comes before a row without a step
    out = out.unionByName(late.select("*", *[F.lit(0).cast(out.schema[c].dataType).alias(c) for c in out.columns if c.startswith("hist_")]))
    out = (out.withColumn("destination_is_new", (F.col("hist_dest_txn_count") == 0).cast("int"))
              .withColumn("amount_to_dest_avg_ratio", F.least(F.lit(1000.0), F.when(
                  F.col("hist_dest_avg_amount") > 0, F.col("amount") / F.col("hist_dest_avg_amount")).otherwise(1.0))))
    return _dest_history_out(out)


@register("dest_history_keyed", DEST_HISTORY_SQL)
def dest_history_keyed(spark, sf_dir):
    """ST3: the same history by keyed state, event-time timers and a watermark."""
    _, src, sink, ck = _scratch(spark)
    led = ledger(spark, sf_dir).select("event_id", "step", "nameDest", "nameOrig", "amount")
    _write_source(led, src, ["step", "event_id"])
    # every micro-batch starts a Python worker and a state store for each partition: a few a core, not more
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    out = KH.stream_keyed_history(spark, src, led.schema, sink, ck, FILES_PER_BATCH, partitions)
    late = KH.late_rows(led, out)
    n_late = late.where("step IS NOT NULL").count()
    if n_late:
        raise RuntimeError(f"dest_history_keyed: {n_late} rows came after their step was closed")
    # nothing comes before a row without a step
    out = out.unionByName(late.select("*", *[F.lit(0).cast(out.schema[c].dataType).alias(c) for c in out.columns if c.startswith("hist_")]))
    return _dest_history_out(out.withColumn("destination_is_new", X.destination_is_new())
                             .withColumn("amount_to_dest_avg_ratio", X.amount_to_dest_avg_ratio()))


@register("step_counts_stream", with_ledger() + """
SELECT step, count(*) AS transaction_count, cast(sum(CASE WHEN type = 'TRANSFER' THEN 1 ELSE 0 END) AS BIGINT)
  AS transfer_count, cast(sum(CASE WHEN type = 'CASH_OUT' THEN 1 ELSE 0 END) AS BIGINT) AS cash_out_count,
  round(sum(amount), 4) AS total_amount, round(avg(amount), 6) AS average_amount,
  cast(sum(isFraud) AS BIGINT) AS gt_fraud_count
FROM ledger GROUP BY step""")
def step_counts_stream(spark, sf_dir):
    """ST2: hourly counts as event-time tumbling windows with a watermark."""
    _, src, sink, ck = _scratch(spark)
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", F.col("ts").cast("timestamp")
                                                                            .alias("ts"))
    rows = ledger(spark, sf_dir).select("event_id", "type", "amount", "isFraud").join(ev, "event_id")
    _write_source(rows, src, ["ts"])
    out = SJ.stream_step_counts(spark, src, rows.schema, sink, ck, EVENTS_EPOCH_S)
    return out.select("step", "transaction_count", "transfer_count", "cash_out_count",
                      r("total_amount", 4).alias("total_amount"), r("average_amount").alias("average_amount"),
                      "gt_fraud_count")


#: DEBIT rows reach the closed-window stream this many hours after their time.
LATE_HOURS = 30


@register("step_windows_stream", with_ledger() + """
SELECT step, count(*) AS transaction_count, count(*) FILTER (type = 'TRANSFER') AS transfer_count,
  count(*) FILTER (type = 'CASH_OUT') AS cash_out_count, cast(sum(isFraud) AS BIGINT) AS gt_fraud_count,
  round(sum(amount), 4) AS total_amount, true AS once, true AS median_near
FROM ledger GROUP BY step""")
def step_windows_stream(spark, sf_dir):
    """ST2: hours that come out once, when closed, and the rows that came later
    than that. Which rows are late depends on the micro-batches; hours and late
    rows together are the ledger's, and each hour's median is near that of its
    own rows (by rank)."""
    _, src, sink, ck = _scratch(spark)
    rows = ledger(spark, sf_dir).select("event_id", F.timestamp_seconds((F.col("step").cast("long") - 1) * 3600 + EVENTS_EPOCH_S).alias("ts"),
                                        "type", "amount", "isFraud")
    arrives = F.when(F.col("type") == "DEBIT", F.col("ts") + F.expr(f"interval {LATE_HOURS} hours")).otherwise(F.col("ts"))
    _write_source(rows.withColumn("arrives", arrives), src, ["arrives", "event_id"])
    closed, late, still_open = CS.stream_closed_steps(spark, src, rows.schema, sink, ck, max_files_per_trigger=FILES_PER_BATCH)

    def step(at):
        return (F.floor((F.unix_seconds(at) - F.lit(EVENTS_EPOCH_S)) / 3600) + 1).cast("int").alias("step")

    hours = closed.unionByName(still_open)
    # the rows that each hour was made of, for comparison only
    own = rows.join(late.select("event_id"), "event_id", "left_anti").join(hours.select("hour", "median_amount"), F.col("ts") == F.col("hour"))
    m, n, e = F.col("median_amount"), F.count("amount"), 0.04      # three times the sketch's rank error
    near = own.groupBy(step("ts")).agg(
        ((F.count(F.when(F.col("amount") <= m, 1)) >= (0.5 - e) * n - 1) & (F.count(F.when(F.col("amount") < m, 1)) <= (0.5 + e) * n + 1)).alias("near"))
    sums = ["transaction_count", "transfer_count", "cash_out_count", "gt_fraud_count", "total_amount"]
    both = hours.select(step("hour"), *sums, F.lit(1).alias("windows")).unionByName(late.groupBy(step("ts")).agg(
        F.count(F.lit(1)).alias("transaction_count"), F.count_if(F.col("type") == "TRANSFER").alias("transfer_count"),
        F.count_if(F.col("type") == "CASH_OUT").alias("cash_out_count"), F.sum(F.col("isFraud").cast("long")).alias("gt_fraud_count"),
        F.sum("amount").alias("total_amount"), F.lit(0).alias("windows")))
    out = both.groupBy("step").agg(*[F.sum(c).alias(c) for c in sums], (F.sum("windows") <= 1).alias("once")).join(near, "step", "left")
    return out.select("step", *sums[:-1], r("total_amount", 4).alias("total_amount"), "once", F.coalesce("near", F.lit(True)).alias("median_near"))


@register("risk_decisions_stream", RISK_SQL)
def risk_decisions_stream(spark, sf_dir):
    """ST1: banded decisions on the fixed linear score, computed by the
    streaming job (equals risk_decisions_linear)."""
    _, src, sink, ck = _scratch(spark)
    req = ledger_requests(spark, sf_dir)
    _write_source(req, src, ["event_id"])

    def score_fn(df):
        return df.withColumn("pred_prob", F.least(F.lit(1.0), F.col("amount") / 500.0))

    out = SJ.stream_decisions(spark, src, req.schema, sink, ck, frozen_stats(spark, sf_dir),
                              D.modes_table(spark), score_fn, extended_steps(spark, sf_dir))
    return out.select("event_id", "status", "risk_score", "risk_band", "recommended_action", "mode",
                      "threshold_used", "alert", F.size(F.from_json("top_reasons", "array<string>")).alias("n_reasons"),
                      F.get_json_object("spike_context", "$.is_spike").cast("boolean").alias("is_spike"))


#: Requests up to this step are decided before the spike table is first brought up to date.
REFRESH_AFTER = 360


@register("risk_decisions_refreshed", with_features(EXT_CTES) + f"""
SELECT l.event_id, 'ok' AS status, round(least(1.0, l.amount / 500.0), 6) AS risk_score,
  CASE WHEN least(1.0, l.amount / 500.0) >= 0.17 THEN 'REVIEW'
       WHEN step > {REFRESH_AFTER} AND coalesce(e.stat_method_pred = 1, false) THEN 'REVIEW' ELSE 'ALLOW' END AS recommended_action,
  step > {REFRESH_AFTER} AND coalesce(e.stat_method_pred = 1, false) AS is_spike,
  step > {REFRESH_AFTER} AND e.step IS NULL AS outside, 1 AS frozen_version,
  CASE WHEN step > {REFRESH_AFTER} THEN 1 END AS spikes_version
FROM ledger l LEFT JOIN ext e USING (step)""")
def risk_decisions_refreshed(spark, sf_dir):
    """ST1: decisions of a stream whose spike table is published only after a
    part of the requests: they are decided without it, the others with it."""
    d, src, sink, ck = _scratch(spark)
    frozen_root, spikes_root = os.path.join(d, "frozen"), os.path.join(d, "spikes")
    publish_table(frozen_stats(spark, sf_dir), frozen_root)
    req = ledger_requests(spark, sf_dir)
    early = F.col("step").cast("int") <= REFRESH_AFTER

    def score_fn(df):
        return df.withColumn("pred_prob", F.least(F.lit(1.0), F.col("amount") / 500.0))

    for part in (req.where(early), req.where(~F.coalesce(early, F.lit(False)))):
        bounded_files(part.write.mode("append")).parquet(src)     # a micro-batch has no more tasks than its files have row groups
        out = RF.stream_refreshed_decisions(spark, src, req.schema, sink, ck, frozen_root, spikes_root, D.modes_table(spark), score_fn)
        publish_table(extended_steps(spark, sf_dir), spikes_root)
    # its own column: parsed once a row for both fields
    out = out.withColumn("ctx", F.from_json("spike_context", "is_spike boolean, note string"))
    return out.select("event_id", "status", "risk_score", "recommended_action", F.coalesce("ctx.is_spike", F.lit(False)).alias("is_spike"),
                      F.col("ctx.note").isNotNull().alias("outside"), "frozen_version", "spikes_version")
