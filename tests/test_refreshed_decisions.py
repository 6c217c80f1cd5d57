"""Streamed decisions whose lookup tables change between micro-batches."""
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import decide as D
from ledgerscope.plans import q_streaming as QS
from ledgerscope.plans.catalog import ledger
from ledgerscope.session import ensure_checkpoint_dir
from ledgerscope.sources import artifacts as A
from ledgerscope.sources import published as PB
from ledgerscope.streaming import refreshed as RF
from tests.conftest import ORDINARY

REQUEST = {"event_id": 0, **{k: ORDINARY[k] for k in ("step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest")}}


def _folders(spark):
    base = os.path.join(ensure_checkpoint_dir(spark).replace("file:", ""), f"refreshed-{uuid.uuid4().hex}")
    return {n: os.path.join(base, n) for n in ("source", "sink", "ckpt", "frozen", "spikes")}


def _requests(spark, path, ids):
    """A file per id, in the order of the ids."""
    for i in ids:
        df = spark.createDataFrame([{**REQUEST, "event_id": i}])
        df.coalesce(1).write.mode("append").parquet(path)
    files = sorted((os.path.getmtime(os.path.join(path, n)), n) for n in os.listdir(path) if n.endswith(".parquet"))
    for k, (_, n) in enumerate(files):
        os.utime(os.path.join(path, n), (time.time() - 1000 + k,) * 2)
    return df.schema


def _frozen(spark, mean):
    return spark.createDataFrame([("CASH_OUT", mean, 9000.0)], "type string, mean_amount double, p95_amount double")


def _spikes(spark, flag):
    return spark.createDataFrame([(ORDINARY["step"], flag, 1.0, 1.0)], "step int, stat_method_pred int, txn_count_vs_hour_baseline_ratio double, "
                                 "predicted_high_risk_count_vs_hour_baseline_ratio double")


def _run(spark, at, schema, score_fn):
    return RF.stream_refreshed_decisions(spark, at["source"], schema, at["sink"], at["ckpt"], at["frozen"], at["spikes"],
                                         D.modes_table(spark), score_fn, max_files_per_trigger=1)


def _ratio(df):
    return df.withColumn("pred_prob", F.col("amount_to_type_avg_ratio") / 100)


def test_a_change_shows_from_the_next_micro_batch_on(spark):
    at = _folders(spark)
    schema = _requests(spark, at["source"], range(5))
    PB.publish_table(_frozen(spark, 5000.0), at["frozen"])
    calls = []

    def score_fn(df):
        calls.append(1)
        if len(calls) == 2:             # while the second micro-batch is decided
            PB.publish_table(_frozen(spark, 500.0), at["frozen"])
            PB.publish_table(_spikes(spark, 1), at["spikes"])
        if len(calls) == 4:
            PB.publish_table(_spikes(spark, 0), at["spikes"])
        return _ratio(df)

    out = _run(spark, at, schema, score_fn)
    got = [(r.batch_id, r.frozen_version, r.spikes_version, r.risk_score, r.recommended_action) for r in out.orderBy("batch_id").collect()]
    assert got == [(0, 1, None, 0.01, "ALLOW"), (1, 1, None, 0.01, "ALLOW"), (2, 2, 1, 0.1, "REVIEW"), (3, 2, 1, 0.1, "REVIEW"), (4, 2, 2, 0.1, "ALLOW")]


def test_a_micro_batch_run_again_keeps_its_versions(spark):
    at = _folders(spark)
    schema = _requests(spark, at["source"], range(2))
    PB.publish_table(_frozen(spark, 5000.0), at["frozen"])
    calls = []

    def fails_once(df):
        calls.append(1)
        if len(calls) == 2:
            PB.publish_table(_frozen(spark, 500.0), at["frozen"])
            raise RuntimeError("lost")
        return _ratio(df)

    with pytest.raises(Exception, match="lost"):
        _run(spark, at, schema, fails_once)
    out = _run(spark, at, schema, fails_once)
    assert [(r.event_id, r.frozen_version) for r in out.orderBy("event_id").collect()] == [(0, 1), (1, 1)]
    _requests(spark, at["source"], [2])
    assert {(r.event_id, r.frozen_version) for r in _run(spark, at, schema, fails_once).collect()} == {(0, 1), (1, 1), (2, 2)}


def test_versions_that_are_not_finished_or_missing(spark):
    at = _folders(spark)
    schema = _requests(spark, at["source"], range(1))
    with pytest.raises(Exception, match="no complete version"):
        _run(spark, at, schema, _ratio)
    with pytest.raises(Exception, match="lost"):
        PB.publish_table(_frozen(spark, 1.0).withColumn("mean_amount", F.raise_error(F.lit("lost")).cast("double")), at["frozen"])
    assert PB.complete_versions(spark, at["frozen"]) == []
    assert PB.publish_table(_frozen(spark, 5000.0), at["frozen"]) == 2
    at["ckpt"] += "-new"
    assert _run(spark, at, schema, _ratio).first().frozen_version == 2


def test_rows_of_one_task_are_laid_down_in_bounded_files(spark, tmp_path, monkeypatch):
    """A large events file that one task reads must not leave its requests, their
    decisions and the result to one task each."""
    monkeypatch.setattr(A, "ROWS_PER_FILE", 20, raising=False)
    monkeypatch.setattr(QS, "frozen_stats", lambda *_: _frozen(spark, 5000.0))
    monkeypatch.setattr(QS, "extended_steps", lambda *_: _spikes(spark, 1))
    at = []
    scratch = QS._scratch
    monkeypatch.setattr(QS, "_scratch", lambda s: at.append(scratch(s)) or at[-1])
    events = spark.range(0, 120, 1, 1).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(QS.EVENTS_EPOCH_S + F.col("id") % 100 * 7 * 3600).alias("ts"), F.col("id").alias("user_id"),
        F.lit("click").alias("event_type"), (F.col("id") + 0.5).alias("value"), F.lit('{"k": 1}').alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    out = QS.risk_decisions_refreshed(spark, str(tmp_path)).collect()
    # 7 * 51 + 1 is the last step up to 360: ids 0 to 51 and 100 to 119
    assert sorted((r.event_id, r.spikes_version) for r in out) == [(i, None if i % 100 <= 51 else 1) for i in range(120)]
    _, src, sink, _ = at[0]
    for df in (ledger(spark, str(tmp_path)), spark.read.parquet(src), spark.read.parquet(sink)):
        files = [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]
        assert sum(files) == 120 and max(files) <= 20
