import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import rootcause as RC
from ledgerscope.operators import spikes as SP
from ledgerscope.operators.iforest import IsolationForestJob


def _twf(spark, n=20, spikes=(5, 12)):
    rng = np.random.RandomState(0)
    rows = []
    for s in range(1, n + 1):
        tc = int(rng.randint(50, 100))
        rows.append((s, s % 24, s // 24, tc, tc // 2, tc // 2, int(rng.randint(1, 5)), int(rng.randint(1, 5)),
                     5.0 if s in spikes else 0.1, 1 if s in spikes else 0, int(rng.randint(0, 2)), 0.01))
    return spark.createDataFrame(rows, "step int, hour_of_day int, day_index int, transaction_count long, "
                                       "transfer_count long, cash_out_count long, high_amount_count long, "
                                       "predicted_high_risk_count long, "
                                       "predicted_high_risk_count_zscore_vs_hour_baseline double, "
                                       "gt_fraud_spike int, gt_fraud_count long, gt_fraud_rate double")


def test_zscore_flags_injected_spike(spark):
    flagged = [r.step for r in SP.zscore_flag(_twf(spark, spikes=(5,))).where("stat_method_pred = 1").collect()]
    assert 5 in flagged


def test_detector_confusion_counts(spark):
    t = _twf(spark).withColumn("p", F.col("step").isin(5, 12, 7).cast("int"))
    r = SP.evaluate_detector(t, "unit", "p").first()
    assert (r.tp, r.fp, r.fn, r.n_ground_truth_spikes) == (2, 1, 0, 2)
    assert 0 <= r.precision <= 1 and r.detection_delay_steps == 0


def test_hour_baseline_fallbacks(spark):
    rows = [(1, 1, 10), (2, 2, 20), (25, 1, 30), (49, 1, 50)]
    df = spark.createDataFrame(rows, "step int, hour_of_day int, x long")
    from ledgerscope.operators.steps import add_hour_baseline
    got = {r.step: r for r in add_hour_baseline(df, "x").collect()}
    assert got[1].hist_avg_x_same_hour == 10 and got[1].hist_std_x_same_hour == 0.0   # own value, std 0
    assert got[2].hist_avg_x_same_hour == 10                                          # global fallback
    assert got[25].hist_avg_x_same_hour == 10 and got[25].hist_std_x_same_hour == pytest.approx(np.std([10, 20], ddof=1))
    assert got[49].hist_std_x_same_hour == pytest.approx(np.std([10, 30], ddof=1))    # same-hour std
    assert got[25].x_zscore_vs_hour_baseline == pytest.approx((30 - 10) / np.std([10, 20], ddof=1))


def _row(spark, **kw):
    base = dict(step=100, hour_of_day=3, transaction_count=20, hist_avg_txn_count_same_hour=18.0,
                average_amount=50000.0, hist_avg_amount_same_hour=48000.0, transfer_count=10,
                hist_avg_transfer_count_same_hour=9.0, cash_out_count=10, hist_avg_cash_out_count_same_hour=9.0,
                high_amount_count=2, hist_avg_high_amount_count_same_hour=2.0, predicted_high_risk_count=3,
                hist_avg_predicted_high_risk_count_same_hour=3.0)
    base.update(kw)
    return spark.createDataFrame([base])


def test_root_cause_transfer_driver(spark):
    r = RC.analyze(_row(spark, transfer_count=40, hist_avg_transfer_count_same_hour=10.0)).first()
    assert r.primary_driver == "TRANSFER volume"
    assert any("4.0x" in e for e in r.evidence)
    assert any("not evaluated" in e for e in r.evidence)


def test_root_cause_no_driver(spark):
    r = RC.analyze(_row(spark)).first()
    assert r.primary_driver == "no single driver identified"
    assert RC.NO_DRIVER_TEXT in r.evidence


def test_root_cause_destination_concentration(spark):
    tx = spark.createDataFrame([(100, "C_MULE_1", 10000.0)] * 8 + [(100, f"C_other_{i}", 10000.0) for i in range(2)],
                               "step int, nameDest string, amount double")
    r = RC.analyze(_row(spark), tx).first()
    assert r.primary_driver == "destination concentration"
    assert r.destination_concentration.txn_count_share == 0.8


def test_root_cause_missing_keys_skipped(spark):
    r = RC.analyze(spark.createDataFrame([(1, 0)], "step int, hour_of_day int")).first()
    assert r.contributors == [] and r.primary_driver == "no single driver identified"


def test_batch_root_cause_sentence(spark):
    t = _twf(spark, spikes=(5,))
    t = (t.withColumn("hist_avg_transfer_count_same_hour", F.lit(10.0))
          .withColumn("transfer_count", F.when(F.col("step") == 5, 50).otherwise(F.col("transfer_count")))
          .withColumn("hist_avg_cash_out_count_same_hour", F.lit(1000.0))
          .withColumn("hist_avg_high_amount_count_same_hour", F.lit(1000.0))
          .withColumn("txn_count_vs_hour_baseline_ratio", F.lit(1.0))
          .withColumn("transfer_count_vs_hour_baseline_ratio", F.lit(1.0))
          .withColumn("cash_out_count_vs_hour_baseline_ratio", F.lit(1.0))
          .withColumn("high_amount_count_vs_hour_baseline_ratio", F.lit(1.0))
          .withColumn("predicted_high_risk_count_vs_hour_baseline_ratio", F.lit(1.0)))
    r = SP.root_cause_batch(t, t.where("step = 5")).first()
    assert r.step == 5 and "TRANSFER transactions were 5.0x" in r.explanation


def test_isolation_forest_properties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(1, 0.05, (200, 2)), start=1)]
    rows += [(1001, 8.0, 8.0), (1002, -6.0, 9.0)]
    df = spark.createDataFrame(rows, "step int, f1 double, f2 double")
    job = IsolationForestJob(["f1", "f2"], n_trees=50, seed=42)
    nodes = job.fit(df)
    out = job.transform(df, nodes).orderBy(F.desc("iso_method_score")).collect()
    assert {out[0].step, out[1].step} == {1001, 1002}
    assert all(-0.5 <= r.iso_method_score <= 0.5 for r in out)
    assert out[0].iso_method_pred == 1
    again = job.transform(df, job.fit(df)).orderBy("step").collect()
    first = job.transform(df, nodes).orderBy("step").collect()
    assert [r.iso_method_score for r in again] == [r.iso_method_score for r in first]


def test_iforest_hash_cutoff_picks_the_same_samples_as_the_full_window(spark):
    """On an input much larger than max_samples the per-tree candidates are
    cut by hash before the window; the trees must equal the uncut ones."""
    rng = np.random.RandomState(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (6000, 2)), start=1)]
    df = spark.createDataFrame(rows, "step int, f1 double, f2 double")
    job = IsolationForestJob(["f1", "f2"], n_trees=12, max_samples=64, seed=7)
    cut = job.fit(df)                      # 4 * 64 / 6000 < 1: the cut-off path
    x = job._x(df)
    full = job._fit_sample(x, 64, 6, 1.0)  # every copy goes through the window
    key = ["tree", "node"]
    a = [tuple(r) for r in cut.orderBy(*key).collect()]
    b = [tuple(r) for r in full.orderBy(*key).collect()]
    assert a == b
    assert {r.size for r in cut.where(F.col("node") == 0).collect()} == {64}
