import math

import pytest
from pyspark.sql import functions as F

from conftest import FRAUD_LIKE, ORDINARY
from ledgerscope.operators import decide as D
from ledgerscope.operators import quality as Q

REQ_SCHEMA = ("step string, type string, amount string, oldbalanceOrg double, newbalanceOrig double, "
              "oldbalanceDest double, newbalanceDest double, hist_dest_txn_count long, "
              "hist_dest_unique_origin_count long, hist_dest_total_amount double, hist_dest_avg_amount double, "
              "hist_dest_max_amount double, mode string")
COLS = [f.split()[0] for f in REQ_SCHEMA.split(", ")]


def _req(spark, rows):
    data = []
    for r in rows:
        data.append(tuple(None if r.get(c) is None else (str(r[c]) if c in ("step", "type", "amount") else r[c])
                          for c in COLS))
    return spark.createDataFrame(data, REQ_SCHEMA).withColumn("rid", F.monotonically_increasing_id())


def _frozen(spark):
    # Published frozen per-type p95 and mean amounts.
    return spark.createDataFrame([
        ("CASH_IN", 412379.2225, 168983.9291), ("CASH_OUT", 427918.407, 176040.3092),
        ("DEBIT", 14973.286, 5599.6529), ("PAYMENT", 37978.6215, 13104.3143),
        ("TRANSFER", 2678302.9085, 920839.3115)], "type string, p95_amount double, mean_amount double")


def _score(df):
    return df.withColumn("pred_prob", F.least(F.lit(1.0), F.col("amount") / F.lit(2_000_000.0)))


@pytest.mark.parametrize("score,band", [(0.0, "LOW"), (0.05, "LOW"), (0.169, "LOW"), (0.17, "MEDIUM"),
                                        (0.30, "MEDIUM"), (0.429, "MEDIUM"), (0.43, "HIGH"), (0.99, "HIGH"),
                                        (1.0, "HIGH")])
def test_band_boundaries(spark, score, band):
    df = spark.createDataFrame([(score,)], "s double")
    r = df.select(D.risk_band(F.col("s"), 0.43, 0.17).alias("b")).first()
    assert r.b == band
    assert df.select(D.band_action(F.lit(band)).alias("a")).first().a == ("ALLOW" if band == "LOW" else "REVIEW")


def test_validation_lists_every_error(spark):
    bad = [
        {"step": 1, "type": "TRANSFER"},                                        # missing amount + balances
        dict(FRAUD_LIKE, amount=-100),
        dict(FRAUD_LIKE, amount="not-a-number"),
        dict(FRAUD_LIKE, amount=float("nan")),
        dict(FRAUD_LIKE, type="WIRE_XYZ"),
        {"step": 1, "type": "BAD_TYPE", "amount": -5},
    ]
    v = Q.validate(_req(spark, bad)).orderBy("rid").collect()
    assert not any(r.is_valid for r in v)
    assert v[0].errors[0] == ("missing required field(s): amount, oldbalanceOrg, newbalanceOrig, oldbalanceDest, "
                              "newbalanceDest")
    assert v[1].errors == ["invalid amount: '-100' (must be >= 0)"]
    assert v[2].errors == ["invalid amount: 'not-a-number' (must be a finite number)"]
    assert v[3].errors == ["invalid amount: 'nan' (must be a finite number)"]
    assert v[4].errors[0].startswith("unknown transaction type: 'WIRE_XYZ' (must be one of ['CASH_IN',")
    assert len(v[5].errors) >= 3


def test_validation_defaults_and_normalisation(spark):
    v = Q.validate(_req(spark, [dict(FRAUD_LIKE, type="  transfer ")])).first()
    assert v.is_valid and v.clean_type == "TRANSFER" and v.clean_hist_dest_txn_count == 0
    assert v.clean_hist_dest_avg_amount == 0.0


def _decide(spark, rows, spikes=None):
    return D.decide(_req(spark, rows), _frozen(spark), D.modes_table(spark), _score, spikes).orderBy("rid").collect()


def test_decisions_statuses(spark):
    rows = [FRAUD_LIKE, ORDINARY, dict(ORDINARY, hist_dest_avg_amount=float("nan")),
            dict(ORDINARY, mode="turbo"), dict(ORDINARY, mode="high_precision"), {"step": 3}]
    d = _decide(spark, rows)
    assert d[0].status == "ok" and d[0].risk_band == "HIGH" and d[0].recommended_action == "REVIEW"
    assert d[0].threshold_used == 0.43 and d[0].mode == "BALANCED"
    assert d[1].status == "ok" and d[1].risk_band == "LOW" and d[1].recommended_action == "ALLOW"
    assert d[2].status == "degraded" and "hist_dest_avg_amount" in d[2].message
    assert d[2].recommended_action == "MANUAL_REVIEW" and d[2].fallback == "MANUAL_REVIEW"
    assert d[3].status == "degraded" and d[3].message.startswith("Unknown operating mode 'TURBO'")
    assert d[4].status == "ok" and d[4].threshold_used == 0.17
    assert d[5].status == "invalid_input" and d[5].message.startswith("Transaction failed validation: missing")
    assert d[5].recommended_action is None


def test_low_score_in_spike_step_is_reviewed(spark):
    spikes = spark.createDataFrame([(200, 1, 0, 1.2, 3.4), (5, 0, 0, 1.0, 1.0)],
                                   "step int, stat_method_pred int, iso_method_pred int, "
                                   "txn_count_vs_hour_baseline_ratio double, "
                                   "predicted_high_risk_count_vs_hour_baseline_ratio double")
    d = _decide(spark, [ORDINARY, FRAUD_LIKE, dict(ORDINARY, step=999)], spikes)
    assert d[0].risk_band == "LOW" and d[0].recommended_action == "REVIEW"
    assert d[0].top_reasons[-1].startswith("transaction occurred during a step flagged")
    assert d[1].spike_context.is_spike is False
    assert d[2].spike_context.available and "outside the historical spike-detection" in d[2].spike_context.note


def test_missing_spike_table_does_not_block(spark):
    d = _decide(spark, [ORDINARY], None)
    assert d[0].status == "ok" and d[0].spike_context.available is False


def test_frozen_online_features(spark):
    from ledgerscope.operators.train import FEATURES
    v = Q.validate(_req(spark, [FRAUD_LIKE, ORDINARY])).orderBy("rid")
    f = D.online_features(v, _frozen(spark)).orderBy("rid").collect()
    a, b = f[0], f[1]
    assert a.drained_to_zero == 1 and a.destination_is_new == 1 and a.hist_dest_txn_count == 0
    assert a.amount_to_type_avg_ratio == pytest.approx(1500000.0 / 920839.3115)
    assert a.high_amount_indicator == 0 and a.hour_of_day == 5
    assert b.destination_is_new == 0 and b.amount_to_dest_avg_ratio == 1.0
    assert a.amount_to_origin_balance_ratio == 1.0 and a.log_amount == pytest.approx(math.log1p(1500000.0))
    assert all(c in f[0].asDict() for c in FEATURES)
