import os
import uuid

import numpy as np
from pyspark.sql import functions as F

from ledgerscope.operators import explain as EX
from ledgerscope.operators import features as FE
from ledgerscope.operators import history as H
from ledgerscope.operators import splits as S
from ledgerscope.operators import train as TR
from ledgerscope.session import ensure_checkpoint_dir
from ledgerscope.sources import artifacts as A
from ledgerscope.sources.ledger import LEDGER_SCHEMA, events_ledger, read_ledger_csv
from ledgerscope.streaming import jobs as SJ


def _universe(spark, sf_dir):
    feats = FE.transaction_features(events_ledger(spark, "/root/testdata/sf0.01"))[0]
    return S.with_split(S.modelling_universe(feats)).where(F.col("split").isNotNull()).cache()


def test_contributions_sum_to_logit_and_model_roundtrip(spark, sf_dir):
    uni = _universe(spark, sf_dir)
    work = ensure_checkpoint_dir(spark)
    for name in ("gbt_depthwise", "logistic_regression"):
        m, _ = TR.fit(name, uni.where("split = 'train'"), uni.where("split = 'val'"))
        path = os.path.join(work, f"model-{uuid.uuid4().hex}")
        A.save_model(m, path)
        m2 = A.load_model(path)
        sc = TR.score(m2, uni.where("split = 'test'")).limit(200)
        out, base = EX.contributions(spark, name, m2, sc, work)
        pdf = out.toPandas()
        total = pdf[[f"c_{f}" for f in TR.FEATURES]].to_numpy().sum(axis=1) + base
        logit = np.log(pdf.pred_prob / (1 - pdf.pred_prob))
        assert np.max(np.abs(total - logit)) < 1e-9, name


def test_gt_columns_are_never_features():
    assert not [f for f in TR.FEATURES if f.startswith("gt_")]


def test_stream_history_over_several_batches_equals_batch(spark, sf_dir):
    led = events_ledger(spark, sf_dir).select("event_id", "step", "nameDest", "nameOrig", "amount")
    base = os.path.join(ensure_checkpoint_dir(spark), f"st-{uuid.uuid4().hex}")
    src = os.path.join(base, "src")
    for lo in range(0, 721, 120):             # one file per 5 days, written in time order
        led.where((F.col("step") > lo) & (F.col("step") <= lo + 120)).coalesce(1).write.mode("append").parquet(src)
    out = SJ.stream_dest_history(spark, src, led.schema, os.path.join(base, "sink"), os.path.join(base, "ck"),
                                 max_files_per_trigger=1)
    cols = ["event_id", "hist_dest_txn_count", "hist_dest_unique_origin_count",
            F.round("hist_dest_total_amount", 6).alias("total"), "hist_dest_max_amount"]
    a = out.select(*cols)
    b = H.prior_history(led).select(*cols)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0
    assert spark.read.parquet(os.path.join(base, "sink")).select("batch_id").distinct().count() > 1


def test_csv_source_uses_explicit_schema(spark):
    path = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    os.makedirs(path.replace("file:", ""), exist_ok=True)
    with open(os.path.join(path.replace("file:", ""), "a.csv"), "w") as f:
        f.write(",".join(c.name for c in LEDGER_SCHEMA.fields) + "\n")
        f.write("1,PAYMENT,9839.64,C1231006815,170136.0,160296.36,M1979787155,0.0,0.0,0,0\n")
    df = read_ledger_csv(spark, path)
    assert df.schema == LEDGER_SCHEMA and df.first().amount == 9839.64


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0 and "hist_avg_txn_count_same_hour" in out.columns
    assert set(E.oracle_sql()) <= set(E.queries())
