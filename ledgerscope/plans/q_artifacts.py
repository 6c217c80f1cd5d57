"""S5, S7-S9 queries: published versions of model, predictions and report, and
point lookups in the ledger."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import splits as S
from ..operators import train as TR
from ..session import ensure_checkpoint_dir
from ..sources import lookup as LK
from ..sources import published as PB
from .catalog import _LEDGERS, features_table, ledger, register
from .q_decide import DC_CTES
from .q_features import with_features
from .q_metrics import M_CTE
from .q_spikes import EXT_CTES, extended_steps
from .sql import with_ledger
from ..operators import rootcause as RC

LOOKUP_COLUMNS = ["event_id", "step", "type", "amount", "nameOrig", "nameDest", "isFraud"]


def lookup_path(spark, sf_dir) -> str:
    """The ledger laid out for lookups by step and by destination, written once per session."""
    key = (spark.sparkContext.applicationId, "ledger-lookup", sf_dir)
    if key not in _LEDGERS:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger-lookup-{uuid.uuid4().hex}"
        LK.write_for_lookup(ledger(spark, sf_dir).select(*LOOKUP_COLUMNS), path, "step", then=("event_id",), bloom=("nameDest",))
        _LEDGERS[key] = path
    return _LEDGERS[key]


def spike_steps(spark, sf_dir):
    return extended_steps(spark, sf_dir).where("gt_fraud_spike = 1").select("step")


@register("step_lookup", with_features(EXT_CTES) + f"""
SELECT {", ".join(c if c != "amount" else "round(amount, 6) AS amount" for c in LOOKUP_COLUMNS)} FROM ledger
WHERE step IN (SELECT step FROM ext WHERE gt_fraud_spike = 1)""")
def step_lookup(spark, sf_dir):
    """The transactions of every ground-truth spike step, read by their row groups."""
    rows = LK.lookup(spark, lookup_path(spark, sf_dir), "step", spike_steps(spark, sf_dir))
    return rows.withColumn("amount", F.round("amount", 6))


@register("destination_lookup", with_features(EXT_CTES, DC_CTES) + """
SELECT nameDest, count(*) AS transactions, count(DISTINCT step) AS steps, round(sum(amount), 4) AS total_amount,
  cast(sum(isFraud) AS BIGINT) AS fraud FROM ledger
WHERE nameDest IN (SELECT top_destination FROM dc JOIN ext USING (step) WHERE gt_fraud_spike = 1) GROUP BY nameDest""")
def destination_lookup(spark, sf_dir):
    """S9 by another column: all transactions of the busiest destination of each
    spike step; its row groups are found by bloom filters."""
    path = lookup_path(spark, sf_dir)
    top = RC.destination_concentration(LK.lookup(spark, path, "step", spike_steps(spark, sf_dir)))
    rows = LK.lookup(spark, path, "nameDest", top.select(F.col("top_destination").alias("nameDest")))
    return rows.groupBy("nameDest").agg(
        F.count(F.lit(1)).alias("transactions"), F.countDistinct("step").alias("steps"), F.round(F.sum("amount"), 4).alias("total_amount"),
        F.sum(F.col("isFraud").cast("long")).alias("fraud"))


_PUBLISHED: dict = {}


def published(spark, sf_dir) -> str:
    """Folder of the published versions: the logistic model, its held-out
    predictions, metrics and metadata, published once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PUBLISHED:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/published-{uuid.uuid4().hex}"
        uni = S.with_split(S.modelling_universe(features_table(spark, sf_dir)))
        TR.check_features(uni)
        name = "logistic_regression"
        model, seconds = TR.fit(name, uni.where("split = 'train'"), uni.where("split = 'val'"))
        scored = TR.score(model, uni.where("split IN ('val', 'test')")).select("event_id", "step", "split", TR.LABEL, "pred_prob")
        PB.publish(spark, root, model, scored, M.evaluate(scored, 0.5, score="pred_prob", keys=["split"]),
                   {"model": name, "features": TR.FEATURES, "label": TR.LABEL, "threshold": 0.5, "train_seconds": round(seconds, 2)})
        _PUBLISHED[key] = root
    return _PUBLISHED[key]


@register("published_predictions", with_ledger(M_CTE) + """
SELECT split, count(*) AS rows, cast(sum(isFraud) AS BIGINT) AS fraud_rows, count(*) AS same_scores, count(*) AS n_samples,
  true AS metrics_in_report, 'logistic_regression' AS model, 1 AS version
FROM m WHERE split IN ('val', 'test') GROUP BY split""")
def published_predictions(spark, sf_dir):
    """What a reader finds in the last complete version: its
    predictions, how many of them its reloaded model gives again on the features
    that its metadata names, and the report's row of the split."""
    v = PB.latest(spark, published(spark, sf_dir))
    label, features = v.meta["label"], v.meta["features"]
    held_out = S.with_split(S.modelling_universe(features_table(spark, sf_dir))).where("split IN ('val', 'test')")
    TR.check_features(held_out, features)
    again = TR.score(v.model(), held_out.select("event_id", *features)).select("event_id", F.col("pred_prob").alias("again"))
    per = (v.predictions(spark).join(again, "event_id", "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(label).cast("long")).alias("fraud_rows"),
        F.count_if(F.col("pred_prob") == F.col("again")).alias("same_scores")))
    report = v.report(spark).select("split", "n_samples", (F.col("pr_auc").between(0, 1) & F.col("roc_auc").between(0, 1)).alias("metrics_in_report"))
    return per.join(report, "split", "left").select("*", F.lit(v.meta["model"]).alias("model"), F.lit(v.number).alias("version"))
