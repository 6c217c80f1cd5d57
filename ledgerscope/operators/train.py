"""Classifier training on Spark ML.

Three models, as in the reference's comparison:
* ``logistic_regression``: StandardScaler(mean, std) + LogisticRegression with
  balanced class weights; sklearn's L2 with C=1 on a summed loss equals
  ``regParam = 1 / sum(weights)`` on Spark's weight-averaged loss.
* ``gbt_leafwise`` and ``gbt_depthwise``: two GBTClassifier profiles (learning
  rate 0.05, depth 6) with positives weighted n_neg/n_pos from TRAIN only,
  early-stopped on the validation split through ``validationIndicatorCol``
  (Spark stops at the first round that fails to improve; no patience).
Selection: highest validation PR-AUC, first wins ties.
"""
from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics as M

# The 23 model features, in order.
FEATURES = [
    "amount", "log_amount",
    "balance_change_orig", "balance_error_orig", "drained_to_zero",
    "origin_balance_zero_before", "amount_to_origin_balance_ratio",
    "balance_change_dest", "balance_error_dest", "dest_balance_artifact_flag",
    "hour_of_day", "hour_sin", "hour_cos",
    "is_transfer",
    "hist_dest_txn_count", "hist_dest_unique_origin_count",
    "hist_dest_total_amount", "hist_dest_avg_amount", "hist_dest_max_amount",
    "destination_is_new",
    "amount_to_dest_avg_ratio", "amount_to_type_avg_ratio",
    "high_amount_indicator",
]
LABEL = "isFraud"
SEED = 42
MODEL_NAMES = ["logistic_regression", "gbt_leafwise", "gbt_depthwise"]


def check_features(df: DataFrame, features: list[str] = FEATURES) -> None:
    """Every feature must exist before assembling."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"required feature(s) could not be generated: {missing}")


def assembler(features: list[str] = FEATURES) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")


def with_weights(train: DataFrame, scheme: str) -> DataFrame:
    """M1: class weights from the training rows only.
    balanced: w_c = n / (2 n_c); pos_ratio: positives n_neg / n_pos, negatives 1."""
    r = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("long")).alias("p")).first()
    n, p = r["n"], r["p"] or 0
    if p == 0 or p == n:
        return train.withColumn("weight", F.lit(1.0))
    if scheme == "balanced":
        wp, wn = n / (2.0 * p), n / (2.0 * (n - p))
    else:
        wp, wn = (n - p) / p, 1.0
    return train.withColumn("weight", F.when(F.col(LABEL) == 1, F.lit(wp)).otherwise(F.lit(wn)))


def logistic_pipeline(n_rows: int, features=FEATURES) -> Pipeline:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    lr = LogisticRegression(featuresCol="scaled", labelCol=LABEL, weightCol="weight", maxIter=2000,
                            regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False,
                            tol=1e-4)
    return Pipeline(stages=[assembler(features), scaler, lr])


def gbt_pipeline(profile: str, features=FEATURES, max_iter: int = 500) -> Pipeline:
    common = dict(featuresCol="features", labelCol=LABEL, weightCol="weight", stepSize=0.05, maxIter=max_iter,
                  maxDepth=6, seed=SEED, validationIndicatorCol="is_val", validationTol=0.001,
                  lossType="logistic", maxBins=64)
    # M8 / M9: two boosted-tree profiles (no external boosters are installed)
    if profile == "gbt_leafwise":
        gbt = GBTClassifier(minInstancesPerNode=20, **common)
    else:
        gbt = GBTClassifier(minInstancesPerNode=1, **common)
    return Pipeline(stages=[assembler(features), gbt])


def fit(name: str, train: DataFrame, val: DataFrame, features=FEATURES) -> tuple[PipelineModel, float]:
    """Fit one model; returns (model, seconds)."""
    t0 = time.time()
    if name == "logistic_regression":
        tr = with_weights(train, "balanced").select(*features, LABEL, "weight").cache()
        n = tr.count()
        model = logistic_pipeline(n, features).fit(tr)
        tr.unpersist()
    else:
        tr = with_weights(train, "pos_ratio")
        wp = tr.where(F.col(LABEL) == 1).select("weight").first()
        wpos = wp["weight"] if wp else 1.0
        va = val.withColumn("weight", F.when(F.col(LABEL) == 1, F.lit(wpos)).otherwise(F.lit(1.0)))
        both = (tr.withColumn("is_val", F.lit(False)).unionByName(va.withColumn("is_val", F.lit(True)))
                .select(*features, LABEL, "weight", "is_val").cache())
        model = gbt_pipeline(name, features).fit(both)
        both.unpersist()
    return model, time.time() - t0


def score(model: PipelineModel, df: DataFrame, out: str = "pred_prob") -> DataFrame:
    """Probability of the positive class as a double column."""
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability").getItem(1)).drop(
        "features", "scaled", "rawPrediction", "probability", "prediction")


def importances(name: str, model: PipelineModel, features=FEATURES) -> list[tuple[str, float]]:
    """Built-in importances (tree: Spark's normalised gain; linear: |coef|),
    descending (K6)."""
    last = model.stages[-1]
    vals = (last.featureImportances.toArray() if name != "logistic_regression"
            else [abs(c) for c in last.coefficients.toArray()])
    return sorted(zip(features, [float(v) for v in vals]), key=lambda t: -t[1])


class ModelRun:
    """Train the three models on the split universe, evaluate on val and test,
    select by validation PR-AUC (M10)."""

    def __init__(self, universe: DataFrame, names: list[str] = MODEL_NAMES):
        self.universe = universe
        self.train = universe.where(F.col("split") == "train")
        self.val = universe.where(F.col("split") == "val")
        self.test = universe.where(F.col("split") == "test")
        self.names = names
        self.models, self.seconds, self.val_pr_auc = {}, {}, {}

    def fit_all(self):
        for n in self.names:
            self.models[n], self.seconds[n] = fit(n, self.train, self.val)
        # every model's validation PR-AUC from one keyed curve (key: model)
        scored = None
        for n in self.names:
            sc = score(self.models[n], self.val).select(F.lit(n).alias("model"), LABEL, "pred_prob")
            scored = sc if scored is None else scored.unionByName(sc)
        got = {r["model"]: r["pr_auc"] for r in
               M.ranking_metrics(M.curve(scored, LABEL, "pred_prob", keys=["model"]), keys=["model"]).collect()}
        for n in self.names:                     # one row per model
            self.val_pr_auc[n] = got.get(n) if got.get(n) is not None else -1.0
        return self

    @property
    def selected(self) -> str:
        best = None
        for n in self.names:                     # first wins ties
            if best is None or self.val_pr_auc[n] > self.val_pr_auc[best]:
                best = n
        return best
