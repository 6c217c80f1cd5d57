"""Per-row feature contributions (E1) in log-odds space.

* Linear model: contribution_j = coef_j * (x_j - mean_j) / std_j, pure column
  expressions (exact Shapley values for a linear model with the training mean
  as background).
* Gradient-boosted trees: exact path-dependent TreeSHAP. For one leaf L with
  the distinct path features U (k of them), the tree's conditional expectation
  restricted to L is v_L * prod_j (j in S ? o_j : z_j), where z_j is the
  product of cover ratios and o_j whether x satisfies every split on j along
  the path. Its Shapley vector depends on x only through the k bits o_j, so
  it is precomputed for all 2^k patterns (k <= depth). Scoring a batch is then
  k comparisons and one table lookup per leaf, vectorised in ``mapInPandas``.
  The tables are bounded by the model (trees x leaves x 2^depth x depth).
Spark's GBT probability is 1 / (1 + exp(-2 margin)), so tree contributions
are doubled to read as log-odds.
"""
from __future__ import annotations

import math
import os
import uuid
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .train import FEATURES


def linear_contributions(model: PipelineModel, features: list[str] = FEATURES) -> list[Column]:
    """One Column per feature: coef * standardised value."""
    scaler = model.stages[1]
    lr = model.stages[-1]
    mean = scaler.mean.toArray()
    std = scaler.std.toArray()
    coef = lr.coefficients.toArray()
    cols = []
    for j, f in enumerate(features):
        s = std[j] if std[j] > 0 else 1.0
        cols.append((F.lit(float(coef[j])) * (F.col(f).cast("double") - F.lit(float(mean[j]))) / F.lit(float(s))))
    return cols


def linear_base_value(model: PipelineModel) -> float:
    return float(model.stages[-1].intercept)


# ----------------------------------------------------------------- trees
def _tree_nodes(spark: SparkSession, gbt_model, work_dir: str) -> tuple[pd.DataFrame, np.ndarray]:
    """Node table of a fitted GBT via its saved (public MLWriter) layout."""
    path = os.path.join(work_dir, f"gbt-{uuid.uuid4().hex}")
    gbt_model.write().overwrite().save(path)
    data = spark.read.parquet(os.path.join(path, "data"))
    nodes = data.select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"),
        F.coalesce(F.try_element_at(F.col("nodeData.impurityStats"), F.lit(1)),
                   F.col("nodeData.rawCount").cast("double")).alias("cover")).toPandas()
    meta = spark.read.parquet(os.path.join(path, "treesMetadata"))
    cols = meta.columns   # (tree id, tree metadata json, weight); named _1.._3 by the writer
    tid, wcol = ("treeID", "weights") if "treeID" in cols else (cols[0], cols[2])
    meta = meta.select(F.col(tid).alias("treeID"), F.col(wcol).alias("weight")).toPandas()
    weights = meta.sort_values("treeID")["weight"].to_numpy(dtype=float)
    return nodes, weights


def _leaf_paths(tree: pd.DataFrame):
    """Yield (leaf value, [(feature, threshold, went_left, z)], cover ratio) per leaf."""
    by_id = {int(r.id): r for r in tree.itertuples()}
    ids = set(by_id)
    children = {int(c) for r in tree.itertuples() for c in (r.left, r.right) if c >= 0}
    root = (ids - children).pop()
    out = []
    stack = [(root, [])]
    while stack:
        nid, path = stack.pop()
        r = by_id[nid]
        if r.left < 0:
            out.append((float(r.value), path))
            continue
        cov = float(r.cover) if r.cover and r.cover > 0 else 1.0
        for child, is_left in ((int(r.left), True), (int(r.right), False)):
            z = float(by_id[child].cover) / cov if cov else 0.5
            stack.append((child, path + [(int(r.feature), float(r.threshold), is_left, z)]))
    return out


def _shapley_table(k: int, z: np.ndarray, v: float) -> np.ndarray:
    """phi[pattern, i] for v * prod_j (j in S ? o_j : z_j), o given by pattern bits."""
    n_pat = 1 << k
    pats = np.arange(n_pat)
    o = ((pats[:, None] >> np.arange(k)[None, :]) & 1).astype(float)          # (P, k)
    masks = np.arange(n_pat)
    in_s = ((masks[:, None] >> np.arange(k)[None, :]) & 1).astype(bool)       # (S, k)
    # G[p, s] = prod_j (in_s[s, j] ? o[p, j] : z[j])
    g = np.ones((n_pat, n_pat))
    for j in range(k):
        g *= np.where(in_s[None, :, j], o[:, j][:, None], z[j])
    size = in_s.sum(axis=1)
    phi = np.zeros((n_pat, k))
    for i in range(k):
        without = masks[~in_s[:, i]]
        w = np.array([math.factorial(int(s)) * math.factorial(k - int(s) - 1) / math.factorial(k)
                      for s in size[without]])
        phi[:, i] = v * ((g[:, without | (1 << i)] - g[:, without]) * w[None, :]).sum(axis=1)
    return phi


def tree_tables(spark: SparkSession, gbt_model, work_dir: str):
    """Per leaf: path conditions, distinct features and the Shapley table;
    plus the base value (expected margin). Built once per model."""
    nodes, weights = _tree_nodes(spark, gbt_model, work_dir)
    leaves = []
    base = 0.0
    for t, tree in nodes.groupby("treeID"):
        w = float(weights[int(t)])
        for value, path in _leaf_paths(tree):
            feats = sorted({p[0] for p in path})
            zs = np.array([np.prod([p[3] for p in path if p[0] == f]) for f in feats])
            conds = [(feats.index(p[0]), p[0], p[1], p[2]) for p in path]
            base += w * value * float(np.prod(zs)) if feats else w * value
            table = _shapley_table(len(feats), zs, w * value) if feats else np.zeros((1, 0))
            leaves.append((np.array(feats, dtype=int), conds, table))
    return leaves, base


def tree_contributions(df: DataFrame, leaves, features: list[str] = FEATURES, prefix: str = "c_") -> DataFrame:
    """Append ``c_<feature>`` log-odds contributions (2 x margin Shapley values)."""
    bc = df.sparkSession.sparkContext.broadcast(leaves)
    schema = T.StructType(df.schema.fields + [T.StructField(prefix + f, T.DoubleType()) for f in features])
    nf = len(features)

    def run(batches):
        lv = bc.value
        for b in batches:
            x = b[features].astype(float).to_numpy()
            phi = np.zeros((len(b), nf))
            for feats, conds, table in lv:
                if len(feats) == 0:
                    continue
                ok = np.ones((len(b), len(feats)), dtype=bool)
                for slot, f, thr, is_left in conds:
                    side = x[:, f] <= thr
                    ok[:, slot] &= side if is_left else ~side
                pat = (ok * (1 << np.arange(len(feats)))[None, :]).sum(axis=1)
                phi[:, feats] += table[pat]
            yield b.assign(**{prefix + f: 2.0 * phi[:, j] for j, f in enumerate(features)})

    return df.mapInPandas(run, schema)


def contributions(spark: SparkSession, name: str, model: PipelineModel, df: DataFrame, work_dir: str,
                  features: list[str] = FEATURES, prefix: str = "c_"):
    """E1 for either model family; returns (df with c_<feature>, base value)."""
    if name == "logistic_regression":
        cols = linear_contributions(model, features)
        return df.select("*", *[c.alias(prefix + f) for c, f in zip(cols, features)]), linear_base_value(model)
    leaves, base = tree_tables(spark, model.stages[-1], work_dir)
    return tree_contributions(df, leaves, features, prefix), 2.0 * base


def contribution_array(features: list[str] = FEATURES, prefix: str = "c_") -> Column:
    """array<struct<feature, value, shap_value>> in feature order."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                              F.col(prefix + f).alias("shap_value")) for f in features])
