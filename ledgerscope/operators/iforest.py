"""Isolation forest as a Spark job (T4).

Spark ML has no isolation forest. Training rows are tagged with a tree id and
each tree keeps its ``min(max_samples, n)`` lowest seeded hashes (a sample
without replacement per tree); ``groupBy(tree).applyInPandas`` grows each tree
on an executor into node rows (tree, node, feature, threshold, left, right,
size, depth). The node table has at most trees x (2 * max_samples - 1) rows,
so scoring broadcasts it to ``mapInPandas``, which walks all trees for a whole
Arrow batch at once.

Score s = 2 ** (-E[h(x)] / c(psi)); a row is anomalous when s > 0.5 and the
reported score is s - 0.5 (higher = more anomalous). The random stream is our
own, so results are checked by properties, not against another library.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()), T.StructField("depth", T.IntegerType()),
])


def avg_path_length(n):
    """c(n): average path length of an unsuccessful search in a BST of n nodes."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    two = n == 2
    big = n > 2
    out[two] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree as parallel node lists (leaf: feature = -1)."""
    feats, thr, left, right, size, depth = [], [], [], [], [], []

    def new(n, d):
        feats.append(-1); thr.append(0.0); left.append(-1); right.append(-1); size.append(n); depth.append(d)
        return len(feats) - 1

    stack = [(np.arange(len(x)), new(len(x), 0), 0)]
    while stack:
        idx, node, d = stack.pop()
        if d >= max_depth or len(idx) <= 1:
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] <= t
        li, ri = idx[go_left], idx[~go_left]
        ln, rn = new(len(li), d + 1), new(len(ri), d + 1)
        feats[node], thr[node], left[node], right[node] = f, t, ln, rn
        stack.append((li, ln, d + 1))
        stack.append((ri, rn, d + 1))
    return feats, thr, left, right, size, depth


class IsolationForestJob:
    def __init__(self, features: list[str], n_trees: int = 200, max_samples: int = 256,
                 seed: int = 42, fill: float = 1.0, id_col: str = "step"):
        self.features, self.n_trees, self.max_samples = list(features), n_trees, max_samples
        self.seed, self.fill, self.id_col = seed, fill, id_col
        self.psi = None

    def _x(self, df: DataFrame) -> DataFrame:
        return df.select(self.id_col, *[F.coalesce(F.col(f).cast("double"), F.lit(self.fill)).alias(f"_f{i}")
                                        for i, f in enumerate(self.features)])

    def fit(self, df: DataFrame) -> DataFrame:
        """Grow the trees on executors; returns the node table."""
        x = self._x(df)
        n = x.count()
        psi = min(self.max_samples, n)
        self.psi = psi
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        # Each tree keeps the psi rows with the lowest seeded hash. A row's
        # copies for all trees are hashed in the scan stage and only those
        # under a hash cut-off (expected ~4 psi per tree) leave it, so no tree's
        # window holds the whole input. If a tree still gets fewer than psi
        # candidates (vanishingly rare) the fit is redone without a cut-off.
        frac = min(1.0, 4.0 * psi / max(n, 1))
        nodes = self._fit_sample(x, psi, max_depth, frac)
        if frac < 1.0:
            short = nodes.where(F.col("node") == 0).agg(F.min("size"), F.count(F.lit(1))).first()
            if short[1] < self.n_trees or short[0] < psi:
                nodes = self._fit_sample(x, psi, max_depth, 1.0)
        return nodes

    def _fit_sample(self, x: DataFrame, psi: int, max_depth: int, frac: float) -> DataFrame:
        h = F.xxhash64(F.lit(self.seed), "tree", self.id_col)
        tagged = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.n_trees - 1))).alias("tree"))
        if frac < 1.0:
            # signed 64-bit hashes: keep the lowest ``frac`` share of the hash range
            cut = min(int(-2 ** 63 + frac * 2 ** 64), 2 ** 63 - 1)
            tagged = tagged.where(h < F.lit(cut))
        # Growing a tree is CPU work on little data: with a size-based plan
        # AQE would coalesce all trees into one task. An explicit partition
        # count (kept by AQE) spreads the trees over up to n_trees tasks; the
        # window and the grouped map below reuse this partitioning.
        tagged = tagged.repartition(self.n_trees, "tree")
        w = Window.partitionBy("tree").orderBy(h, self.id_col)
        sample = tagged.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r")
        nf, seed = len(self.features), self.seed

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            pdf = pdf.sort_values(self.id_col)
            xs = pdf[[f"_f{i}" for i in range(nf)]].to_numpy(dtype=float)
            rng = np.random.default_rng([seed, tree])
            fe, th, le, ri, si, de = _grow(xs, rng, max_depth)
            return pd.DataFrame({"tree": tree, "node": np.arange(len(fe), dtype=np.int32), "feature": fe,
                                 "threshold": th, "left": le, "right": ri, "size": si, "depth": de})

        nodes = sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA)
        return nodes.checkpoint()

    def transform(self, df: DataFrame, nodes: DataFrame, score_col: str = "iso_method_score",
                  pred_col: str = "iso_method_pred") -> DataFrame:
        """Score every row; the node table is bounded (trees x (2 psi - 1))."""
        pdf = nodes.toPandas().sort_values(["tree", "node"])
        trees = []
        for _, g in pdf.groupby("tree"):
            trees.append(tuple(g[c].to_numpy() for c in ["feature", "threshold", "left", "right", "size", "depth"]))
        c_psi = float(avg_path_length([self.psi or self.max_samples])[0])
        feats = self.features
        bc = df.sparkSession.sparkContext.broadcast(trees)
        fill = self.fill
        schema = T.StructType(df.schema.fields + [T.StructField(score_col, T.DoubleType()),
                                                  T.StructField(pred_col, T.IntegerType())])

        def score(batches):
            forest = bc.value
            for b in batches:
                xs = b[feats].astype(float).fillna(fill).to_numpy()
                h = np.zeros(len(b))
                for fe, th, le, ri, si, de in forest:
                    node = np.zeros(len(b), dtype=np.int64)
                    active = fe[node] >= 0
                    while active.any():
                        f = fe[node[active]]
                        go_left = xs[active, f] <= th[node[active]]
                        node[active] = np.where(go_left, le[node[active]], ri[node[active]])
                        active = fe[node] >= 0
                    h += de[node] + avg_path_length(si[node])
                s = np.power(2.0, -(h / len(forest)) / c_psi) if c_psi > 0 else np.full(len(b), 0.5)
                yield b.assign(**{score_col: s - 0.5, pred_col: (s > 0.5).astype(np.int32)})

        return df.mapInPandas(score, schema)
