"""Leaf-wise gradient boosting by distributed histograms (M8), with patience (M9's
stopping rule): logistic loss, best leaf first, up to ``max_leaves`` leaves.

Rows are binned once (borders: quantiles over all rows) and kept as one byte a
feature, in records of a block of rows. To grow a tree only histograms travel: per leaf, feature and bin the
sums of gradients and hessians and the row count, added up on the executors, at
most ``AHEAD`` leaves x features x bins numbers a partition; past ``FOLD``
partitions one small aggregate folds them before they come to the driver. Of two siblings the smaller one is summed, the other is
its parent less that. Gradients are rounded to multiples of 2^-20, so the sums
are whole numbers: they do not depend on the order of rows or partitions, and
subtraction is exact.

A split changes nothing about other leaves, so one pass also gets the children
of the ``AHEAD`` most promising leaves ahead of their turn. The order of splits
is exactly best leaf first; what was fetched ahead and never had its turn is left
out. A pass follows rows only as far as they go towards the leaves that are asked
for. A leaf of up to ``SMALL`` rows needs no more passes: its rows go to one task,
which grows all that could be split below it; from there the driver takes splits in
their turn, so the tree is the same. After every round the rows are written to the
shared folder with what the new tree adds, so no pass goes through earlier trees
again; every ``KEEP_EVERY`` rounds that sum goes into the margin. The table before
is deleted then, so a fit holds two of them however many rounds it has.

Stopping: after each such stretch the validation rows are scored at every round
of it, and one keyed curve over (round, score) gives all their average
precisions. Training ends ``patience`` rounds after the best one, which is kept.
"""
from __future__ import annotations

import math
import uuid
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from . import metrics as M

AHEAD = 16
KEEP_EVERY = 8
#: Partitions whose sums the driver adds up itself, which saves a shuffle in every pass.
FOLD = 64
#: Rows of a leaf that one task grows to its end.
SMALL = 1 << 18
GRAIN = float(1 << 20)


class Tree:
    """Arrays by node: feature (-1: leaf), code (rows with a code up to it go left), left, right, value, gain, n."""

    def __init__(self):
        self.feature, self.code, self.left, self.right, self.value, self.gain, self.n = [], [], [], [], [], [], []

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.code, 0), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0), (self.n, 0)):
            column.append(empty)
        return len(self.feature) - 1

    def node_of(self, codes: np.ndarray, towards: list[int] | None = None) -> np.ndarray:
        """The leaf of each row; with ``towards`` the first node from which none of these is reached."""
        feature, code, left, right = (np.array(c) for c in (self.feature, self.code, self.left, self.right))
        if towards is not None:
            on_way = np.zeros(len(feature), bool)
            on_way[towards] = True
            for x in range(len(feature) - 1, -1, -1):       # children come after their parent
                on_way[x] |= feature[x] >= 0 and (on_way[left[x]] or on_way[right[x]])
            feature = np.where(on_way, feature, -1)
        at = np.zeros(len(codes), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            f = feature[at[inner]]
            goes = codes[inner, f] <= code[at[inner]]
            at[inner] = np.where(goes, left[at[inner]], right[at[inner]])
            inner = inner[feature[at[inner]] >= 0]
        return at

    def margin(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(codes)]


def best_split(g, h, n, min_rows: int, min_hessian: float):
    """(gain, feature, code) of a leaf's histograms [feature, bin], or None. The
    first feature and the lowest code win ties."""
    gl, hl, nl = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
    gt, ht, nt = g[0].sum(), h[0].sum(), n[0].sum()
    gr, hr, nr = gt - gl, ht - hl, nt - nl
    ok = (nl >= min_rows) & (nr >= min_rows) & (hl >= min_hessian * GRAIN) & (hr >= min_hessian * GRAIN)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (gl * gl / hl + gr * gr / hr - gt * gt / ht) / GRAIN, -np.inf)
    at = int(np.argmax(gain))
    f, code = divmod(at, gain.shape[1])
    return (float(gain[f, code]), f, code) if gain[f, code] > 1e-12 else None


def grow(histograms, max_leaves: int, min_rows: int, min_hessian: float, ahead: int = AHEAD) -> Tree:
    """One tree. ``histograms(tree, nodes)`` gives {node: (g, h, n)} for leaves of
    the tree as it is passed. If it has ``subtrees``, ``subtrees(tree, nodes, leaves)``
    gives {node: tree below it with up to so many leaves}, asked for leaves of up to
    ``SMALL`` rows."""
    tree = Tree()
    root = tree.add()
    subtrees = getattr(histograms, "subtrees", None)
    known, split, below = {}, {}, {}
    leaves = [root]

    def learn(node, sums):
        g, h, n = known[node] = sums
        tree.value[node], tree.n[node] = -float(g[0].sum()) / max(float(h[0].sum()), 1.0), int(n[0].sum())
        split[node] = best_split(*sums, min_rows, min_hessian)

    def open_up(node):
        """Children of a node along its best split; returns (smaller, larger)."""
        gain, f, code = split[node]
        tree.feature[node], tree.code[node], tree.gain[node] = f, code, gain
        tree.left[node], tree.right[node] = tree.add(), tree.add()
        n_left = known[node][2][f, :code + 1].sum() if node in known else 0
        pair = tree.left[node], tree.right[node]
        return pair if 2 * n_left <= tree.n[node] else pair[::-1]

    def learn_below(node, grown, at):
        below[node] = grown, at
        tree.value[node], tree.n[node] = grown.value[at], grown.n[at]
        split[node] = (grown.gain[at], grown.feature[at], grown.code[at]) if grown.feature[at] >= 0 else None

    learn(root, histograms(tree, [root])[root])
    while len(leaves) < max_leaves:
        able = [x for x in leaves if split[x]]
        if not able:
            break
        best = max(able, key=lambda x: (split[x][0], -leaves.index(x)))
        if tree.feature[best] < 0 and best not in below:            # its children are not known yet
            one_task = {x for x in able if subtrees and tree.n[x] <= SMALL}
            todo = sorted((x for x in able if tree.feature[x] < 0 and x not in below and (x in one_task) == (best in one_task)),
                          key=lambda x: -split[x][0])[:min(ahead, max_leaves - len(leaves))]
            if best in one_task:
                for x, grown in subtrees(tree, todo, max_leaves - len(leaves) + 1).items():
                    learn_below(x, grown, 0)
            else:
                pairs = {x: open_up(x) for x in todo}
                got = histograms(tree, [small for small, _ in pairs.values()])
                for x, (small, large) in pairs.items():
                    learn(small, got[small])
                    learn(large, tuple(a - b for a, b in zip(known[x], got[small])))
        if best in below:
            grown, at = below[best]
            open_up(best)
            learn_below(tree.left[best], grown, grown.left[at])
            learn_below(tree.right[best], grown, grown.right[at])
        at = leaves.index(best)
        leaves[at:at + 1] = [tree.left[best], tree.right[best]]
    for x in leaves:                            # what was opened ahead of its turn is a leaf again
        tree.feature[x], tree.gain[x] = -1, 0.0
    return tree


def rows_histograms(codes: np.ndarray, g: np.ndarray, h: np.ndarray, n_bins: int):
    """The ``histograms`` function of ``grow`` over rows at hand."""
    rows_of = {0: np.arange(len(codes))}

    def ask(tree: Tree, nodes: list[int]):
        out = {}
        for node in nodes:
            if node not in rows_of:
                up = next(x for x in range(node) if node in (tree.left[x], tree.right[x]))
                mine = rows_of.pop(up)
                goes = codes[mine, tree.feature[up]] <= tree.code[up]
                rows_of[tree.left[up]], rows_of[tree.right[up]] = mine[goes], mine[~goes]
            out[node] = tuple(x[0] for x in _sums(codes[rows_of[node]], g[rows_of[node]], h[rows_of[node]], np.zeros(len(rows_of[node]), np.int64), 1, n_bins))
        return out
    return ask


def _sums(codes, g, h, slot, n_slots: int, n_bins: int) -> np.ndarray:
    """Sums of g, h and rows by slot, feature and bin."""
    sums = np.zeros((3, n_slots, codes.shape[1], n_bins))
    for f in range(codes.shape[1]):
        cell = slot * n_bins + codes[:, f]
        for k, x in enumerate((g, h, None)):
            sums[k, :, f] = np.bincount(cell, x, n_slots * n_bins).reshape(n_slots, n_bins)
    return sums


class LeafwiseModel:
    def __init__(self, features, borders, base, rate, trees):
        self.features, self.borders, self.base, self.rate, self.trees = features, borders, base, rate, trees

    def codes(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.stack([np.searchsorted(b, pdf[f].to_numpy(float), side="left") for f, b in zip(self.features, self.borders)], axis=1).astype(np.uint8)

    def score(self, df: DataFrame, out: str = "pred_prob") -> DataFrame:
        """``df`` with the probability of the positive class."""
        model = df.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

        def run(batches):
            m = model.value
            for pdf in batches:
                codes = m.codes(pdf)
                yield pdf.assign(**{out: _probability(m.base + m.rate * sum((t.margin(codes) for t in m.trees), np.zeros(len(pdf))))})
        return df.mapInPandas(run, schema)

    def importances(self) -> list[tuple[str, float]]:
        """Share of the total gain by feature, descending."""
        gain = np.zeros(len(self.features))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0 and g > 0:
                    gain[f] += g
        return sorted(zip(self.features, (gain / max(gain.sum(), 1e-300)).tolist()), key=lambda x: -x[1])


def _probability(margin):
    return 1.0 / (1.0 + np.exp(-margin))


def quantised(margin, y, w):
    """Gradients and hessians of the logistic loss as whole multiples of the grain."""
    p = _probability(margin)
    return np.rint(w * (p - y) * GRAIN), np.rint(w * p * (1 - p) * GRAIN)


class _Table(NamedTuple):
    path: str
    rows: DataFrame


def _kept(df: DataFrame, name: str) -> _Table:
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return _Table(path, df.sparkSession.read.schema(df.schema).parquet(path))


def _drop(table: _Table) -> None:
    sc = table.rows.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(table.path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: A record is a block of rows, column by column: doubles, for codes a byte a feature.
#: ``since``: what the trees since the last stretch add, before the rate.
_BINNED = "y binary, w binary, codes binary, margin binary, since binary"


def _binned(df: DataFrame, model: LeafwiseModel, label: str, weight: str) -> _Table:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for pdf in batches:
            if len(pdf):
                columns = pdf["_y"].to_numpy(float), pdf["_w"].to_numpy(float), m.codes(pdf), np.full(len(pdf), m.base), np.zeros(len(pdf))
                yield pd.DataFrame({c: [x.tobytes()] for c, x in zip(("y", "w", "codes", "margin", "since"), columns)})
    rows = df.select(F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"), *model.features)
    return _kept(rows.mapInPandas(run, _BINNED), "binned")


def _blocks(batch: pa.RecordBatch, n_features: int):
    """(y, w, codes, margin, since) of each block of a batch."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("y", "w", "codes", "margin", "since")]
    for i in range(batch.num_rows):
        y, w, codes, margin, since = (np.frombuffer(c[i].as_buffer(), np.uint8 if k == 2 else float) for k, c in enumerate(columns))
        yield y, w, codes.reshape(-1, n_features), margin, since


def _asked(batches, tree: Tree, nodes: list[int], n_features: int, rate: float):
    """(codes, g, h, index into nodes) of the rows in these nodes, block by block."""
    slot_of = np.full(len(tree.feature), -1)
    slot_of[nodes] = np.arange(len(nodes))
    for batch in batches:
        for y, w, codes, margin, since in _blocks(batch, n_features):
            slot = slot_of[tree.node_of(codes, nodes)]
            mine = slot >= 0
            if mine.any():
                yield codes[mine], *quantised(margin[mine] + rate * since[mine], y[mine], w[mine]), slot[mine]


def _histograms(rows: DataFrame, model: LeafwiseModel, n_bins: int, min_rows: int, min_hessian: float):
    """The ``histograms`` function of ``grow`` over a binned table, with ``subtrees``."""
    nf, rate = len(model.features), model.rate
    many = rows.rdd.getNumPartitions() > FOLD

    def ask(tree: Tree, nodes: list[int]):
        shape = (len(nodes), nf, n_bins)

        def run(batches):
            sums = np.zeros((3, *shape))
            for codes, g, h, slot in _asked(batches, tree, nodes, nf, rate):
                sums += _sums(codes, g, h, slot, len(nodes), n_bins)
            cell = np.flatnonzero(sums[2])
            yield pa.RecordBatch.from_arrays([pa.array(cell), *[pa.array(s.ravel()[cell].astype(np.int64)) for s in sums]], ["cell", "g", "h", "n"])

        parts = rows.mapInArrow(run, "cell long, g long, h long, n long")
        if many:
            parts = parts.groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"])
        table = parts.toArrow()
        out = [np.zeros(shape) for _ in range(3)]
        for c, x in zip("ghn", out):
            np.add.at(x.ravel(), table.column("cell").to_numpy(), table.column(c).to_numpy())
        return {node: tuple(x[i] for x in out) for i, node in enumerate(nodes)}

    def subtrees(tree: Tree, nodes: list[int], leaves: int):
        def pick(batches):
            for codes, g, h, slot in _asked(batches, tree, nodes, nf, rate):
                for at in np.unique(slot):
                    mine = slot == at
                    yield pa.RecordBatch.from_pydict({"slot": [int(at)], "codes": [codes[mine].tobytes()], "g": [g[mine].tobytes()], "h": [h[mine].tobytes()]})

        def grown(key, table):
            codes, g, h = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("codes", np.uint8), ("g", float), ("h", float)))
            t = grow(rows_histograms(codes.reshape(-1, nf), g, h, n_bins), leaves, min_rows, min_hessian, 1)
            size = len(t.feature)
            return pa.table({"slot": np.full(size, key[0].as_py()), "node": np.arange(size), **{c: np.array(getattr(t, c)) for c in _TREE}})
        got = (rows.mapInArrow(pick, "slot long, codes binary, g binary, h binary").repartition(len(nodes), "slot")
               .groupBy("slot").applyInArrow(grown, "slot long, node long, " + ", ".join(f"{c} {t}" for c, t in _TREE.items())).toArrow())
        out = {x: Tree() for x in nodes}
        for r in got.sort_by([("slot", "ascending"), ("node", "ascending")]).to_pylist():
            for c in _TREE:
                getattr(out[nodes[r["slot"]]], c).append(r[c])
        return out
    ask.subtrees = subtrees
    return ask


_TREE = {"feature": "long", "code": "long", "left": "long", "right": "long", "value": "double", "gain": "double", "n": "long"}


def _with_margin(table: _Table, model: LeafwiseModel, recent: list[Tree], fold: bool = True) -> _Table:
    """The binned rows with the recent trees added to ``since``, and all that to the margin if folded, written; the table itself goes."""
    nf, rate = len(model.features), model.rate

    def run(batches):
        for batch in batches:
            new = {"margin": [], "since": []}
            for _, _, codes, margin, since in _blocks(batch, nf):
                since = sum((t.margin(codes) for t in recent), since)
                if fold:
                    margin, since = margin + rate * since, np.zeros(len(margin))
                new["margin"].append(margin.tobytes())
                new["since"].append(since.tobytes())
            for c, blocks in new.items():
                batch = batch.set_column(batch.schema.get_field_index(c), c, pa.array(blocks, pa.binary()))
            yield batch
    written = _kept(table.rows.mapInArrow(run, _BINNED), "margins")
    _drop(table)
    return written


def staged_ap(rows: DataFrame, model: LeafwiseModel, recent: list[Tree], first: int) -> dict[int, float]:
    """Average precision after each of the recent rounds, by one keyed curve."""
    nf, rate = len(model.features), model.rate

    def run(batches):
        for batch in batches:
            for y, _, codes, margin, _ in _blocks(batch, nf):
                for i, t in enumerate(recent):
                    margin = margin + rate * t.margin(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), first + i)), pa.array(y.astype(np.int32)), pa.array(_probability(margin))],
                                                     ["round", "y", "score"])
    scored = rows.mapInArrow(run, "round long, y int, score double")
    got = M.ranking_metrics(M.curve(scored, "y", "score", keys=["round"]), keys=["round"]).select("round", "pr_auc").collect()
    return {r["round"]: r["pr_auc"] if r["pr_auc"] is not None else -1.0 for r in got}


def fit(train: DataFrame, val: DataFrame, features: list[str], label: str = "isFraud", weight: str = "weight", rounds: int = 500,
        rate: float = 0.05, max_leaves: int = 63, min_rows: int = 20, min_hessian: float = 1e-3, max_bins: int = 64,
        patience: int = 30) -> tuple[LeafwiseModel, list[float]]:
    """(model cut at its best round, validation average precision by round).
    ``val`` needs no weight; an empty one gives -1 each round and no tree but the first."""
    probs = [i / max_bins for i in range(1, max_bins)]
    borders = [np.unique(np.array(q, float)) for q in train.approxQuantile(features, probs, 1 / (4 * max_bins))]
    s = train.agg(F.sum(F.col(weight).cast("double")).alias("w"), F.sum(F.col(weight) * F.col(label)).alias("p")).first()
    share = min(max((s["p"] or 0.0) / (s["w"] or 1.0), 1e-6), 1 - 1e-6)
    model = LeafwiseModel(list(features), borders, math.log(share / (1 - share)), rate, [])
    rows = _binned(train, model, label, weight)
    held = _binned(val.withColumn(weight, F.lit(1.0)), model, label, weight)
    curve, best = [], 0
    try:
        while len(model.trees) < rounds:
            recent: list[Tree] = []
            stretch = min(KEEP_EVERY, rounds - len(model.trees))
            while len(recent) < stretch:
                recent.append(grow(_histograms(rows.rows, model, max_bins, min_rows, min_hessian), max_leaves, min_rows, min_hessian))
                if len(model.trees) + len(recent) < rounds:
                    rows = _with_margin(rows, model, recent[-1:], fold=len(recent) == stretch)
            got = staged_ap(held.rows, model, recent, len(curve))
            for r in range(len(curve), len(curve) + len(recent)):
                curve.append(got.get(r, -1.0))
                if curve[r] > curve[best]:
                    best = r
                if r - best >= patience:
                    model.trees = (model.trees + recent)[:best + 1]
                    return model, curve
            if len(model.trees) + stretch < rounds:
                held = _with_margin(held, model, recent)
            model.trees += recent
        model.trees = model.trees[:best + 1]
        return model, curve
    finally:
        _drop(rows)
        _drop(held)
