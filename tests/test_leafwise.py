"""Leaf-wise boosting: trees, margins and the best round against a plain fit."""
import numpy as np
import pytest

from ledgerscope.operators import leafwise as L

FEATURES = ["a", "b", "c"]


def table(n, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[:, 2] = np.round(x[:, 2])
    y = (rng.random(n) < 1 / (1 + np.exp(-(2 * x[:, 0] * (x[:, 1] > 0) - x[:, 2] - 1)))).astype(int)
    return x, y


def frame(spark, x, y, parts):
    rows = [(*map(float, r), int(t), float(1 + 2 * t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, isFraud int, weight double").repartition(parts)


def plain_tree(codes, margin, y, w, max_leaves, min_rows, bins):
    """Best leaf first, every candidate split of every leaf tried on the rows."""
    g, h = L.quantised(margin, y, w)

    def best(rows):
        out, (gt, ht) = None, (g[rows].sum(), h[rows].sum())
        for f in range(codes.shape[1]):
            for c in range(bins - 1):
                left = rows[codes[rows, f] <= c]
                right = rows[codes[rows, f] > c]
                if min(len(left), len(right)) < min_rows or min(h[left].sum(), h[right].sum()) < 1e-3 * L.GRAIN:
                    continue
                gain = (g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - gt * gt / ht) / L.GRAIN
                if gain > 1e-12 and (out is None or gain > out[0]):
                    out = gain, left, right
        return out
    leaves = [np.arange(len(y))]
    gains = []
    splits = [best(leaves[0])]
    while len(leaves) < max_leaves and any(splits):
        at = max((i for i, s in enumerate(splits) if s), key=lambda i: (splits[i][0], -i))
        gain, left, right = splits[at]
        gains.append(gain)
        leaves[at:at + 1] = [left, right]
        splits[at:at + 1] = [best(left), best(right)]
    value = np.zeros(len(y))
    for rows in leaves:
        value[rows] = -g[rows].sum() / h[rows].sum()
    return gains, value, len(leaves)


@pytest.mark.parametrize("ahead", [1, 5])
def test_trees_equal_a_plain_fit(spark, monkeypatch, ahead):
    monkeypatch.setattr(L, "AHEAD", ahead)
    x, y = table(400, 1)
    model, _ = L.fit(frame(spark, x, y, 3), frame(spark, x, y, 2), FEATURES, rounds=3, max_leaves=7, min_rows=5, max_bins=8, rate=0.3, patience=99)
    w = 1.0 + 2.0 * y
    codes = np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(model.borders)], axis=1)
    margin = np.full(len(y), np.log((w * y).sum() / (w * (1 - y)).sum()))
    assert model.base == pytest.approx(margin[0], abs=1e-12)
    for tree in model.trees:
        gains, value, n_leaves = plain_tree(codes, margin, y, w, 7, 5, 8)
        reached = [tree.gain[i] for i in _inner(tree)]
        assert sorted(reached) == pytest.approx(sorted(gains), rel=1e-12) and n_leaves == 7
        assert tree.margin(codes) == pytest.approx(value, rel=1e-12)
        margin = margin + 0.3 * value
    got = model.score(frame(spark, x, y, 2)).select("a", "b", "c", "pred_prob").toPandas()
    want = {tuple(r): p for r, p in zip(x.tolist(), 1 / (1 + np.exp(-margin)))}
    assert all(want[r.a, r.b, r.c] == pytest.approx(r.pred_prob, rel=1e-9) for r in got.itertuples())
    assert sum(v for _, v in model.importances()) == pytest.approx(1.0)


def _inner(tree):
    todo, out = [0], []
    while todo:
        i = todo.pop()
        if tree.feature[i] >= 0:
            out.append(i)
            todo += [tree.left[i], tree.right[i]]
    return out


def _ap(y, s):
    """Average precision with ties as one threshold."""
    out, p = 0.0, y.sum()
    for t in np.unique(s)[::-1]:
        at = s == t
        out += y[at].sum() / p * y[s >= t].mean()
    return out


def test_best_round_and_patience_equal_a_loop(spark):
    x, y = table(300, 2)
    xv, yv = table(200, 3)
    kw = dict(max_leaves=6, min_rows=5, max_bins=8, rate=0.5)
    full, curve = L.fit(frame(spark, x, y, 2), frame(spark, xv, yv, 2), FEATURES, rounds=12, patience=99, **kw)
    short, seen = L.fit(frame(spark, x, y, 2), frame(spark, xv, yv, 3), FEATURES, rounds=12, patience=3, **kw)
    # borders are approximate quantiles, so the training rows lie alike in both fits
    codes = np.stack([np.searchsorted(b, xv[:, i], side="left") for i, b in enumerate(full.borders)], axis=1)
    margin, best, aps = np.full(len(yv), full.base), 0, []
    trees = full.trees if len(full.trees) == 12 else None
    for r in range(len(full.trees)):
        margin = margin + 0.5 * full.trees[r].margin(codes)
        aps.append(_ap(yv, 1 / (1 + np.exp(-margin))))
    assert curve[:len(aps)] == pytest.approx(aps, abs=1e-9) and len(curve) == 12
    assert len(full.trees) == int(np.argmax(curve)) + 1 or trees
    for r, ap in enumerate(curve):
        best = r if ap > curve[best] else best
        if r - best >= 3:
            break
    assert seen == pytest.approx(curve[:len(seen)], abs=1e-9) and len(seen) == r + 1 and len(short.trees) == best + 1


def test_few_rows_and_one_class(spark):
    x, y = table(30, 4)
    model, curve = L.fit(frame(spark, x, y * 0, 1), frame(spark, x, y, 1).limit(0), FEATURES, rounds=2, max_bins=8)
    assert len(model.trees) == 1 and curve == [-1.0, -1.0]
    assert model.score(frame(spark, x, y, 1)).count() == 30


def test_passes_are_one_job_and_follow_rows_towards_the_asked_leaves(spark, monkeypatch):
    x, y = table(600, 7)
    df = frame(spark, x, y, 3)
    grow, passes = L.grow, []

    def counted(histograms, *args):
        def ask(tree, nodes):
            passes.append(len(nodes))
            return histograms(tree, nodes)
        return grow(ask, *args, ahead=1)
    monkeypatch.setattr(L, "grow", counted)
    spark.sparkContext.setJobGroup("leafwise-passes", "")
    try:
        model, _ = L.fit(df, df, FEATURES, rounds=4, max_leaves=20, min_rows=5, max_bins=8)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("leafwise-passes")
    assert len(passes) >= 60 and len(jobs) < len(passes) + 50
    tree = model.trees[0]
    codes = model.codes(df.toPandas())
    leaf = tree.node_of(codes)
    for asked in ([int(leaf[0])], [int(leaf[0]), int(leaf[-1])]):
        near = tree.node_of(codes, asked)
        assert (np.isin(leaf, asked) == np.isin(near, asked)).all() and (near <= leaf).all() and (near < leaf).any()


def _splits(tree):
    return [(tree.feature[i], tree.code[i], tree.gain[i], tree.n[i]) for i in _inner(tree)]


def test_leaves_grown_in_one_task_give_the_same_trees(spark, monkeypatch):
    x, y = table(900, 8)
    df = frame(spark, x, y, 4)
    trees = []
    for small in (0, 150, 1 << 18):
        monkeypatch.setattr(L, "SMALL", small)
        model, curve = L.fit(df, df, FEATURES, rounds=3, max_leaves=25, min_rows=5, max_bins=16, rate=0.4, patience=99)
        trees.append(([_splits(t) for t in model.trees], curve, [sorted(t.margin(model.codes(df.toPandas()))) for t in model.trees]))
    assert len(trees[0][0]) == 3 and all(len(t) == 24 for t in trees[0][0])
    assert trees[0] == trees[1] == trees[2]


def test_a_fit_leaves_no_tables_behind(spark):
    from pathlib import Path

    from ledgerscope.session import ensure_checkpoint_dir
    kept = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    x, y = table(200, 9)
    before = set(kept.iterdir())
    L.fit(frame(spark, x, y, 2), frame(spark, x, y, 2), FEATURES, rounds=10, max_leaves=4, max_bins=8)
    assert not [p.name for p in set(kept.iterdir()) - before if p.name.startswith(("binned", "margins"))]


@pytest.fixture(scope="module")
def boosted(spark):
    """The query module over rows of all splits whose label takes more than a few rounds to learn."""
    from ledgerscope.operators import train as TR
    from ledgerscope.plans import q_models as Q
    rng = np.random.default_rng(17)
    n = 450
    x = np.round(rng.normal(size=(n, len(TR.FEATURES))), 2)
    y = (x[:, :3].sum(axis=1) + rng.normal(size=n) > 1).astype(int)
    rows = [(int(s), "TRANSFER", int(t), *map(float, r)) for s, t, r in zip(np.repeat([100, 550, 700], n // 3), y, x)]
    schema = "step int, type string, isFraud int, " + ", ".join(f"{f} double" for f in TR.FEATURES)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Q, "features_table", lambda s, d: s.createDataFrame(rows, schema).coalesce(2))
        patch.setattr(Q, "_LEAFWISE", {})
        yield Q


def test_registered_queries_boost_until_the_patience_is_over(spark, boosted):
    rounds = boosted.leafwise_rounds(spark, "rows at hand").orderBy("round").collect()
    best = max(rounds, key=lambda r: (r.val_pr_auc, -r.round)).round
    assert [r.round for r in rounds if r.kept] == [best] and best > 8
    assert len(rounds) == 500 or (rounds[-1].patience_left == 0 and len(rounds) == best + 30)
    ev = {r.split: r for r in boosted.leafwise_evaluation(spark, "rows at hand").collect()}
    assert {r.n_trees for r in ev.values()} == {best} and set(ev) == {"val", "test"}
    assert ev["val"].pr_auc == pytest.approx(rounds[best - 1].val_pr_auc, abs=1e-6)


def test_registered_importances_are_of_all_kept_rounds(spark, boosted):
    got = boosted.leafwise_importances(spark, "rows at hand").orderBy("rank").collect()
    model = next(iter(boosted._LEAFWISE.values()))[0]
    gain = dict.fromkeys(model.features, 0.0)
    for t in model.trees:
        for i in _inner(t):
            gain[model.features[t.feature[i]]] += t.gain[i]
    assert len(model.trees) > 8 and {r.feature: r.importance for r in got} == pytest.approx({f: g / sum(gain.values()) for f, g in gain.items()})
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)
