import numpy as np
import pytest

from ledgerscope.operators import metrics as M


def _brute(y, s):
    """Average precision, ROC-AUC (ties half) and precision at recall >= t
    (ties -> higher recall) straight from the definitions."""
    P, N = y.sum(), len(y) - y.sum()
    ths = np.unique(s)[::-1]
    prec, rec = [], []
    ap = 0.0
    prev_r = 0.0
    for t in ths:
        pred = s >= t
        tp = (pred & (y == 1)).sum()
        fp = (pred & (y == 0)).sum()
        p, r = tp / (tp + fp), tp / P
        ap += (r - prev_r) * p
        prev_r = r
        prec.append(p)
        rec.append(r)
    auc = 0.0
    for i in np.flatnonzero(y == 1):
        auc += (s[y == 0] < s[i]).sum() + 0.5 * (s[y == 0] == s[i]).sum()
    auc /= P * N
    par = {}
    for t in M.RECALL_TARGETS:
        ok = [(p, r) for p, r in zip(prec, rec) if r >= t]
        par[t] = max(ok) if ok else None
    return ap, auc, par


@pytest.mark.parametrize("seed", [1, 2])
def test_ranking_metrics_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 400
    s = np.round(rng.random(n), 2)           # many ties
    y = (rng.random(n) < 0.2 + 0.5 * s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "isFraud int, score double")
    cv = M.curve(df)
    rk = M.ranking_metrics(cv).first()
    pr = M.precision_at_recall(cv).first()
    ap, auc, par = _brute(y, s)
    assert rk["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert rk["roc_auc"] == pytest.approx(auc, abs=1e-12)
    for t, v in par.items():
        k = int(round(t * 100))
        assert pr[f"precision_at_recall_{k}"] == pytest.approx(v[0], abs=1e-12)
        assert pr[f"actual_recall_{k}"] == pytest.approx(v[1], abs=1e-12)


def test_threshold_sweep_counts_exact_threshold_as_positive(spark):
    rows = [(1, 0.43), (0, 0.43), (1, 0.429999), (0, 0.01), (1, 0.99), (0, 0.0)]
    df = spark.createDataFrame(rows, "isFraud int, score double")
    sw = {r.threshold: r for r in M.threshold_sweep(df).collect()}
    assert len(sw) == 50
    for t, r in sw.items():
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y == 0 and s >= t)
        assert (r.tp, r.fp) == (tp, fp), t


def test_operating_points_ties_go_to_lowest_threshold(spark):
    rows = [(0.01 + 0.02 * i, 0.5, 0.95, 0.6) for i in range(50)]
    sweep = spark.createDataFrame(rows, "threshold double, precision double, recall double, f1 double")
    pts = {r.mode: r.threshold for r in M.operating_points(sweep).collect()}
    assert pts == {"high_recall": 0.01, "balanced": 0.01, "high_precision": 0.01}


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "isFraud int, score double")
    r = M.confusion_at(df, 0.5).first()
    assert (r.tp, r.fp, r.precision, r.recall, r.f1) == (0, 0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("seed", [3, 4])
def test_operating_points_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(round(0.01 + 0.02 * i, 3), float(rng.choice([0.5, 0.79, 0.8, 0.95])),
             float(rng.choice([0.6, 0.89, 0.9, 0.99])), float(rng.choice([0.3, 0.6]))) for i in range(50)]
    if seed == 4:   # no row reaches recall 0.90: high_recall falls back to max recall
        rows = [(t, p, min(r, 0.89), f) for t, p, r, f in rows]
    sweep = spark.createDataFrame(rows, "threshold double, precision double, recall double, f1 double")
    got = {r.mode: r.threshold for r in M.operating_points(sweep).collect()}

    def argmax(cands, key):
        return min(cands, key=lambda t: (-key(t), t[0]))[0]

    hr = [t for t in rows if t[2] >= 0.90]
    hp = [t for t in rows if t[1] >= 0.80]
    exp = {"high_recall": argmax(hr, lambda t: t[1]) if hr else argmax(rows, lambda t: t[2]),
           "balanced": argmax(rows, lambda t: t[3]),
           "high_precision": argmax(hp, lambda t: t[2]) if hp else argmax(rows, lambda t: t[1])}
    assert got == exp


def test_evaluate_at_equals_evaluate_per_point(spark):
    rng = np.random.default_rng(9)
    s = np.round(rng.random(500), 2)
    y = (rng.random(500) < 0.1 + 0.6 * s).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "isFraud int, score double")
    pts = [("high_recall", 0.21), ("balanced", 0.43), ("high_precision", 0.77)]
    got = {r.mode: r.asDict() for r in M.evaluate_at(df, pts).collect()}
    for mode, t in pts:
        exp = M.evaluate(df, t).first().asDict()
        row = dict(got[mode])
        assert row.pop("mode") == mode
        assert row == exp
