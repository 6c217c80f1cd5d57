import numpy as np
import pytest

from ledgerscope.operators.cumulative import running_totals
from ledgerscope.operators.quantiles import exact_quantiles


def check_against_numpy(spark, g, v, probs):
    df = spark.createDataFrame([(str(a), float(b)) for a, b in zip(g, v)], "g string, v double")
    out = {r.g: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(out) == set(g)
    for key in set(g):
        exp = np.percentile(v[g == key], [p * 100 for p in probs], method="linear")
        assert [out[key][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(exp), rel=1e-12, abs=1e-9)


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    g = np.where(rng.random(3000) < 0.6, "hot", rng.choice(["a", "b", "c"], 3000))   # one hot group
    v = np.round(rng.lognormal(3, 2, 3000), 1)                                       # heavy tail, ties
    check_against_numpy(spark, g, v, [0.0, 0.01, 0.5, 0.95, 0.999, 1.0])


def test_exact_quantiles_over_a_block_of_ties(spark):
    rng = np.random.default_rng(11)
    g = rng.choice(["x", "y"], 800)
    v = np.concatenate([np.round(rng.normal(0, 50, 700), 3), np.full(100, 12.5)])
    check_against_numpy(spark, g, v, [0.0, 0.25, 0.5, 0.9, 1.0])


def test_running_totals_across_range_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(str(k), int(x), int(c)) for k, x, c in zip(rng.choice(["a", "b"], 500), rng.permutation(500),
                                                        rng.integers(0, 5, 500))]
    df = spark.createDataFrame(rows, "k string, x int, c int")
    out = running_totals(df, ["k"], "x", ["c"], descending=True, num_partitions=7).collect()
    assert len(out) == 500
    for r in out:
        assert r.cum_c == sum(c for k, x, c in rows if k == r.k and x >= r.x)


def test_null_keys_are_groups_of_their_own(spark):
    from ledgerscope.operators import profile, steps
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    assert {r.g: r.q0 for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()} == {None: 2.0, "a": 5.0}
    rows = [(None, 10.0, None), (None, 30.0, None), (1, 7.0, 0)]
    led = spark.createDataFrame([(s, a, f, 0, 0, 0) for s, a, f in rows],
                                "step int, amount double, isFraud int, is_transfer int, is_cash_out int, high_amount_indicator int")
    assert {r.isFraud: r.median for r in profile.amount_summary(led, ["isFraud"]).collect()} == {None: 20.0, 0: 7.0}
    assert {r.step: r.median_amount for r in steps.step_table(led).collect()} == {None: 20.0, 1: 7.0}
