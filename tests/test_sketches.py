"""Mergeable sketches against exact counts and ranks."""
import random

from ledgerscope.operators import sketches as SK

SCHEMA = "step long, who string, amount double"


def test_unions_equal_one_sketch_and_stay_near(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), f"C{rng.randrange(9000)}", rng.lognormvariate(5, 2)) for _ in range(40_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    steps = SK.step_sketches(df, ["who"], "amount")
    united = SK.union(steps, []).select(SK.distinct("who"), *[SK.quantile("amount", q) for q in (0.05, 0.5, 0.95)]).first()
    exact = len({r[1] for r in rows})
    assert abs(united[0] - exact) <= SK.distinct_error() * exact
    amounts = sorted(r[2] for r in rows)
    for q, v in zip((0.05, 0.5, 0.95), united[1:]):
        assert abs(sum(a <= v for a in amounts) / len(amounts) - q) < 0.03
    # a union counts what the steps share once, whatever the order and partitions
    again = SK.union(steps.repartition(7), []).select(SK.distinct("who")).first()[0]
    assert again == united[0] < sum(r[0] for r in steps.select(SK.distinct("who")).collect())


def test_nulls_empty_groups_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, "a", 5.0), (1, None, None), (2, None, None), (None, "b", nan), (None, "b", 7.0), (3, "c", inf)], SCHEMA)
    got = {r[0]: tuple(r[1:]) for r in SK.step_sketches(df, ["who"], "amount").select("step", SK.distinct("who"), SK.quantile("amount", 0.5)).collect()}
    assert got == {1: (1, 5.0), 2: (0, None), None: (1, 7.0), 3: (1, inf)}
    assert SK.step_sketches(df.limit(0), ["who"], "amount").count() == 0
    assert SK.union(SK.step_sketches(df.limit(0), ["who"], "amount"), []).select(SK.distinct("who"), SK.quantile("amount", 0.5)).first()[:] == (0, None)
