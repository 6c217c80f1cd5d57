"""Infinite values, groups without values, oversized steps, steps without transactions."""
import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import quality, splits
from ledgerscope.operators.quantiles import exact_quantiles
from ledgerscope.operators.steps import step_table


@pytest.mark.parametrize("values", [[1.0, 2.0, float("inf")], [float("-inf"), 3.0, 4.0, 5.0, float("inf")],
                                    [-1.7e308, 0.0, 1.7e308], [float("inf")] * 3])
def test_quantiles_with_infinities(spark, values):
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("c", None), ("c", float("nan"))], "k string, v double")
    probs = [0.0, 0.5, 1.0]
    got = {r[0]: tuple(r[1:]) for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    exp = {r[0]: tuple(r[1:]) for r in df.where("v is not null and not isnan(v)").groupBy("k").agg(
        *[F.percentile("v", F.lit(p)) for p in probs]).collect()}
    assert got == exp
    whole = exact_quantiles(df, [], "v", probs, with_count=True).first()
    assert whole["_n"] == len(values) + 1 and whole["q0"] == min(values + [1.0])


def test_step_without_amounts_keeps_its_row(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (2, None), (900, 3.0)], "step int, amount double")
    for c in ("is_transfer", "is_cash_out", "high_amount_indicator", "isFraud"):
        df = df.withColumn(c, F.lit(0))
    assert {r.step: r.median_amount for r in step_table(df).collect()} == {1: 2.0, 2: None, 900: 3.0}
    assert [r.split for r in splits.with_split(df).where("step = 900").collect()] == ["test"]


def test_whole_steps_only_as_text_and_truncated_as_number(spark):
    def checked(df):
        for f in quality.REQUIRED_FIELDS:
            if f != "step":
                df = df.withColumn(f, F.lit("CASH_OUT") if f == "type" else F.lit("1"))
        return {r.step: (r.is_valid, r.clean_step) for r in quality.validate(df).collect()}

    assert checked(spark.createDataFrame([("5.0",), (" 7 ",), ("x",), ("0",)], "step string")) == {
        "5.0": (False, None), " 7 ": (True, 7), "x": (False, None), "0": (False, None)}
    assert checked(spark.createDataFrame([(5.7,), (0.5,), (float("inf"),)], "step double")) == {
        5.7: (True, 5), 0.5: (False, None), float("inf"): (False, None)}


def test_oversized_step_is_an_error_not_a_crash(spark):
    df = spark.createDataFrame([("3000000000",), ("5",), ("1e300",)], "step string")
    for f in quality.REQUIRED_FIELDS:
        if f != "step":
            df = df.withColumn(f, F.lit("CASH_OUT") if f == "type" else F.lit("1"))
    got = {r.step: (r.is_valid, r.clean_step) for r in quality.validate(df).collect()}
    assert got == {"3000000000": (False, None), "5": (True, 5), "1e300": (False, None)}


def test_cluster_without_shared_folder_is_an_error(monkeypatch):
    from ledgerscope import session

    class Fake:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Fake)
