from pyspark.sql import functions as F

from ledgerscope.operators import history as H

# The worked example of strictly-prior destination history.
GOLDEN = [
    # nameDest, step, nameOrig, amount, prior count, prior unique origins, prior total, new, prior max
    ("D1", 1, "O1", 100.0, 0, 0, 0.0, 1, 0.0),
    ("D1", 1, "O2", 200.0, 0, 0, 0.0, 1, 0.0),
    ("D2", 2, "O3", 50.0, 0, 0, 0.0, 1, 0.0),
    ("D1", 3, "O1", 300.0, 2, 2, 300.0, 0, 200.0),
    ("D2", 3, "O4", 80.0, 1, 1, 50.0, 0, 50.0),
    ("D1", 5, "O5", 400.0, 3, 2, 600.0, 0, 300.0),
]


def _golden_df(spark):
    return spark.createDataFrame([g[:4] for g in GOLDEN], "nameDest string, step int, nameOrig string, amount double")


def test_golden_rows_both_plans(spark):
    for method in ("preagg", "range"):
        out = H.with_destination_features(_golden_df(spark), method=method)
        got = {(r.nameDest, r.step, r.nameOrig): r for r in out.collect()}
        for d, s, o, a, n, u, tot, new, mx in GOLDEN:
            r = got[(d, s, o)]
            assert (r.hist_dest_txn_count, r.hist_dest_unique_origin_count) == (n, u), method
            assert r.hist_dest_total_amount == tot and r.hist_dest_max_amount == mx, method
            assert r.destination_is_new == new, method
            assert r.hist_dest_avg_amount == (tot / n if n else 0.0)


def test_same_step_rows_do_not_see_each_other(spark):
    df = spark.createDataFrame([("D", 1, "A", 10.0), ("D", 1, "B", 20.0)], "nameDest string, step int, nameOrig string, amount double")
    rows = H.prior_history(df).collect()
    assert all(r.hist_dest_txn_count == 0 for r in rows)


def test_leakage_property(spark, sf_dir):
    """Changing rows at steps >= T leaves the history of rows before T (and the
    history columns at T) unchanged."""
    from ledgerscope.sources.ledger import events_ledger
    led = events_ledger(spark, sf_dir)
    t = 300
    changed = led.withColumn("amount", F.when(F.col("step") >= t, F.col("amount") * 7 + 1).otherwise(F.col("amount")))
    cols = ["event_id", "hist_dest_txn_count", "hist_dest_unique_origin_count", "hist_dest_total_amount",
            "hist_dest_max_amount"]
    a = H.prior_history(led).where(F.col("step") <= t).select(*cols)
    b = H.prior_history(changed).where(F.col("step") <= t).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_type_expanding_mean(spark):
    df = spark.createDataFrame([("T", 1, 10.0), ("T", 1, 30.0), ("T", 2, 100.0), ("T", 4, 1.0)],
                               "type string, step int, amount double")
    got = {r.step: r.hist_type_avg_amount for r in H.type_expanding_mean(df).collect()}
    assert got == {1: None, 2: 20.0, 4: 140.0 / 3}


def test_exact_totals_do_not_depend_on_partitions(spark, sf_dir):
    """Equal rows for every layout, and the right sums for small, large and odd amounts."""
    import decimal
    import random

    from ledgerscope.sources.ledger import events_ledger
    cols = ["event_id", "hist_dest_total_amount", "hist_dest_avg_amount"]
    led = events_ledger(spark, sf_dir).withColumn("nameDest", F.lit("D")).withColumn("amount", F.col("amount") / 7)
    one, many = (H.prior_history(led.repartition(n, "event_id")).select(*cols) for n in (1, 13))
    assert one.exceptAll(many).count() == 0
    spread = H.prior_history(led, method="range").select(*cols)
    assert one.exceptAll(spread).count() == 0

    rnd = random.Random(5)
    amounts = [0.004, 1e18, -2.5, 0.1, 0.2, 1e-9, 123456789.123456789, 0.0] + [round(rnd.uniform(-1e6, 1e6), 2) for _ in range(50)]
    rows = [("D", i, "O", a) for i, a in enumerate(amounts)]
    got = {r.step: r.hist_dest_total_amount for r in H.prior_history(
        spark.createDataFrame(rows, "nameDest string, step int, nameOrig string, amount double")).collect()}
    nine = decimal.Decimal("1e-9")
    for i in range(len(amounts)):
        want = float(sum((decimal.Decimal(repr(a)).quantize(nine) for a in amounts[:i]), decimal.Decimal(0)))
        assert abs(got[i] - want) <= 4e-16 * abs(want) + 1e-12, i

    odd = [("E", 1, "O", 1e30), ("E", 2, "O", 1.0), ("E", 3, "O", None), ("E", 4, "O", float("inf")), ("E", 5, "O", 1.0)]
    got = [r.hist_dest_total_amount for r in H.prior_history(
        spark.createDataFrame(odd, "nameDest string, step int, nameOrig string, amount double")).orderBy("step").collect()]
    assert got == [0.0, 1e30, 1e30, 1e30, float("inf")]
