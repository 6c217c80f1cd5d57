"""Published versions: readers take the last complete one."""
import os
import uuid

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ledgerscope.operators import train as TR
from ledgerscope.session import ensure_checkpoint_dir
from ledgerscope.sources import published as PB


@pytest.fixture(scope="module")
def fitted(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") > 120).cast("int").alias("isFraud"),
                                 F.when(F.col("id") % 2 == 0, "val").otherwise("test").alias("split"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             LogisticRegression(labelCol="isFraud", maxIter=5)]).fit(df)
    return model, TR.score(model, df)


def _root(spark):
    return os.path.join(ensure_checkpoint_dir(spark), f"published-{uuid.uuid4().hex}")


def _publish(spark, root, fitted, **meta):
    model, scored = fitted
    return PB.publish(spark, root, model, scored, scored.groupBy("split").count(), meta)


def test_round_trip(spark, fitted):
    root = _root(spark)
    assert _publish(spark, root, fitted, name="a").number == 1
    v = PB.latest(spark, root)
    assert (v.number, v.meta) == (1, {"name": "a"})
    again = TR.score(v.model(), fitted[1].drop("pred_prob"))
    assert again.select("x", "pred_prob").exceptAll(v.predictions(spark).select("x", "pred_prob")).count() == 0
    assert {(r["split"], r["count"]) for r in v.report(spark).collect()} == {("val", 100), ("test", 100)}


def test_a_publisher_that_ends_half_way_is_not_read_and_its_number_not_used_again(spark, fitted):
    root = _root(spark)
    _publish(spark, root, fitted, name="a")
    model, scored = fitted
    broken = scored.select("split", F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception, match="lost"):
        PB.publish(spark, root, model, broken, scored.groupBy("split").count(), {"name": "b"})
    assert PB.latest(spark, root).meta == {"name": "a"}
    assert _publish(spark, root, fitted, name="c").number == 3
    assert PB.latest(spark, root).meta == {"name": "c"}


def test_parts_that_are_not_as_the_manifest_says_or_an_empty_manifest(spark, fitted):
    root = _root(spark)
    for name in "abc":
        last = _publish(spark, root, fitted, name=name)
    spark.range(3).write.parquet(last.part("predictions/split=more"))
    assert PB.latest(spark, root).meta == {"name": "b"}
    spark.range(0).select(F.lit("").alias("t")).write.mode("overwrite").text(f"{root}/v=2/manifest")
    assert PB.latest(spark, root).meta == {"name": "a"}


def test_models_score_in_a_session_that_has_split_requests(spark, fitted):
    """Scored rows still serialise for a checkpoint after a quarantine."""
    from ledgerscope.operators import quality as Q
    rows = spark.createDataFrame([(1, "5", "CASH_OUT", "10"), (2, "0", "gift", "-1")], "event_id long, step string, type string, amount string")
    rows = rows.select("*", *[F.lit(0.0).alias(c) for c in Q.BALANCE_FIELDS])
    valid, refused, n = Q.quarantine(rows, _root(spark))
    assert ([r.event_id for r in valid.collect()], [r.event_id for r in refused.collect()], n) == ([1], [2], {"valid": 1, "refused": 1})
    assert Q.quarantine(rows.limit(0), _root(spark))[2] == {"valid": 0, "refused": 0}
    model, scored = fitted
    assert TR.score(model, scored.drop("pred_prob")).checkpoint().count() == 200


def test_nothing_published(spark):
    with pytest.raises(FileNotFoundError):
        PB.latest(spark, _root(spark))
