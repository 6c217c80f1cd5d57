"""Point lookups: equal to a plain filter, and only the row groups that can hold
a wanted value are read."""
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerscope.session import ensure_checkpoint_dir
from ledgerscope.sources import lookup as LK

N_STEPS, PER_STEP = 200, 1000
SCHEMA = "step int, event_id long, who string"


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(N_STEPS * PER_STEP).select(
        (F.col("id") % N_STEPS).cast("int").alias("step"), F.col("id").alias("event_id"), F.sha2(F.col("id").cast("string"), 256).alias("who"))
    df = df.unionByName(spark.createDataFrame([(None, -1, None), (None, -2, "nobody")], SCHEMA))
    path = os.path.join(ensure_checkpoint_dir(spark), f"lookup-{uuid.uuid4().hex}")
    LK.write_for_lookup(df, path, "step", then=("event_id",), bloom=("who",), row_group_bytes=64 * 1024, distinct=2000)
    return path


def _ids(df):
    return sorted(r.event_id for r in df.select("event_id").collect())


@pytest.mark.parametrize("steps", [[5], [3, 150], [0, 40, 41, 42, 199], list(range(0, N_STEPS, 12))])
def test_steps_equal_a_filter_and_read_their_row_groups(spark, table, steps):
    wanted = spark.createDataFrame([(s,) for s in steps + steps], "step int")
    got = LK.lookup(spark, table, "step", wanted)
    assert _ids(got) == sorted(i for i in range(N_STEPS * PER_STEP) if i % N_STEPS in steps)
    read = LK.rows_read(LK.lookup(spark, table, "step", wanted))
    assert len(steps) * PER_STEP <= read <= len(steps) * PER_STEP * 3 + 10_000


def test_another_column_by_bloom_filter(spark, table):
    some = random.Random(3).sample(range(N_STEPS * PER_STEP), 3)
    wanted = spark.createDataFrame([(i,) for i in some], "i long").select(F.sha2(F.col("i").cast("string"), 256).alias("who"))
    assert _ids(LK.lookup(spark, table, "who", wanted)) == sorted(some)
    assert LK.rows_read(LK.lookup(spark, table, "who", wanted)) < N_STEPS * PER_STEP / 10


def test_nothing_wanted_null_wanted_or_not_there(spark, table):
    assert _ids(LK.lookup(spark, table, "step", spark.createDataFrame([], "step int"))) == []
    assert _ids(LK.lookup(spark, table, "step", spark.createDataFrame([(None,), (9999,)], "step int"))) == []
    assert LK.rows_read(LK.lookup(spark, table, "step", spark.createDataFrame([(9999,)], "step int"))) == 0


def test_more_values_than_a_filter_holds(spark, table):
    wanted = spark.createDataFrame([(s,) for s in range(50)] + [(None,)], "step int")
    a = LK.lookup(spark, table, "step", wanted, max_values=10)
    b = LK.lookup(spark, table, "step", wanted)
    assert a.columns == b.columns and _ids(a) == _ids(b) and len(_ids(a)) == 50 * PER_STEP


def test_empty_table(spark):
    path = os.path.join(ensure_checkpoint_dir(spark), f"lookup-{uuid.uuid4().hex}")
    LK.write_for_lookup(spark.createDataFrame([], SCHEMA), path, "step")
    assert _ids(LK.lookup(spark, path, "step", spark.createDataFrame([(1,)], "step int"))) == []
