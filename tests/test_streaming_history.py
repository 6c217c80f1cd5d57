"""ST3 over several micro-batches: open steps are held, late rows are kept apart."""
import os
import uuid

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import history as H
from ledgerscope.plans import q_streaming as Q
from ledgerscope.session import ensure_checkpoint_dir
from ledgerscope.streaming import jobs as SJ

SCHEMA = "event_id long, step int, nameDest string, nameOrig string, amount double"
COLS = ["event_id", "hist_dest_txn_count", "hist_dest_unique_origin_count", "hist_dest_total_amount",
        "hist_dest_max_amount", "hist_dest_avg_amount"]


def _stream(spark, files):
    base = os.path.join(ensure_checkpoint_dir(spark), f"st3-{uuid.uuid4().hex}")
    src = os.path.join(base, "src")
    schema = spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    for rows in files:        # one file per micro-batch, in this order
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    out = SJ.stream_dest_history(spark, src, schema, os.path.join(base, "out"), os.path.join(base, "ck"), 1)
    late = spark.read.schema(schema).parquet(os.path.join(base, "ck", "dest_state", "late"))
    return out, late


def _rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*COLS).collect())


def test_a_step_in_several_files_keeps_every_row(spark):
    files = [[(1, 1, "M", "a", 0.004), (2, 1, "M", "b", 0.004)], [(3, 1, "M", "a", 2.0), (4, 1, "N", "a", 1.0)],
             [(5, 2, "M", "c", 1e18), (6, 2, None, "c", 1.0)], [(7, 2, "M", "a", 3.0), (8, 3, "M", "c", 4.0)],
             [(9, 3, "N", "a", 4.0), (10, 3, "N", "d", 4.0)]]
    out, late = _stream(spark, files)
    whole = spark.createDataFrame([r for f in files for r in f], SCHEMA)
    assert late.count() == 0 and out.count() == 10
    assert _rows(out.where("nameDest is not null")) == _rows(H.prior_history(whole).where("nameDest is not null"))


def test_late_rows_are_kept_apart(spark):
    out, late = _stream(spark, [[(1, 1, "M", "a", 1.0)], [(2, 2, "M", "a", 1.0)],
                                [(3, 1, "M", "z", 9.0), (4, None, "M", "z", 9.0), (5, 3, "M", "b", 1.0)]])
    assert {r.event_id for r in late.collect()} == {3, 4}
    assert _rows(out.select(*COLS)) == [(1, 0, 0, 0.0, 0.0, 0.0), (2, 1, 1, 1.0, 1.0, 1.0), (5, 2, 1, 2.0, 1.0, 1.0)]


def test_history_totals_keep_small_and_large_amounts(spark):
    df = spark.createDataFrame([(1, 1, "M", "a", 0.004), (2, 2, "M", "a", 0.004), (3, 3, "M", "a", 1e18), (4, 4, "M", "a", 1.0)], SCHEMA)
    got = {r.event_id: r.hist_dest_total_amount for r in H.prior_history(df).collect()}
    assert got == {1: 0.0, 2: 0.004, 3: 0.008, 4: 1e18}


def _ledger(spark, n):
    """n rows; those of the first steps are slow to write."""
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.expr("cast(id div 10 as int)").alias("step"), F.expr("concat('M', id % 3)").alias("nameDest"),
        F.expr(f"if(id < {n // 4}, repeat(sha2(cast(id as string), 512), 2000), 'a')").alias("nameOrig"), F.lit(1.0).alias("amount"))


def test_files_written_in_parallel_come_in_step_order(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = _ledger(spark, 800)
        base = os.path.join(ensure_checkpoint_dir(spark), f"st3-{uuid.uuid4().hex}")
        src = os.path.join(base, "src")
        Q._write_source(df, src, ["step", "event_id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(f for f in os.listdir(src.removeprefix("file:")) if f.startswith("part-"))
    assert len(parts) >= 32
    assert parts == sorted(parts, key=lambda f: os.stat(os.path.join(src.removeprefix("file:"), f)).st_mtime_ns)
    out = SJ.stream_dest_history(spark, src, df.schema, os.path.join(base, "out"), os.path.join(base, "ck"), 8)
    assert SJ.late_rows(spark, df.schema, os.path.join(base, "ck")).count() == 0 and out.count() == 800


def test_history_query_ends_on_late_rows_and_keeps_rows_without_a_step(spark, monkeypatch):
    led = spark.createDataFrame([(i, i if i < 6 else None, "M", "a", 1.0) for i in range(1, 8)], SCHEMA)
    monkeypatch.setattr(Q, "ledger", lambda *a: led)
    got = {r.event_id: r.hist_dest_txn_count for r in Q.dest_history_stream(spark, "").collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 0, 7: 0}

    def backwards(df, path, by):
        for i in (5, 4, 3, 2, 1):
            df.where(F.col("step") == i).coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(Q, "_write_source", backwards)
    with pytest.raises(RuntimeError, match="closed"):
        Q.dest_history_stream(spark, "")
