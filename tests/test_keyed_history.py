"""ST3 as keyed state: many micro-batches, late rows, restarts."""
import os
import uuid

from pyspark.sql import functions as F

from ledgerscope.operators import history as H
from ledgerscope.session import ensure_checkpoint_dir
from ledgerscope.streaming import keyed_history as K

SCHEMA = "event_id long, step int, nameDest string, nameOrig string, amount double"
COLS = ["event_id", "hist_dest_txn_count", "hist_dest_unique_origin_count", "hist_dest_total_amount", "hist_dest_max_amount", "hist_dest_avg_amount"]


def folders(spark):
    base = os.path.join(ensure_checkpoint_dir(spark), f"keyed-{uuid.uuid4().hex}")
    return [os.path.join(base, n) for n in ("src", "out", "ck")]


def put(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def run(spark, src, out, ck):
    return K.stream_keyed_history(spark, src, spark.createDataFrame([], SCHEMA).schema, out, ck, 1, 1)


def compare(spark, got, rows):
    want = H.prior_history(spark.createDataFrame(rows, SCHEMA)).select(*COLS)
    got = got.select(*COLS)
    assert got.count() == len(rows)
    assert got.exceptAll(want).count() == 0


def test_over_fifty_micro_batches(spark):
    """Steps go on over file ends; a destination may pause; amounts and origins repeat or are null."""
    rows = [(i, i // 3, f"M{(i * 7) % 4}", f"C{i % 5}" if i % 11 else None, (i * 37 % 100) / 7 if i % 13 else None) for i in range(156)]
    src, out, ck = folders(spark)
    for lo in range(0, len(rows), 3):
        put(spark, src, rows[lo + 1:lo + 4] if lo else rows[:4])        # the last row of a step comes a file later
    got = run(spark, src, out, ck)
    assert K.late_rows(spark.read.parquet(src), got).collect() == []
    compare(spark, got, rows)
    batches = [f for f in os.listdir(os.path.join(ck.removeprefix("file:"), "keyed_history", "commits")) if f.isdigit()]
    assert len(batches) >= 50


def test_late_rows_and_restart(spark):
    src, out, ck = folders(spark)
    first = [(1, 1, "M", "a", 0.004), (2, 2, "M", "b", 1e18), (3, 2, "N", "a", 1.0)]
    put(spark, src, first)
    assert run(spark, src, out, ck).count() == 3            # the open step is settled as well
    more = [(4, 2, "M", "a", 5.0), (5, 1, "M", "z", 9.0), (6, None, "M", "z", 9.0), (7, 4, "M", "c", 1.0)]
    put(spark, src, more)                                   # a second run goes on from the checkpoint
    got = run(spark, src, out, ck)
    assert {r.event_id for r in K.late_rows(spark.read.parquet(src), got).collect()} == {5, 6}
    compare(spark, got, [*first, more[0], more[3]])


def test_state_goes_with_the_batch(spark):
    """Later micro-batches of equal size update as many state rows as early ones."""
    src, out, ck = folders(spark)
    for b in range(8):
        put(spark, src, [(b * 10 + i, b, f"M{b}-{i}", "a", 1.0) for i in range(10)])
    seen = []
    start = K._state_store

    with start(spark, 1):
        q = (K.with_history(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), spark.createDataFrame([], SCHEMA).schema)
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        seen = [s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"]]
    assert q.exception() is None and max(seen) <= 60 and spark.read.parquet(out).agg(F.count("*")).first()[0] == 80


def test_state_calls_do_not_go_with_the_steps(spark):
    """A destination of many steps and origins: its state moves in blocks and buckets, by few timers."""
    rows = [(i, i // 2 % 300, "M", f"C{i % 900}" if i % 17 else None, float(i % 5)) for i in range(3000)]
    src, out, ck = folders(spark)
    for lo, hi in ((0, 150), (150, 299), (299, 300)):
        put(spark, src, [r for r in rows if lo <= r[1] < hi])
    with K._state_store(spark, 1):
        q = (K.with_history(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src), spark.createDataFrame([], SCHEMA).schema)
             .writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start())
        q.awaitTermination()
        moved = sum(s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"])
    assert q.exception() is None
    compare(spark, spark.read.parquet(out), rows)
    assert moved < 200, moved
