"""Closed hours and late rows against a plain walk over the micro-batches."""
import os
import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscope.session import ensure_checkpoint_dir
from ledgerscope.streaming import closed_steps as CS

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("type", T.StringType()),
                       T.StructField("amount", T.DoubleType()), T.StructField("isFraud", T.IntegerType())])
SECONDS = "event_id long, s long, type string, amount double, isFraud int"
HOUR, DELAY = 3600, 3600


def _batches(n=12, seed=5):
    """Rows as (id, seconds, type, amount, label); time moves on by about an hour
    a batch, some rows come hours later than their time."""
    rng, out, i = random.Random(seed), [], 0
    for b in range(n):
        rows = []
        for _ in range(rng.randrange(20, 60)):
            s = b * HOUR + rng.randrange(HOUR) - (rng.randrange(8) * HOUR if rng.random() < 0.2 else 0)
            rows.append((i, max(s, 0), rng.choice(["TRANSFER", "CASH_OUT", "DEBIT"]), rng.choice([None, round(rng.uniform(0, 900), 2), 0.1]), rng.randrange(2)))
            i += 1
        rows += rows[:2]                                     # repeated rows
        rows.append((i, None, "DEBIT", 5.0, 0))              # no time
        i += 1
        out.append(rows)
    return out


def _walk(batches):
    latest, hours, late, closed = None, defaultdict(list), [], []
    for rows in batches:
        for r in rows:
            shut = r[1] is None or (latest is not None and r[1] // HOUR * HOUR + HOUR + DELAY <= latest)
            late.append(r[0]) if shut else hours[r[1] // HOUR].append(r)
        latest = max([r[1] for r in rows if r[1] is not None] + ([] if latest is None else [latest]), default=None)
        done = [h for h in hours if h not in closed and latest is not None and h * HOUR + HOUR + DELAY <= latest]
        closed += done
    return {h: hours[h] for h in closed}, sorted(late), {h: v for h, v in hours.items() if h not in closed}


def _write(spark, path, batches, first=0):
    for b, rows in enumerate(batches, first):
        (spark.createDataFrame(rows, SECONDS).withColumn("s", F.timestamp_seconds("s")).withColumnRenamed("s", "ts")
              .coalesce(1).write.mode("append").parquet(path))
        for name in os.listdir(path):                        # files of earlier batches keep their times
            full = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(full) > 2e6:
                os.utime(full, (1_000_000 + b, 1_000_000 + b))


def _figures(df):
    return {r.h: r for r in df.withColumn("h", F.expr("unix_seconds(hour) div 3600")).collect()}


def _same(df, want):
    got = _figures(df)
    assert sorted(got) == sorted(want) and df.count() == len(want)
    for h, rows in want.items():
        amounts = sorted(r[3] for r in rows if r[3] is not None)
        g = got[h]
        assert (g.transaction_count, g.transfer_count, g.cash_out_count, g.gt_fraud_count) == (
            len(rows), sum(r[2] == "TRANSFER" for r in rows), sum(r[2] == "CASH_OUT" for r in rows), sum(r[4] for r in rows))
        if amounts:
            assert g.total_amount == pytest.approx(sum(amounts)) and g.average_amount == pytest.approx(sum(amounts) / len(amounts))
            assert amounts[0] <= g.median_amount <= amounts[-1]
            below, upto = sum(a < g.median_amount for a in amounts), sum(a <= g.median_amount for a in amounts)
            assert below <= len(amounts) * 0.5 + 1 and upto >= len(amounts) * 0.5 - 1
        else:
            assert g.total_amount is None and g.median_amount is None


def _folders(spark):
    base = os.path.join(ensure_checkpoint_dir(spark).replace("file:", ""), f"closed-{uuid.uuid4().hex}")
    return [os.path.join(base, n) for n in ("source", "sink", "ckpt")]


def test_closed_hours_and_late_rows_equal_a_plain_walk(spark):
    batches = _batches()
    src, sink, ck = _folders(spark)
    _write(spark, src, batches)
    closed, late, still_open = CS.stream_closed_steps(spark, src, SCHEMA, sink, ck, DELAY, max_files_per_trigger=1)
    want_closed, want_late, want_open = _walk(batches)
    assert len(want_late) > 20 and len(want_closed) > 5 and want_open
    _same(closed, want_closed)
    _same(still_open, want_open)
    assert sorted(r.event_id for r in late.collect()) == want_late


def test_a_restart_carries_the_open_hours_and_changes_no_closed_one(spark):
    batches = _batches(8, seed=6)
    src, sink, ck = _folders(spark)
    _write(spark, src, batches[:4])
    before = _figures(CS.stream_closed_steps(spark, src, SCHEMA, sink, ck, DELAY, 1)[0])
    _write(spark, src, batches[4:], first=4)
    closed, late, still_open = CS.stream_closed_steps(spark, src, SCHEMA, sink, ck, DELAY, 1)
    want_closed, want_late, want_open = _walk(batches)
    _same(closed, want_closed)
    _same(still_open, want_open)
    assert sorted(r.event_id for r in late.collect()) == want_late
    after = _figures(closed)
    assert before and all(after[h] == r for h, r in before.items())


def test_empty_source_and_rows_without_a_time(spark):
    src, sink, ck = _folders(spark)
    _write(spark, src, [[(1, None, "DEBIT", 2.0, 0)]])
    closed, late, still_open = CS.stream_closed_steps(spark, src, SCHEMA, sink, ck, DELAY)
    assert (closed.count(), late.count(), still_open.count()) == (0, 1, 0)
    src, sink, ck = _folders(spark)
    os.makedirs(src)
    assert [d.count() for d in CS.stream_closed_steps(spark, src, SCHEMA, sink, ck, DELAY)] == [0, 0, 0]
