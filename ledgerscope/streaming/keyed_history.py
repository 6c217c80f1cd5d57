"""ST3 as keyed state: strictly-prior destination history on a stream.

One stateful processor keeps per destination a value (the totals of all steps
before the open one, and of the open one), a map of the origins seen, and the
rows that wait. A row of step T is settled, and goes out, when no row of an
earlier step can come any more: the watermark follows the highest step seen, so
an event-time timer at T fires from the next micro-batch on. Rows of the step
that is open then are settled at once; they see the totals before it only.

Every call from Python to the state costs far more than the bytes it moves. So a
destination has one timer, at the earliest step that waits, and not one a step;
waiting rows are Arrow blocks; and origins lie in buckets of about ``BUCKET``,
whose number doubles as they grow, so a row reads one bucket at most.

A micro-batch touches the state of its own destinations and the expired timers,
nothing else, so its work goes with its rows and not with the history behind it.
The state is in RocksDB with changelog checkpoints. The rows of a destination in
one micro-batch are one group: size the trigger to bound a hot destination.

Rows of a step below the watermark, or without a step, are late: they get no
history here and are what ``late_rows`` returns.
"""
from __future__ import annotations

import contextlib
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor

from ..operators import exact

HOUR_MS = 3_600_000
#: Origins in a bucket of the state, and rows in a waiting block.
BUCKET, BLOCK = 256, 10_000
#: Hours added to a step for its event time: a stream's first watermark is 0, so steps may go down to -START.
START = 1_000_000
PREFIX = "hist_dest"
HISTORY = (f"{PREFIX}_txn_count long, {PREFIX}_unique_origin_count long, {PREFIX}_total_amount double, "
           f"{PREFIX}_max_amount double, {PREFIX}_avg_amount double")
_SUMS = ("n", "u", *exact.NAMES, "top")
_EMPTY = (0, 0, 0, 0, 0, 0.0, None)
_TOTALS = ", ".join(f"{w}_{c} {'double' if c in ('wide', 'top') else 'long'}" for w in ("closed", "open") for c in _SUMS)


def _added(a: tuple, b: tuple) -> tuple:
    tops = [x for x in (a[-1], b[-1]) if x is not None]
    return (*[x + y for x, y in zip(a[:-1], b[:-1])], max(tops, default=None))


def _due(step):
    """The watermark at which all earlier steps are closed."""
    return (step + START) * HOUR_MS - 1


def _buckets(origins: int) -> int:
    """Buckets for so many origins: a power of two."""
    return 1 << (origins // BUCKET).bit_length()


class DestinationHistory(StatefulProcessor):
    """Input rows: the ledger's columns, the amount's exact parts (``part_*``; the
    worker would rename columns with a leading underscore) and ``_ts``; output:
    the ledger's columns and the history."""

    def __init__(self, schema: T.StructType):
        self.columns = schema.names
        self.held = T.StructType([*schema.fields, *[T.StructField(f"part_{c}", T.DoubleType() if c == "wide" else T.LongType()) for c in exact.NAMES]])

    def init(self, handle):
        self.handle = handle
        self.totals = handle.getValueState("totals", f"open_step long, {_TOTALS}")
        self.seen = handle.getMapState("seen", "bucket int", "origins array<string>")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = pd.concat(list(rows))[self.held.names]
        settled = _due(rows["step"].astype("int64")) <= watermark
        ready, later = rows[settled], rows[~settled]
        if len(ready):          # input comes before the timers, so rows that wait and are settled by now go first
            held = self._settled(watermark)
            ready = pd.concat([held, ready]) if len(held) else ready
        if len(later):
            self.waiting.appendList(self._blocks(later))
            self.handle.registerTimer(_due(int(later["step"].min())))
        yield from self._out(ready)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._out(self._settled(timerValues.getCurrentWatermarkInMs()))

    def _settled(self, watermark):
        """Takes the settled rows out of the waiting ones; a timer stays for the earliest of the others."""
        blocks = [pa.ipc.open_stream(b).read_pandas() for b, in self.waiting.get()]
        if not blocks:
            return pd.DataFrame(columns=self.held.names)
        rows = pd.concat(blocks)
        settled = _due(rows["step"].astype("int64")) <= watermark
        rest = rows[~settled]
        if settled.all():
            self.waiting.clear()
        elif settled.any():
            self.waiting.put(self._blocks(rest))
        if len(rest):
            self.handle.registerTimer(_due(int(rest["step"].min())))
        return rows[settled]

    def close(self):
        pass

    def _blocks(self, pdf):
        """Rows for the state."""
        schema = to_arrow_schema(self.held)
        out = []
        for at in range(0, len(pdf), BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as w:
                w.write_batch(pa.RecordBatch.from_pandas(pdf.iloc[at:at + BLOCK], schema, preserve_index=False))
            out.append((sink.getvalue().to_pybytes(),))
        return out

    def _unseen(self, origins: list[str], known: int) -> list[str]:
        """Those of the distinct origins that are new, noted; ``known``: how many are in the state."""
        def dealt(names, n):
            out = {}
            for name in names:
                out.setdefault(zlib.crc32(name.encode()) & (n - 1), []).append(name)
            return out

        n, new = _buckets(known), []
        mine, held = dealt(origins, n), {}
        for b, names in mine.items():
            held[b] = list(self.seen.getValue((b,))[0]) if self.seen.containsKey((b,)) else []
            old = set(held[b])
            fresh = [x for x in names if x not in old]
            new += fresh
            mine[b] = fresh
        grown = _buckets(known + len(new))
        if grown == n:
            for b, fresh in mine.items():
                if fresh:
                    self.seen.updateValue((b,), (held[b] + fresh,))
        else:                   # as often as the number of origins doubles
            every = new + [x for b in range(n) for x in (held[b] if b in held else self.seen.getValue((b,))[0] if self.seen.containsKey((b,)) else [])]
            for b, names in dealt(every, grown).items():
                self.seen.updateValue((b,), (names,))
        return new

    def _out(self, rows):
        """Settled rows: those of a step see the totals before it."""
        if not len(rows):
            return
        if self.totals.exists():
            step, *flat = self.totals.get()
            closed, opened = tuple(flat[:len(_SUMS)]), tuple(flat[len(_SUMS):])
        else:
            step, closed, opened = None, _EMPTY, _EMPTY
        steps, at = np.unique(rows["step"].to_numpy("int64"), return_inverse=True)
        origins = ["" if pd.isna(x) else "=" + x for x in rows["nameOrig"]]      # a null is an origin too
        first = pd.Series(at).groupby(origins, sort=False).min()
        new = self._unseen(first.index.tolist(), closed[1] + opened[1])

        def summed(c, kind):
            out = np.zeros(len(steps), kind)
            np.add.at(out, at, rows[c].astype(float).fillna(0).to_numpy(kind) if rows[c].hasnans else rows[c].to_numpy(kind))
            return out.tolist()

        added = zip(np.bincount(at, minlength=len(steps)).tolist(), np.bincount(first[new].to_numpy(np.int64), minlength=len(steps)).tolist(),
                    *[summed(f"part_{c}", float if c == "wide" else np.int64) for c in exact.NAMES],
                    [None if pd.isna(x) else float(x) for x in rows["amount"].astype(float).groupby(at).max()])
        before = []
        for this, one in zip(steps.tolist(), added):
            if step is None or this > step:
                step, closed, opened = this, _added(closed, opened), _EMPTY
            total = float(exact.total(*[float(x) for x in closed[2:6]]))
            before.append((closed[0], closed[1], total, 0.0 if closed[6] is None else closed[6], total / closed[0] if closed[0] else 0.0))
            opened = _added(opened, one)
        self.totals.update((step, *closed, *opened))
        out = rows[self.columns].reset_index(drop=True)
        for c, values in zip(("txn_count", "unique_origin_count", "total_amount", "max_amount", "avg_amount"), zip(*before)):
            out[f"{PREFIX}_{c}"] = np.array(values)[at]
        yield out


@contextlib.contextmanager
def _state_store(spark: SparkSession, partitions: int | None):
    """The session settings that a keyed stream needs, put back afterwards."""
    want = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    if partitions:
        want["spark.sql.shuffle.partitions"] = str(partitions)
    old = {k: spark.conf.get(k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def with_history(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The streaming transformation: rows with a step, and their history."""
    out = T.StructType([*schema.fields, *T._parse_datatype_string(HISTORY).fields])
    # one hour a step, the millisecond below it as delay: the highest step seen stays open
    timed = (rows.where("step IS NOT NULL").select(*schema.names, *exact.parts("amount", "part"), F.timestamp_seconds((F.col("step").cast("long") + START) * 3600).alias("_ts"))
             .withWatermark("_ts", "1 millisecond"))
    return timed.groupBy("nameDest").transformWithStateInPandas(DestinationHistory(schema), out, "Append", "EventTime")


def stream_keyed_history(spark: SparkSession, source_dir: str, schema: T.StructType, out_dir: str, ckpt_dir: str,
                         max_files_per_trigger: int | None = None, partitions: int | None = None) -> DataFrame:
    """Runs the stream over what is in the source folder and returns the sink's
    rows. ``schema``: the ledger's columns, with nameDest, nameOrig, step, amount.
    ``partitions`` fixes the number of state partitions of a new checkpoint."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    with _state_store(spark, partitions):
        q = (with_history(reader.parquet(source_dir), schema).writeStream.format("parquet").option("path", out_dir)
             .option("checkpointLocation", os.path.join(ckpt_dir, "keyed_history")).outputMode("append")
             .queryName("st3_keyed_history").trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return spark.read.schema(T.StructType([*schema.fields, *T._parse_datatype_string(HISTORY).fields])).parquet(out_dir)


def late_rows(source: DataFrame, out: DataFrame, key: str = "event_id") -> DataFrame:
    """Source rows that got no history: of a closed step, or without a step."""
    return source.join(out.select(key), key, "left_anti")
