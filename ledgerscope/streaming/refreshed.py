"""ST1 with lookups that change while the stream runs.

The frozen per-type table and the spike table are folders of versions. A
micro-batch takes the last complete version of each, notes the two numbers under
the checkpoint folder before anything else, and writes them with every decision.
So a new version shows from the next micro-batch on, and a micro-batch that is
run again decides with the versions that it began with.

Defined results: without a complete spike table decisions say that it is not
available (its version is null); without a complete frozen table the run fails,
since no request can be given its features; a version that was not finished is
not taken; an empty micro-batch writes no decisions.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide as D
from ..sources.artifacts import bounded_files
from ..sources.published import complete_versions, table_version
from .jobs import _exists, _run


def flat_decisions(out: DataFrame) -> DataFrame:
    """Decisions with their nested columns as JSON, as the sinks hold them."""
    nested = ("top_reasons", "explanation", "spike_context")
    return out.select(*[c for c in out.columns if c not in nested], *[F.to_json(c).alias(c) for c in nested])


def stream_refreshed_decisions(spark: SparkSession, source_dir: str, schema, out_dir: str, ckpt_dir: str, frozen_root: str,
                               spikes_root: str, modes: DataFrame, score_fn, contrib_fn=None, max_files_per_trigger: int | None = None) -> DataFrame:
    """The decisions of all micro-batches so far, with frozen_version and spikes_version."""
    def noted(batch_id: int) -> tuple[int | None, int | None]:
        path = os.path.join(ckpt_dir, "lookups", f"batch_id={batch_id}")
        if not _exists(spark, os.path.join(path, "_SUCCESS")):
            now = [max(complete_versions(spark, root), default=None) for root in (frozen_root, spikes_root)]
            spark.createDataFrame([tuple(now)], "frozen long, spikes long").coalesce(1).write.mode("overwrite").parquet(path)
        return tuple(spark.read.schema("frozen long, spikes long").parquet(path).first())

    def sink(batch: DataFrame, batch_id: int):
        frozen, spikes = noted(batch_id)
        if frozen is None:
            raise FileNotFoundError(f"no complete version of the frozen table under {frozen_root}")
        out = D.decide(batch, table_version(spark, frozen_root, frozen), modes, score_fn,
                       None if spikes is None else table_version(spark, spikes_root, spikes), contrib_fn=contrib_fn)
        flat = flat_decisions(out).withColumn("frozen_version", F.lit(frozen).cast("long")).withColumn("spikes_version", F.lit(spikes).cast("long"))
        bounded_files(flat.write.mode("overwrite")).parquet(os.path.join(out_dir, f"batch_id={batch_id}"))

    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    _run(reader.parquet(source_dir).writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(ckpt_dir, "refreshed")),
         "st1_refreshed")
    return spark.read.parquet(out_dir)
