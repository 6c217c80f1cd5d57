"""S5, S7, S8 together: a fitted model, its predictions and its report are
published as one version.

A version is a folder ``v=<number>`` of a shared folder, with ``model``,
``predictions`` (by split), ``report`` and ``manifest``. The manifest is written
last, holds the metadata and the files and bytes of each part, and is committed
as a whole, so a version is complete when its manifest is committed and its parts
are as it says. Readers take the last complete version; a publisher that ends
half-way leaves a folder that no reader takes and whose number is not used
again. Versions are never changed.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from . import artifacts as A

PARTS = ("model", "predictions", "report")


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    meta: dict

    def part(self, name: str) -> str:
        return f"{self.path}/{name}"

    def model(self) -> PipelineModel:
        return A.load_model(self.part("model"))

    def predictions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.part("predictions"))

    def report(self, spark: SparkSession) -> DataFrame:
        return spark.read.json(self.part("report"))


def _fs(spark: SparkSession, path: str):
    jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return jp(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jp


def _numbers(spark: SparkSession, root: str) -> list[int]:
    fs, jp = _fs(spark, root)
    if not fs.exists(jp(root)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(jp(root)) if f.isDirectory()]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def _sizes(spark: SparkSession, path: str) -> dict:
    """Files and bytes of each part that is there."""
    fs, jp = _fs(spark, path)
    out = {}
    for p in PARTS:
        at = jp(f"{path}/{p}")
        if fs.exists(at):
            s = fs.getContentSummary(at)
            out[p] = {"files": s.getFileCount(), "bytes": s.getLength()}
    return out


def _claim(spark: SparkSession, root: str) -> int:
    """A version number of our own: one marker file can be made once only."""
    number = max(_numbers(spark, root), default=0)
    while True:
        number += 1
        path = f"{root}/v={number}"
        fs, jp = _fs(spark, path)
        fs.mkdirs(jp(path))
        if fs.createNewFile(jp(f"{path}/_claimed")):
            return number


def publish(spark: SparkSession, root: str, model: PipelineModel, predictions: DataFrame, report: DataFrame, meta: dict) -> Version:
    """Write a new version, its manifest last. ``predictions`` needs a ``split`` column."""
    root = root.rstrip("/")
    number = _claim(spark, root)
    path = f"{root}/v={number}"
    A.save_model(model, f"{path}/model")
    A.write_predictions(predictions, f"{path}/predictions")
    A.write_report(report, f"{path}/report")
    A.write_metadata(spark, {"version": number, "meta": meta, "parts": _sizes(spark, path)}, f"{path}/manifest")
    return Version(number, path, meta)


def latest(spark: SparkSession, root: str) -> Version:
    """The last complete version; FileNotFoundError if there is none."""
    root = root.rstrip("/")
    for number in reversed(_numbers(spark, root)):
        path = f"{root}/v={number}"
        fs, jp = _fs(spark, path)
        if not fs.exists(jp(f"{path}/manifest/_SUCCESS")):
            continue
        try:
            said = A.read_metadata(spark, f"{path}/manifest")
        except (json.JSONDecodeError, TypeError):       # a manifest that was cut or emptied
            continue
        if said["parts"] == _sizes(spark, path) and set(said["parts"]) == set(PARTS):
            return Version(number, path, said["meta"])
    raise FileNotFoundError(f"no complete version under {root}")


def publish_table(df: DataFrame, root: str) -> int:
    """A new version of a lookup table; complete when its write is committed."""
    spark, root = df.sparkSession, root.rstrip("/")
    number = _claim(spark, root)
    df.write.mode("overwrite").parquet(f"{root}/v={number}/table")
    return number


def complete_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions of a lookup table, ascending."""
    root = root.rstrip("/")
    fs, jp = _fs(spark, root)
    return [n for n in _numbers(spark, root) if fs.exists(jp(f"{root}/v={n}/table/_SUCCESS"))]


def table_version(spark: SparkSession, root: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/v={number}/table")
