"""Shared pieces of the training-data operators: tables in the cluster's shared
folder, exact running totals over a global order, word splitting, components."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The six white-space characters that separate words.
WS = " \t\n\x0b\f\r"
_WS_SQL = "' \\t\\n\\u000B\\u000C\\r'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back. Cuts the
    lineage: a lost executor costs the running stage only."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], cols: list[str], how: str = "inner") -> DataFrame:
    """All of ``left`` and ``cols`` of ``right`` where the keys are equal, null with null."""
    on = F.expr(" AND ".join(f"_l.`{k}` <=> _r.`{k}`" for k in keys))
    return (left.alias("_l").join(right.alias("_r"), on, how)
            .select(*[F.col(f"_l.`{c}`") for c in left.columns], *[F.col(f"_r.`{c}`") for c in cols]))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def words_sql(col: str) -> str:
    """SQL for the array of words ``[^\\x20\\x09-\\x0D]+`` of a string column."""
    t = f"trim(BOTH {_WS_SQL} FROM coalesce({col}, ''))"
    return f"CASE WHEN {t} = '' THEN array() ELSE split({t}, '[\\\\x20\\\\x09-\\\\x0D]+') END"


def not_blank_sql(col: str) -> str:
    return f"trim(BOTH {_WS_SQL} FROM {col}) != ''"


def running_before(df: DataFrame, order: list[str], value: str, out: str,
                   keys: list[str] | None = None) -> DataFrame:
    """Add ``out`` = exact sum of ``value`` over all rows before this one in the
    global order ``keys + order`` (restarting at each new key), without one
    task per key or for the whole table.

    The rows are range-partitioned once and written to the shared folder with
    their partition number, so that both uses see the same split; partition
    totals (one row per partition and key that meets it) give the offsets.
    ``df`` must be narrow; rows equal in every order column may come in any order.
    """
    keys = keys or []
    cols = [F.col(c) for c in [*keys, *order]]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *cols).withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_pid", *keys).agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *keys, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    mine = ranged.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    j = join_keys(mine, offsets, ["_pid", *keys], ["_o"], "left").drop("_pid")     # one offset row per partition and key
    return j.withColumn(out, F.col("_in") + F.col("_o")).drop("_in", "_o")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table of longs: (node, comp)
    with comp = the smallest node. Large-star / small-star rounds, each one
    written to the shared folder; a star of any size is two grouped minima, so
    no node's neighbours meet in one row."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    e = written(e, "cc")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("_m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("_m").alias("v")))).alias("p"))
                 .select("p.u", "p.v").where("u != v").distinct())
        nxt = written(small, "cc")
        if _digest(nxt) == _digest(e):
            e = nxt
            break
        e = nxt
    else:
        raise RuntimeError("components did not settle")
    nodes = e.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return nodes.unionByName(roots.join(nodes, "node", "left_anti"))


def _digest(e: DataFrame):
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]
