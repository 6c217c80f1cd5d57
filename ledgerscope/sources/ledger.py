"""Ledger sources: the raw-ledger schema, a CSV reader, and ledger views
derived by Spark from the supplied tables (``events``, ``lineitem``/``orders``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw ledger's 11 columns and types.
LEDGER_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.IntegerType()),
    T.StructField("isFlaggedFraud", T.IntegerType()),
])
RAW_COLUMNS = [f.name for f in LEDGER_SCHEMA.fields]

# Epoch of hour 1 of the events ledger (2024-01-01 00:00 UTC).
EVENTS_EPOCH_S = 1704067200
# The lineitem ledger counts days from this date.
LINEITEM_DAY0 = "1995-01-01"


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """Read a ledger CSV with the explicit schema (never inferred)."""
    return spark.read.schema(LEDGER_SCHEMA).option("header", True).csv(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one supplied parquet table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _mod(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n))


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger view over ``events``: one hourly ``step`` per event hour since
    2024-01-01, event type -> transaction type, user -> origin, ``props.k`` ->
    destination, ``value`` -> amount; balances and labels are arithmetic on
    ``event_id`` and the hour (invented fixture values)."""
    ev = read_table(spark, sf_dir, "events")
    epoch_s = F.unix_seconds(F.col("ts").cast("timestamp"))
    step = (F.floor((epoch_s - F.lit(EVENTS_EPOCH_S)) / 3600).cast("int") + 1)
    k = F.get_json_object("props", "$.k")
    eid = F.col("event_id")
    et = F.col("event_type")
    v = F.col("value")
    m5 = _mod(eid, 5)
    m7 = _mod(eid, 7)
    no_dest_bal = (et == "purchase") | (m7 == 0)
    fraud = (et.isin("click", "error")
             & ((m5.isin(1, 2) & m7.isin(0, 3)) | (_mod(step, 29) == 0)))
    return ev.select(
        eid.alias("event_id"),
        step.alias("step"),
        F.when(et == "purchase", "PAYMENT").when(et == "view", "CASH_IN")
         .when(et == "click", "CASH_OUT").when(et == "signup", "DEBIT")
         .otherwise("TRANSFER").alias("type"),
        v.alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        F.when(et == "purchase", F.concat(F.lit("M"), k))
         .otherwise(F.concat(F.lit("C"), k)).alias("nameDest"),
        F.when(m5 == 0, F.lit(0.0)).when(m5.isin(1, 2), v).otherwise(v * 4).alias("oldbalanceOrg"),
        F.when(m5.isin(0, 1, 2), F.lit(0.0)).otherwise(v * 4 - v).alias("newbalanceOrig"),
        F.when(no_dest_bal, F.lit(0.0)).otherwise(v * 2).alias("oldbalanceDest"),
        F.when(no_dest_bal, F.lit(0.0)).otherwise(v * 2 + v).alias("newbalanceDest"),
        F.when(fraud, 1).otherwise(0).cast("int").alias("isFraud"),
        F.when((et == "error") & (v > 200), 1).otherwise(0).cast("int").alias("isFlaggedFraud"),
    )


def lineitem_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavier ledger over ``lineitem`` joined to ``orders``: supplier is the
    destination, customer the origin, ``step`` = days since 1995-01-01.
    Only the columns the history jobs need (no balances, no label)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    ln = _mod(F.col("l_linenumber").cast("int"), 5)
    return j.select(
        F.col("l_orderkey").alias("k"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit(LINEITEM_DAY0).cast("date")).alias("step"),
        F.when(ln == 0, "PAYMENT").when(ln == 1, "TRANSFER").when(ln == 2, "CASH_OUT")
         .when(ln == 3, "CASH_IN").otherwise("DEBIT").alias("type"),
        F.col("l_extendedprice").alias("amount"),
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("nameOrig"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("nameDest"),
    )
