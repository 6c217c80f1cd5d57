"""Modelling universe and chronological split."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


@dataclass(frozen=True)
class Split:
    """Inclusive step ranges. Defaults fit the 720-step events ledger; the test
    range has an open end, so later steps of a longer ledger are test rows."""
    train: tuple[int, int] = (1, 504)
    val: tuple[int, int] = (505, 611)
    test: tuple[int, int] = (612, 2**31 - 1)


DEFAULT_SPLIT = Split()


def split_col(split: Split = DEFAULT_SPLIT, step: str = "step"):
    s = F.col(step)
    return (F.when(s.between(*split.train), "train").when(s.between(*split.val), "val")
             .when(s.between(*split.test), "test"))


def modelling_universe(df: DataFrame) -> DataFrame:
    """TRANSFER and CASH_OUT only (pushed down to the scan as an IN filter)."""
    return df.where(F.col("type").isin(*X.MODEL_TYPES))


def with_split(df: DataFrame, split: Split = DEFAULT_SPLIT) -> DataFrame:
    """one ``split`` column; rows outside every range get null."""
    return df.withColumn("split", split_col(split))


def split_report(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """Rows, positives, rate and imbalance per split."""
    n = F.count(F.lit(1))
    f = F.sum(F.col(label)).cast("long")
    return (df.where(F.col("split").isNotNull()).groupBy("split")
              .agg(n.alias("rows"), f.alias("fraud_rows"))
              .withColumn("fraud_rate_pct", F.round(F.when(F.col("rows") > 0,
                                                           F.col("fraud_rows") / F.col("rows") * 100), 6))
              .withColumn("imbalance_ratio", F.round(F.when(F.col("fraud_rows") > 0,
                                                            (F.col("rows") - F.col("fraud_rows")) / F.col("fraud_rows")), 1)))


def restriction_audit(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """A24 / Q-8: what the restriction to the modelling universe keeps."""
    el = F.col("type").isin(*X.MODEL_TYPES)
    y = F.col(label) == 1
    n, nf = F.count(F.lit(1)), F.count(F.when(y, 1))
    rn, rf = F.count(F.when(el, 1)), F.count(F.when(el & y, 1))
    return df.agg(
        n.alias("all_types_rows"), nf.alias("all_types_fraud_rows"),
        F.round(nf / n * 100, 6).alias("all_types_fraud_pct"),
        rn.alias("restricted_rows"), rf.alias("restricted_fraud_rows"),
        F.round(F.when(rn > 0, rf / rn * 100), 6).alias("restricted_fraud_pct"),
        F.round(F.when(nf > 0, rf / nf * 100), 4).alias("pct_of_all_fraud_retained_in_restricted"),
        F.round((1 - rn / n) * 100, 2).alias("row_reduction_pct"),
        (rf == nf).alias("all_fraud_retained"))


def assert_no_fraud_lost(audit: DataFrame) -> None:
    """A24's guard: the restriction must keep every positive."""
    row = audit.select("all_fraud_retained", "all_types_fraud_rows", "restricted_fraud_rows").first()
    if not row["all_fraud_retained"]:
        raise AssertionError(f"restriction lost fraud rows: {row['restricted_fraud_rows']} of "
                             f"{row['all_types_fraud_rows']} kept")
