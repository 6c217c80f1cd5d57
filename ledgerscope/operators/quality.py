"""Data-quality suite over the engineered table (Q-1..Q-10).

Each check is one aggregate (or one per-row expression for Q-10). Q-7 unpivots
the audited columns with ``stack`` and computes every single-feature ROC-AUC in
one job keyed by feature.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from . import metrics as M
from .combine import side_by_side

# Columns each check covers.
BINARY_FLAGS = ["drained_to_zero", "origin_balance_zero_before", "dest_balance_artifact_flag",
                "is_transfer", "is_cash_out", "eligible_for_fraud_model", "destination_is_new",
                "high_amount_indicator", "isFraud", "isFlaggedFraud"]
RANGE_COLUMNS = ["log_amount", "balance_change_orig", "balance_error_orig", "amount_to_origin_balance_ratio",
                 "balance_change_dest", "balance_error_dest", "hour_sin", "hour_cos", "hist_dest_txn_count",
                 "hist_dest_unique_origin_count", "hist_dest_total_amount", "hist_dest_avg_amount",
                 "hist_dest_max_amount", "amount_to_dest_avg_ratio", "amount_to_type_avg_ratio"]
RATIO_COLUMNS = ["amount_to_origin_balance_ratio", "amount_to_dest_avg_ratio", "amount_to_type_avg_ratio"]
LEAKAGE_COLUMNS = ["amount", "drained_to_zero", "amount_to_origin_balance_ratio", "is_transfer", "is_cash_out",
                   "high_amount_indicator", "hist_dest_txn_count", "amount_to_dest_avg_ratio",
                   "dest_balance_artifact_flag", "isFlaggedFraud"]
MONEY_COLUMNS = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]


def row_counts(raw: DataFrame, engineered: DataFrame) -> DataFrame:
    """Q-1: engineered rows equal raw rows (two counts, one row)."""
    a = raw.agg(F.count(F.lit(1)).alias("raw_rows"))
    b = engineered.agg(F.count(F.lit(1)).alias("engineered_rows"))
    return side_by_side(a, b).withColumn("match", F.col("raw_rows") == F.col("engineered_rows"))


def null_inf_counts(df: DataFrame) -> DataFrame:
    """Q-2: nulls/NaN and infinities per numeric column, one pass."""
    num = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    aggs = []
    for f in num:
        c = F.col(f.name)
        isfloat = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        aggs.append(F.count(F.when(c.isNull() | (F.isnan(c) if isfloat else F.lit(False)), 1)).alias(f"n_{f.name}"))
        aggs.append((F.count(F.when(F.abs(c) == float("inf"), 1)) if isfloat else F.lit(None).cast("long"))
                    .alias(f"i_{f.name}"))
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.col(f"n_{f.name}").alias("null_count"),
                 F.col(f"i_{f.name}").alias("inf_count")) for f in num])).alias("s")).select("s.*")


def negative_counts(df: DataFrame) -> DataFrame:
    """Q-3: impossible negative money values."""
    return df.agg(*[F.count(F.when(F.col(c) < 0, 1)).alias(f"negative_{c}") for c in MONEY_COLUMNS])


def categorical_checks(df: DataFrame) -> DataFrame:
    """Q-4: type domain, hour/day ranges, flags are 0/1 (O3: subset test)."""
    flags = [F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(True)).alias(f"{c}_is_binary") for c in BINARY_FLAGS]
    return df.agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("type_categories"),
                  F.min("hour_of_day").alias("hour_min"), F.max("hour_of_day").alias("hour_max"),
                  F.min("day_index").alias("day_min"), F.max("day_index").alias("day_max"),
                  F.bool_and(F.col("type").isin(*X.VALID_TYPES)).alias("types_in_domain"), *flags)


def feature_ranges(df: DataFrame, cols: list[str] = RANGE_COLUMNS) -> DataFrame:
    """Q-5: min / max / mean per feature, one pass, unpivoted."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").alias(f"mn_{c}"), F.max(c).cast("double").alias(f"mx_{c}"),
                 F.avg(c).alias(f"av_{c}")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"mn_{c}").alias("min"), F.col(f"mx_{c}").alias("max"),
                 F.col(f"av_{c}").alias("mean")) for c in cols])).alias("s")).select("s.*")


def ratio_caps(df: DataFrame, cap: float = X.RATIO_CAP) -> DataFrame:
    """Q-6: every ratio stays <= the cap."""
    return df.agg(*[(F.max(c) <= cap).alias(f"{c}_max_le_{int(cap)}") for c in RATIO_COLUMNS])


def unpivot(df: DataFrame, cols: list[str], label: str = "isFraud") -> DataFrame:
    """(feature, value, label) rows via ``stack``."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in cols)
    return df.select(F.col(label), F.expr(f"stack({len(cols)}, {pairs}) as (feature, value)"))


def single_feature_auc(df: DataFrame, cols: list[str] = LEAKAGE_COLUMNS, label: str = "isFraud") -> DataFrame:
    """Q-7: ROC-AUC of each raw column as a score for the label (ties half)."""
    long = unpivot(df, cols, label).withColumnRenamed("value", "score")
    cv = M.curve(long, label, "score", keys=["feature"])
    return M.ranking_metrics(cv, keys=["feature"]).select("feature", F.round("roc_auc", 6).alias("auc"))


def label_reconciliation(steps: DataFrame, txns: DataFrame) -> DataFrame:
    """Q-9: the step table's fraud total equals the transactions'."""
    a = steps.agg(F.sum("gt_fraud_count").cast("long").alias("step_table_fraud"), F.count(F.lit(1)).alias("steps"))
    b = txns.agg(F.sum("isFraud").cast("long").alias("transaction_fraud"))
    return side_by_side(a, b).withColumn("match", F.col("step_table_fraud") == F.col("transaction_fraud"))


# ------------------------------------------------------------------ Q-10
# Required request fields, the optional ones and their defaults.
REQUIRED_FIELDS = ["step", "type", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
OPTIONAL_DEFAULTS = {"hist_dest_txn_count": 0, "hist_dest_unique_origin_count": 0,
                     "hist_dest_total_amount": 0.0, "hist_dest_avg_amount": 0.0, "hist_dest_max_amount": 0.0}
BALANCE_FIELDS = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
TYPE_LIST_TEXT = "['CASH_IN', 'CASH_OUT', 'DEBIT', 'PAYMENT', 'TRANSFER']"
TYPE_LIST_SQL = TYPE_LIST_TEXT.replace("'", "\\'")     # the same text inside a SQL string literal


INF = "cast('Infinity' as double)"


def _finite_sql(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) != {INF})"


def validate(df: DataFrame) -> DataFrame:
    """Q-10: every problem of every request row, as ``errors: array<string>``,
    plus the cleaned typed fields ``clean_*`` (null where invalid) and
    ``is_valid``. Rules: the 7 required fields present; step >= 1, as text a whole
    number ('5', not '5.0'), as a number its whole part (5.7 is 5);
    type, after trim + upper, one of the 5 types; amount and balances finite
    and >= 0; optional history defaulted to 0. Pure SQL expressions, no UDF."""
    cols = set(df.columns)

    def is_str(n):
        return n in cols and isinstance(df.schema[n].dataType, T.StringType)

    def raw(n):
        return f"`{n}`" if n in cols else "CAST(NULL AS STRING)"

    def dbl(n):
        if is_str(n):
            return f"try_cast(trim(`{n}`) AS double)"
        return f"CAST(`{n}` AS double)" if n in cols else "CAST(NULL AS double)"

    def shown(n):
        return f"concat('\\'', `{n}`, '\\'')" if is_str(n) else f"CAST({raw(n)} AS string)"

    missing = ", ".join(f"CASE WHEN {raw(f)} IS NULL THEN '{f}' END" for f in REQUIRED_FIELDS)
    miss = f"filter(array({missing}), x -> x IS NOT NULL)"
    errs = [f"CASE WHEN size({miss}) > 0 THEN concat('missing required field(s): ', array_join({miss}, ', ')) END"]
    sd = f"floor({dbl('step')})"
    whole = "trim(`step`) rlike '^[+-]?[0-9]+$'" if is_str("step") else _finite_sql(dbl("step"))
    errs.append(f"""CASE WHEN {raw('step')} IS NOT NULL AND NOT ({whole})
                     THEN concat('invalid step: ', {shown('step')}, ' (must be an integer)')
                     WHEN {raw('step')} IS NOT NULL AND {sd} < 1
                     THEN concat('invalid step: ', CAST({raw('step')} AS string), ' (must be >= 1)')
                     WHEN {raw('step')} IS NOT NULL AND {dbl('step')} > 2147483647
                     THEN concat('invalid step: ', CAST({raw('step')} AS string), ' (must be <= 2147483647)') END""")
    tn = f"upper(trim(CAST({raw('type')} AS string)))"
    types = ", ".join(f"'{t}'" for t in X.VALID_TYPES)
    errs.append(f"CASE WHEN {raw('type')} IS NOT NULL AND NOT {tn} IN ({types}) THEN concat("
                f"'unknown transaction type: ', {shown('type')}, ' (must be one of {TYPE_LIST_SQL})') END")
    for f in ["amount"] + BALANCE_FIELDS:
        v = dbl(f)
        errs.append(f"""CASE WHEN {raw(f)} IS NOT NULL AND NOT {_finite_sql(v)}
                         THEN concat('invalid {f}: ', {shown(f)}, ' (must be a finite number)')
                         WHEN {raw(f)} IS NOT NULL AND {v} < 0
                         THEN concat('invalid {f}: ', {shown(f)}, ' (must be >= 0)') END""")
    out = df.selectExpr("*", f"filter(array({', '.join(errs)}), x -> x IS NOT NULL) AS errors")
    clean = ["size(errors) = 0 AS is_valid",
             f"CASE WHEN size(errors) = 0 THEN try_cast({sd} AS int) END AS clean_step",
             f"CASE WHEN size(errors) = 0 THEN {tn} END AS clean_type"]
    for f in ["amount"] + BALANCE_FIELDS:
        clean.append(f"CASE WHEN size(errors) = 0 THEN {dbl(f)} END AS clean_{f}")
    for f, d in OPTIONAL_DEFAULTS.items():
        typ = "bigint" if isinstance(d, int) else "double"
        src = f"try_cast(`{f}` AS {typ})" if f in cols else f"CAST(NULL AS {typ})"
        clean.append(f"CASE WHEN size(errors) = 0 THEN coalesce({src}, CAST({d} AS {typ})) END AS clean_{f}")
    return out.selectExpr("*", *clean)


def quarantine(requests: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Q-10 as two sinks of one scan: every request is validated once and goes to
    the folder ``is_valid=true`` or ``is_valid=false`` under ``path`` with all its
    errors. The counts are taken from the written files, by folder, so requests
    are not validated again for them; an ``Observation`` would leave its manager in
    the session, which closures of fitted models then fail to serialise. Returns
    (valid, refused, {'valid': n, 'refused': n})."""
    out = validate(requests)
    out.write.partitionBy("is_valid").parquet(path)
    back = requests.sparkSession.read.schema(out.schema).parquet(path)
    n = {r["is_valid"]: r["count"] for r in back.groupBy("is_valid").count().collect()}
    return back.where("is_valid"), back.where("NOT is_valid"), {"valid": n.get(True, 0), "refused": n.get(False, 0)}
