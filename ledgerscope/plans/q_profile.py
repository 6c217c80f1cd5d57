"""B3 queries: the ledger profile."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import profile as P
from ..operators import sketches as SK
from ..operators.combine import join_null_safe
from ..sources.ledger import RAW_COLUMNS
from .catalog import features_table, ledger, r, register
from .q_features import with_features
from .sql import with_ledger

W = with_ledger()


def raw_ledger(spark, sf_dir):
    return ledger(spark, sf_dir).select(*RAW_COLUMNS)


def _null_sql():
    parts = []
    for c in RAW_COLUMNS:
        cond = f"{c} IS NULL" + (f" OR isnan({c})" if c in (
            "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest") else "")
        parts.append(f"count(CASE WHEN {cond} THEN 1 END) AS {c}")
    unp = " UNION ALL ".join(f"SELECT '{c}' AS column_name, cast({c} AS BIGINT) AS null_count FROM s"
                             for c in RAW_COLUMNS)
    total = " + ".join(RAW_COLUMNS)
    return (with_ledger(f"s AS (SELECT {', '.join(parts)} FROM ledger)") + unp +
            f" UNION ALL SELECT '_total', cast({total} AS BIGINT) FROM s")


@register("null_counts", _null_sql())
def null_counts(spark, sf_dir):
    """A1: null / NaN count per raw column and in total."""
    return P.null_counts(raw_ledger(spark, sf_dir))


DUP_KEYS = ["step", "type", "amount", "nameOrig", "nameDest", "oldbalanceOrg", "newbalanceOrig"]


@register("duplicate_counts", with_ledger(
    f"a AS (SELECT count(*) AS c FROM ledger GROUP BY {', '.join(RAW_COLUMNS)})",
    f"b AS (SELECT count(*) AS c FROM ledger GROUP BY {', '.join(DUP_KEYS)})") + """
SELECT cast((SELECT sum(c) FROM a) AS BIGINT) AS rows,
       cast((SELECT coalesce(sum(c - 1), 0) FROM a) AS BIGINT) AS duplicate_rows,
       cast((SELECT coalesce(sum(c - 1), 0) FROM b) AS BIGINT) AS duplicate_rows_on_key_subset""")
def duplicate_counts(spark, sf_dir):
    """A2: full-row duplicates and duplicates on the 7-column key subset."""
    return P.duplicate_counts(raw_ledger(spark, sf_dir), DUP_KEYS)


@register("type_counts", W + "SELECT type, count(*) AS n FROM ledger GROUP BY type")
def type_counts(spark, sf_dir):
    """A3: rows per transaction type."""
    return P.value_counts(ledger(spark, sf_dir), "type")


@register("entity_summary", W + """
SELECT count(DISTINCT nameOrig) AS unique_nameOrig, count(DISTINCT nameDest) AS unique_nameDest,
       count(DISTINCT step) AS n_steps, min(step) AS step_min, max(step) AS step_max FROM ledger""")
def entity_summary(spark, sf_dir):
    """A3: distinct entities and the step range."""
    return P.entity_summary(ledger(spark, sf_dir))


@register("prefix_counts", W + """
SELECT role, prefix, count(*) AS n FROM (
  SELECT 'nameOrig' AS role, substr(nameOrig, 1, 1) AS prefix FROM ledger
  UNION ALL SELECT 'nameDest', substr(nameDest, 1, 1) FROM ledger) GROUP BY role, prefix""")
def prefix_counts(spark, sf_dir):
    """A4: account-id prefix counts per role."""
    return P.prefix_counts(ledger(spark, sf_dir))


@register("accounts_both_roles", W + """
SELECT count(*) AS accounts_both_orig_and_dest FROM (
  SELECT nameOrig FROM ledger INTERSECT SELECT nameDest FROM ledger)""")
def accounts_both_roles(spark, sf_dir):
    """Ids seen as both origin and destination."""
    return P.accounts_both_roles(ledger(spark, sf_dir))


@register("class_balance", W + """
SELECT count(CASE WHEN isFraud = 0 THEN 1 END) AS n_legit, count(CASE WHEN isFraud = 1 THEN 1 END) AS n_fraud,
  round(count(CASE WHEN isFraud = 1 THEN 1 END) / count(*) * 100, 6) AS fraud_percentage,
  round(CASE WHEN count(CASE WHEN isFraud = 1 THEN 1 END) > 0 THEN
    count(CASE WHEN isFraud = 0 THEN 1 END) / count(CASE WHEN isFraud = 1 THEN 1 END) END, 1)
    AS imbalance_ratio_legit_to_fraud
FROM ledger""")
def class_balance(spark, sf_dir):
    """A5: class counts, percent, legit:fraud ratio."""
    return P.class_balance(ledger(spark, sf_dir))


@register("flag_audit", W + """
SELECT count(CASE WHEN isFlaggedFraud = 1 THEN 1 END) AS total_flagged,
  count(CASE WHEN isFlaggedFraud = 1 AND isFraud = 1 THEN 1 END) AS flagged_and_actually_fraud,
  count(CASE WHEN isFlaggedFraud = 1 AND isFraud = 0 THEN 1 END) AS flagged_but_not_fraud,
  count(CASE WHEN isFlaggedFraud = 0 AND isFraud = 1 THEN 1 END) AS fraud_but_not_flagged,
  round(CASE WHEN count(CASE WHEN isFraud = 1 THEN 1 END) > 0 THEN
    count(CASE WHEN isFlaggedFraud = 1 AND isFraud = 1 THEN 1 END) / count(CASE WHEN isFraud = 1 THEN 1 END) END, 6)
    AS recall_of_flag_on_fraud,
  min(CASE WHEN isFlaggedFraud = 1 THEN amount END) AS flagged_amount_min,
  max(CASE WHEN isFlaggedFraud = 1 THEN amount END) AS flagged_amount_max
FROM ledger""")
def flag_audit(spark, sf_dir):
    """The existing flag rule audited against the label."""
    return P.flag_audit(ledger(spark, sf_dir))


@register("flag_audit_types", W + "SELECT type, count(*) AS n FROM ledger WHERE isFlaggedFraud = 1 GROUP BY type")
def flag_audit_types(spark, sf_dir):
    """Types among flagged rows."""
    return P.value_counts(ledger(spark, sf_dir).where(F.col("isFlaggedFraud") == 1), "type")


FRAUD_BY_SQL = """
SELECT {k} AS {name}, count(*) AS total_txn, cast(sum(isFraud) AS BIGINT) AS fraud_txn,
  round(sum(isFraud) / count(*) * 100, 6) AS fraud_rate_pct
FROM ledger WHERE {k} IS NOT NULL GROUP BY {k}"""


@register("fraud_by_type", W + FRAUD_BY_SQL.format(k="type", name="type"))
def fraud_by_type(spark, sf_dir):
    """Fraud count and rate per type."""
    return P.fraud_by(ledger(spark, sf_dir), "type", "type")


@register("fraud_types", W + "SELECT DISTINCT type FROM ledger WHERE isFraud = 1")
def fraud_types(spark, sf_dir):
    """O1: types with any fraud."""
    return P.fraud_types(ledger(spark, sf_dir))


BUCKET_SQL = """CASE WHEN amount < 0 THEN NULL WHEN amount < 1000 THEN '0-1K' WHEN amount < 10000 THEN '1K-10K'
  WHEN amount < 50000 THEN '10K-50K' WHEN amount < 100000 THEN '50K-100K' WHEN amount < 200000 THEN '100K-200K'
  WHEN amount < 500000 THEN '200K-500K' WHEN amount < 1000000 THEN '500K-1M' ELSE '1M+' END"""


@register("fraud_by_amount_bucket", W + FRAUD_BY_SQL.format(k=BUCKET_SQL, name="amount_bucket"))
def fraud_by_amount_bucket(spark, sf_dir):
    """Fraud rate per right-open amount bucket."""
    return P.fraud_by(ledger(spark, sf_dir), X.amount_bucket(), "amount_bucket")


_Q_COLS = ", ".join(f"round(quantile_cont(amount, {p}), 6) AS {n}"
                    for p, n in zip(P.AMOUNT_PROBS, P.AMOUNT_PROB_NAMES))
AMOUNT_SUMMARY_SQL = """
SELECT {keys} round(min(amount), 6) AS min, round(max(amount), 6) AS max, round(avg(amount), 6) AS mean,
  round(stddev_samp(amount), 6) AS std, count(CASE WHEN amount = 0 THEN 1 END) AS zero_amount_count,
  round(quantile_cont(amount, 0.5), 6) AS median, """ + _Q_COLS + " FROM ledger {group}"


def _amount_summary_out(df):
    return df.select(*[r(c).alias(c) if c not in ("isFraud", "zero_amount_count") else F.col(c)
                       for c in df.columns])


@register("amount_summary", W + AMOUNT_SUMMARY_SQL.format(keys="", group=""))
def amount_summary(spark, sf_dir):
    """Amount distribution with exact interpolated percentiles."""
    return _amount_summary_out(P.amount_summary(ledger(spark, sf_dir)))


@register("amount_summary_by_class", W + AMOUNT_SUMMARY_SQL.format(keys="isFraud,", group="GROUP BY isFraud"))
def amount_summary_by_class(spark, sf_dir):
    """Amount distribution per class."""
    return _amount_summary_out(P.amount_summary(ledger(spark, sf_dir), ["isFraud"]))


@register("balance_patterns", with_ledger("""
e AS (SELECT *, abs(oldbalanceOrg - amount - newbalanceOrig) AS eo, abs(oldbalanceDest + amount - newbalanceDest) AS ed,
        oldbalanceOrg = 0 AND newbalanceOrig = 0 AND amount > 0 AS oz,
        oldbalanceDest = 0 AND newbalanceDest = 0 AND amount > 0 AS dz FROM ledger)""") + """
SELECT round(count(CASE WHEN eo < 0.01 THEN 1 END) / count(*) * 100, 4) AS orig_balance_exact_match_pct,
  round(count(CASE WHEN ed < 0.01 THEN 1 END) / count(*) * 100, 4) AS dest_balance_exact_match_pct,
  count(CASE WHEN oz THEN 1 END) AS orig_zero_pattern_count,
  coalesce(round(avg(CASE WHEN oz THEN isFraud END) * 100, 4), 0.0) AS orig_zero_pattern_fraud_rate_pct,
  count(CASE WHEN dz THEN 1 END) AS dest_zero_pattern_count,
  coalesce(round(avg(CASE WHEN dz THEN isFraud END) * 100, 4), 0.0) AS dest_zero_pattern_fraud_rate_pct,
  count(CASE WHEN eo > 0.01 THEN 1 END) AS orig_mismatch_count,
  round(avg(CASE WHEN eo > 0.01 THEN isFraud END) * 100, 4) AS orig_mismatch_fraud_rate_pct,
  count(CASE WHEN ed > 0.01 THEN 1 END) AS dest_mismatch_count,
  round(avg(CASE WHEN ed > 0.01 THEN isFraud END) * 100, 4) AS dest_mismatch_fraud_rate_pct,
  round(avg(isFraud) * 100, 4) AS overall_fraud_rate_pct
FROM e""")
def balance_patterns(spark, sf_dir):
    """Balance-formula matches and zero / mismatch patterns."""
    return P.balance_patterns(ledger(spark, sf_dir))


@register("zero_balances", W + """
SELECT count(CASE WHEN oldbalanceOrg = 0 THEN 1 END) AS oldbalanceOrg_zero,
  count(CASE WHEN newbalanceOrig = 0 THEN 1 END) AS newbalanceOrig_zero,
  count(CASE WHEN oldbalanceDest = 0 THEN 1 END) AS oldbalanceDest_zero,
  count(CASE WHEN newbalanceDest = 0 THEN 1 END) AS newbalanceDest_zero,
  round(CASE WHEN count(CASE WHEN isFraud = 1 THEN 1 END) > 0 THEN
    count(CASE WHEN isFraud = 1 AND newbalanceOrig = 0 AND oldbalanceOrg > 0 THEN 1 END)
    / count(CASE WHEN isFraud = 1 THEN 1 END) * 100 END, 2) AS fraud_drains_origin_to_zero_pct
FROM ledger""")
def zero_balances(spark, sf_dir):
    """Zero-balance counts and the fraud drain rate."""
    return P.zero_balances(ledger(spark, sf_dir))


PER_STEP_CTE = """ps AS (
  SELECT step, count(*) AS txn_count, cast(sum(isFraud) AS BIGINT) AS fraud_count,
         sum(amount) AS total_amount, avg(amount) AS avg_amount, sum(isFraud) / count(*) * 100 AS fraud_rate_pct
  FROM ledger GROUP BY step)"""


def _per_step(spark, sf_dir):
    return P.per_step(ledger(spark, sf_dir))


@register("per_step_profile", with_ledger(PER_STEP_CTE) + """
SELECT step, txn_count, fraud_count, round(total_amount, 4) AS total_amount, round(avg_amount, 6) AS avg_amount,
       round(fraud_rate_pct, 6) AS fraud_rate_pct FROM ps""")
def per_step_profile(spark, sf_dir):
    """Per-step counts, totals and fraud rate."""
    s = _per_step(spark, sf_dir)
    return s.select("step", "txn_count", "fraud_count", r("total_amount", 4).alias("total_amount"),
                    r("avg_amount").alias("avg_amount"), r("fraud_rate_pct").alias("fraud_rate_pct"))


@register("per_step_distribution", with_ledger(PER_STEP_CTE) + """
SELECT min(txn_count) AS txn_count_min, max(txn_count) AS txn_count_max,
  round(avg(txn_count), 2) AS txn_count_mean, round(stddev_samp(txn_count), 2) AS txn_count_std,
  round(min(fraud_rate_pct), 4) AS fraud_rate_min, round(max(fraud_rate_pct), 4) AS fraud_rate_max,
  round(avg(fraud_rate_pct), 4) AS fraud_rate_mean, round(stddev_samp(fraud_rate_pct), 4) AS fraud_rate_std,
  count(CASE WHEN fraud_count = 0 THEN 1 END) AS steps_with_zero_fraud FROM ps""")
def per_step_distribution(spark, sf_dir):
    """Distribution of the per-step values."""
    return P.per_step_distribution(_per_step(spark, sf_dir))


@register("top_steps", with_ledger(PER_STEP_CTE) + """
SELECT * FROM (
  SELECT 'fraud_rate' AS ranking, row_number() OVER (ORDER BY fraud_rate_pct DESC, step) AS rank, step, txn_count,
         fraud_count, round(fraud_rate_pct, 6) AS fraud_rate_pct FROM ps
  UNION ALL
  SELECT 'fraud_count', row_number() OVER (ORDER BY fraud_count DESC, step), step, txn_count, fraud_count,
         round(fraud_rate_pct, 6) FROM ps
  UNION ALL
  SELECT 'txn_volume', row_number() OVER (ORDER BY txn_count DESC, step), step, txn_count, fraud_count,
         round(fraud_rate_pct, 6) FROM ps) WHERE rank <= 10""")
def top_steps(spark, sf_dir):
    """K1: top 10 steps by fraud rate, fraud count, volume."""
    return P.top_steps(_per_step(spark, sf_dir))


@register("hourly_profile", with_ledger(PER_STEP_CTE) + """
SELECT cast(step % 24 AS INT) AS hour_of_day, cast(sum(txn_count) AS BIGINT) AS total_txn,
  cast(sum(fraud_count) AS BIGINT) AS total_fraud, round(sum(fraud_count) / sum(txn_count) * 100, 4) AS fraud_rate_pct
FROM ps GROUP BY step % 24""")
def hourly_profile(spark, sf_dir):
    """Hour-of-day profile."""
    return P.hourly_profile(_per_step(spark, sf_dir))


NAIVE_CTE = """th AS (
  SELECT avg(fraud_rate_pct) + 2 * stddev_samp(fraud_rate_pct) AS fr_t, avg(txn_count) + 2 * stddev_samp(txn_count) AS vol_t
  FROM ps)"""


@register("naive_spike_summary", with_ledger(PER_STEP_CTE, NAIVE_CTE) + """
SELECT round(fr_t, 4) AS fraud_rate_threshold_mean_plus_2std,
  (SELECT count(*) FROM ps WHERE fraud_rate_pct > fr_t) AS n_steps_flagged_as_fraud_spike,
  round(vol_t, 2) AS volume_threshold_mean_plus_2std,
  (SELECT count(*) FROM ps WHERE txn_count > vol_t) AS n_steps_flagged_as_volume_spike
FROM th""")
def naive_spike_summary(spark, sf_dir):
    """Mean + 2 std thresholds and flagged-step counts."""
    return P.naive_spikes(_per_step(spark, sf_dir))[0]


@register("naive_spike_steps", with_ledger(PER_STEP_CTE, NAIVE_CTE) + """
SELECT kind, step, rank FROM (
  SELECT kind, step, row_number() OVER (PARTITION BY kind ORDER BY step) AS rank FROM (
    SELECT 'fraud_rate' AS kind, step FROM ps, th WHERE fraud_rate_pct > fr_t
    UNION ALL SELECT 'volume', step FROM ps, th WHERE txn_count > vol_t))""")
def naive_spike_steps(spark, sf_dir):
    """K3: the flagged steps per kind, ranked by step."""
    return P.naive_spikes(_per_step(spark, sf_dir))[1]


@register("entity_reuse", with_ledger(
    "o AS (SELECT nameOrig, count(*) AS c FROM ledger GROUP BY nameOrig)",
    "d AS (SELECT nameDest, count(*) AS c FROM ledger GROUP BY nameDest)") + """
SELECT (SELECT count(CASE WHEN c > 1 THEN 1 END) FROM o) AS nameOrig_appears_more_than_once,
  (SELECT max(c) FROM o) AS nameOrig_max_txn_count,
  (SELECT round(count(CASE WHEN c = 1 THEN 1 END) / count(*) * 100, 2) FROM o) AS nameOrig_single_txn_pct,
  (SELECT count(CASE WHEN c > 1 THEN 1 END) FROM d) AS nameDest_appears_more_than_once,
  (SELECT max(c) FROM d) AS nameDest_max_txn_count,
  (SELECT round(count(CASE WHEN c > 1 THEN 1 END) / count(*) * 100, 2) FROM d) AS nameDest_repeat_pct""")
def entity_reuse(spark, sf_dir):
    """Id reuse for origins and destinations."""
    return P.entity_reuse(ledger(spark, sf_dir))


@register("top_destinations", W + """
SELECT nameDest, txn_count, rank FROM (
  SELECT nameDest, count(*) AS txn_count, row_number() OVER (ORDER BY count(*) DESC, nameDest) AS rank
  FROM ledger GROUP BY nameDest) WHERE rank <= 10""")
def top_destinations(spark, sf_dir):
    """K2: the 10 busiest destinations."""
    return P.top_destinations(ledger(spark, sf_dir))


def _features(spark, sf_dir):
    return features_table(spark, sf_dir)


@register("drained_rate_by_class", with_features() + """
SELECT isFraud, round(avg(drained_to_zero) * 100, 6) AS drained_to_zero_rate_pct FROM feat GROUP BY isFraud""")
def drained_rate_by_class(spark, sf_dir):
    """Drained-to-zero rate per class."""
    return P.flag_rate_by_class(ledger(spark, sf_dir).withColumn("drained_to_zero", X.drained_to_zero()))


@register("high_amount_rate_by_type_class", with_features() + """
SELECT type, round(avg(CASE WHEN isFraud = 0 THEN high_amount_indicator END) * 100, 6) AS legit_rate_pct,
  round(avg(CASE WHEN isFraud = 1 THEN high_amount_indicator END) * 100, 6) AS fraud_rate_pct
FROM feat GROUP BY type""")
def high_amount_rate_by_type_class(spark, sf_dir):
    """High-amount rate by type, pivoted on class."""
    return P.flag_rate_by_type_class(_features(spark, sf_dir))


def _hist_sql(value_sql: str, bins: int, src: str = "ledger") -> str:
    return f"""
v AS (SELECT isFraud AS cls, {value_sql} AS v FROM {src}),
rg AS (SELECT cls, min(v) AS lo, max(v) AS hi, count(*) AS n_class FROM v GROUP BY cls),
cn AS (
  SELECT v.cls, cast(CASE WHEN hi > lo THEN least({bins - 1}, floor((v - lo) / (hi - lo) * {bins})) ELSE 0 END AS INT) AS bin,
         count(*) AS n
  FROM v JOIN rg USING (cls) GROUP BY ALL),
g AS (SELECT cls, lo, hi, n_class, cast(unnest(range(0, {bins})) AS INT) AS bin FROM rg)""", f"""
SELECT g.cls AS isFraud, g.bin, round(lo + g.bin * (hi - lo) / {bins}, 6) AS bin_lo,
  round(lo + (g.bin + 1) * (hi - lo) / {bins}, 6) AS bin_hi, cast(coalesce(n, 0) AS BIGINT) AS n,
  round(CASE WHEN hi > lo THEN coalesce(n, 0) / (n_class * (hi - lo) / {bins}) END, 6) AS density
FROM g LEFT JOIN cn USING (cls, bin)"""


def _hist_out(df):
    return df.select("isFraud", "bin", r("bin_lo").alias("bin_lo"), r("bin_hi").alias("bin_hi"), "n",
                     r("density").alias("density"))


_h1 = _hist_sql("ln(1 + amount)", 80)


@register("log_amount_histogram", with_ledger(_h1[0]) + _h1[1])
def log_amount_histogram(spark, sf_dir):
    """80-bin density histogram of log1p(amount) per class."""
    return _hist_out(P.class_histogram(ledger(spark, sf_dir), F.log1p("amount"), 80))


_h2 = _hist_sql("ln(1 + hist_dest_txn_count)", 40, "feat")


@register("dest_history_histogram", with_features(_h2[0]) + _h2[1])
def dest_history_histogram(spark, sf_dir):
    """40-bin density histogram of log1p(prior destination count) per class."""
    from ..operators import history as H
    feats = H.prior_history(ledger(spark, sf_dir))
    return _hist_out(P.class_histogram(feats, F.log1p("hist_dest_txn_count"), 40))


_LEVELS = """l AS (
  SELECT 'step' AS level, cast(step AS bigint) AS key, nameOrig, nameDest, amount FROM ledger
  UNION ALL SELECT 'day', cast(floor((step - 1) / 24) AS bigint), nameOrig, nameDest, amount FROM ledger
  UNION ALL SELECT 'all', NULL, nameOrig, nameDest, amount FROM ledger)"""


@register("sketched_entities", with_ledger(_LEVELS) + """
SELECT level, key, count(DISTINCT nameOrig) AS origins, count(DISTINCT nameDest) AS destinations, count(amount) AS amounts,
  true AS origins_near, true AS destinations_near, true AS median_near FROM l GROUP BY level, key""")
def sketched_entities(spark, sf_dir):
    """A3, A8 by sketches: per step, united to days and to the whole ledger, and
    whether the estimates are within their bounds of the exact figures beside
    them (distinct counts by relative error, the median by its rank)."""
    df = raw_ledger(spark, sf_dir).withColumn("day", F.expr("cast(floor((step - 1) / 24) AS bigint)")).withColumn("step", F.col("step").cast("long"))
    steps = SK.step_sketches(df, ["nameOrig", "nameDest"], "amount", ("day", "step"))
    days = SK.union(steps, ["day"])
    levels = [("step", steps.withColumn("key", F.col("step"))), ("day", days.withColumn("key", F.col("day"))),
              ("all", SK.union(days, []).withColumn("key", F.lit(None).cast("long")))]
    near = None
    for name, d in levels:
        d = d.select(F.lit(name).alias("level"), "key", SK.distinct("nameOrig").alias("o"), SK.distinct("nameDest").alias("d"), SK.quantile("amount", 0.5).alias("m"))
        near = d if near is None else near.unionByName(d)
    at = F.expr("explode(array(named_struct('level', 'step', 'key', step), named_struct('level', 'day', 'key', day), named_struct('level', 'all', 'key', cast(null AS bigint))))")
    rows = df.select("nameOrig", "nameDest", "amount", at.alias("at")).select("at.*", "nameOrig", "nameDest", "amount")
    # the exact figures, for comparison only
    origins = rows.groupBy("level", "key", "nameOrig").agg(F.lit(1).alias("one")).groupBy("level", "key").agg(F.count("nameOrig").alias("origins"))
    dests = rows.groupBy("level", "key", "nameDest").agg(F.lit(1).alias("one")).groupBy("level", "key").agg(F.count("nameDest").alias("destinations"))
    ranks = join_null_safe(rows.select("level", "key", "amount"), near, ["level", "key"], "inner").groupBy("level", "key").agg(
        F.count("amount").alias("amounts"), F.count(F.expr("CASE WHEN amount <= m THEN 1 END")).alias("upto"),
        F.count(F.expr("CASE WHEN amount < m THEN 1 END")).alias("below"))
    out = near
    for exact in (origins, dests, ranks):
        out = join_null_safe(out, exact, ["level", "key"], "inner")
    e = SK.distinct_error()
    return out.select("level", "key", "origins", "destinations", "amounts", F.expr(f"abs(o - origins) <= {e} * origins").alias("origins_near"),
                      F.expr(f"abs(d - destinations) <= {e} * destinations").alias("destinations_near"),
                      F.expr("amounts = 0 OR (below <= 0.53 * amounts AND upto >= 0.47 * amounts)").alias("median_near"))
