"""Batch decisions (E2-E10, J4, T6, K4): a DataFrame of scoring requests in,
one decision record per request out. The reference scores one dict at a time;
here every stage is a column expression or a bounded broadcast join, so the
same code scores millions of requests.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import phrases as PH
from . import quality as Q
from .train import FEATURES

# Published operating modes (mode -> threshold), default mode,
# band -> action, and the reason added when a LOW score falls in a spike step.
DEFAULT_MODES = [("HIGH_RECALL", 0.43), ("BALANCED", 0.43), ("HIGH_PRECISION", 0.17)]
DEFAULT_MODE = "BALANCED"
BAND_ACTION = {"LOW": "ALLOW", "MEDIUM": "REVIEW", "HIGH": "REVIEW"}
SPIKE_REASON = ("transaction occurred during a step flagged by the spike-detection layer as an "
                "elevated-risk time window")
TOP_N = 3


def modes_table(spark: SparkSession, points: DataFrame | None = None) -> DataFrame:
    """Mode -> threshold. From the M11 operating points when given (one
    copy of the thresholds), else the published defaults. Three rows."""
    if points is not None:
        return points.select(F.upper("mode").alias("mode"), F.col("threshold").cast("double").alias("threshold"))
    return spark.createDataFrame(DEFAULT_MODES, "mode string, threshold double")


def band_bounds(modes: DataFrame) -> tuple[float, float]:
    """E4 boundaries: HIGH from the BALANCED threshold, MEDIUM from HIGH_PRECISION."""
    m = {r["mode"]: r["threshold"] for r in modes.collect()}     # three rows
    return float(m["BALANCED"]), float(m["HIGH_PRECISION"])


def risk_band(score: Column, high: float, medium: float) -> Column:
    """>= high -> HIGH, >= medium -> MEDIUM, else LOW."""
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def band_action(band: Column) -> Column:
    """E5: LOW -> ALLOW, MEDIUM/HIGH -> REVIEW."""
    expr = None
    for b, a in BAND_ACTION.items():
        expr = F.when(band == b, a) if expr is None else expr.when(band == b, a)
    return expr


def with_mode(df: DataFrame, modes: DataFrame, mode_col: str = "mode") -> DataFrame:
    """Case-insensitive mode (default BALANCED) and its threshold (null if
    unknown). The mode table is three rows: broadcast."""
    m = F.upper(F.coalesce(F.col(mode_col), F.lit(DEFAULT_MODE))) if mode_col in df.columns else F.lit(DEFAULT_MODE)
    out = df.withColumn("mode", m)
    # the mode table is the three operating points: a CASE over its rows
    # (no join, so a constant mode is not turned into a nested-loop join)
    thr = None
    for row in modes.collect():
        hit = F.col("mode") == F.lit(row["mode"])
        v = F.lit(row["threshold"]).cast("double")
        thr = F.when(hit, v) if thr is None else thr.when(hit, v)
    return out.withColumn("threshold_used", thr if thr is not None else F.lit(None).cast("double"))


def online_features(clean: DataFrame, frozen: DataFrame) -> DataFrame:
    """The 23 features for requests validated by Q-10 (``clean_*``):
    history from the request (default 0), type mean and p95 from the frozen
    per-type table (at most 5 rows, broadcast) instead of expanding values."""
    names = ["step", "type", "amount", *Q.BALANCE_FIELDS, *Q.OPTIONAL_DEFAULTS]
    keep = [c for c in clean.columns if c not in names]
    base = clean.select(*keep, *[F.col(f"clean_{c}").alias(c) for c in names])
    f = X.with_basic_features(base)
    f = (f.withColumn("destination_is_new", X.destination_is_new())
          .withColumn("amount_to_dest_avg_ratio", X.amount_to_dest_avg_ratio()))
    fz = F.broadcast(frozen.select("type", F.col("mean_amount").alias("_tavg"), F.col("p95_amount").alias("_p95")))
    f = f.join(fz, "type", "left")
    f = (f.withColumn("amount_to_type_avg_ratio", X.amount_to_type_avg_ratio("_tavg"))
          .withColumn("high_amount_indicator", X.high_amount_indicator("_p95"))
          .drop("_tavg", "_p95"))
    return f


def non_finite_sql(features: list[str] = FEATURES) -> str:
    """Names of features that are null, NaN or infinite (SQL)."""
    bad = ", ".join(f"CASE WHEN NOT {Q._finite_sql(f'CAST(`{c}` AS double)')} THEN '{c}' END" for c in features)
    return f"filter(array({bad}), x -> x IS NOT NULL)"


def finite_or_zero_sql(c: str) -> str:
    x = f"CAST(`{c}` AS double)"
    return f"CASE WHEN {Q._finite_sql(x)} THEN {x} ELSE 0.0 END AS `{c}`"


CONTRIB_TYPE = "array<struct<k:double,i:int,feature:string,value:double,shap_value:double>>"


def contributor_array_sql(sign: int, features: list[str] = FEATURES, prefix: str = "c_") -> str:
    """E1 as array<struct<k, i, feature, value, shap_value>> with the sort key
    k = sign * contribution first, so the natural struct order (no comparator
    lambda) sorts by contribution, ties by feature order."""
    items = []
    for i, f in enumerate(features):
        c = f"`{prefix}{f}`"
        items.append(f"named_struct('k', {sign} * {c}, 'i', {i}, 'feature', '{f}', "
                     f"'value', CAST(`{f}` AS double), 'shap_value', {c})")
    return f"array({', '.join(items)})"


def top_contributors_sql(by_desc: str, by_asc: str, n: int = TOP_N) -> tuple[str, str]:
    """K4 + E7: (top positive, top negative) with phrases. Positive: the n
    largest > 0, descending. Negative: the n most negative, most negative first
    (the reference keeps the n weakest; we keep the strongest, as intended).
    Ties keep feature order. Phrases are formatted for these <= 2n only."""
    phr = PH.phrase_case_sql("c.feature", "c.value", FEATURES)
    out = (f"c -> named_struct('feature', c.feature, 'value', c.value, 'shap_value', round(c.shap_value, 6), "
           f"'phrase', {phr})")
    pos = f"transform(slice(sort_array(filter({by_desc}, c -> c.shap_value > 0)), 1, {n}), {out})"
    neg = f"transform(slice(sort_array(filter({by_asc}, c -> c.shap_value < 0)), 1, {n}), {out})"
    return pos, neg


def spike_context(df: DataFrame, spikes: DataFrame | None) -> DataFrame:
    """T6 + J4 + E10: per request step, the hybrid (OR) spike flag and two
    ratios from the spike table (one row per step: broadcast); steps outside
    the table are 'available, not a spike' with a note; no table at all is
    'not available' and never blocks scoring."""
    if spikes is None:
        return df.withColumn("spike_context", F.struct(
            F.lit(False).alias("available"), F.lit(None).cast("boolean").alias("is_spike"),
            F.lit(None).cast("boolean").alias("statistical_method_flag"),
            F.lit(None).cast("boolean").alias("isolation_forest_flag"),
            F.lit(None).cast("double").alias("txn_count_vs_hour_baseline_ratio"),
            F.lit(None).cast("double").alias("predicted_high_risk_count_vs_hour_baseline_ratio"),
            F.lit(None).cast("string").alias("note"),
            F.lit("spike-detection table not available").alias("message")))
    cols = spikes.columns
    st = spikes.select(
        F.col("step").alias("_sstep"),
        (F.col("stat_method_pred") == 1 if "stat_method_pred" in cols else F.lit(False)).alias("_stat"),
        (F.col("iso_method_pred") == 1 if "iso_method_pred" in cols else F.lit(False)).alias("_iso"),
        F.col("txn_count_vs_hour_baseline_ratio").alias("_r1"),
        F.col("predicted_high_risk_count_vs_hour_baseline_ratio").alias("_r2"))
    rng = spikes.agg(F.min("step").alias("_lo"), F.max("step").alias("_hi")).first()
    out = df.join(F.broadcast(st), F.col("clean_step") == F.col("_sstep"), "left")
    hit = F.col("_sstep").isNotNull()
    note = F.concat(F.lit("step "), F.col("clean_step").cast("string"),
                    F.lit(f" is outside the historical spike-detection analysis window (steps {rng['_lo']}-"
                          f"{rng['_hi']}); no spike context available for it."))
    ctx = F.struct(
        F.lit(True).alias("available"), F.when(hit, F.col("_stat") | F.col("_iso")).otherwise(F.lit(False))
        .alias("is_spike"),
        F.when(hit, F.col("_stat")).alias("statistical_method_flag"),
        F.when(hit, F.col("_iso")).alias("isolation_forest_flag"),
        F.when(hit, F.col("_r1")).alias("txn_count_vs_hour_baseline_ratio"),
        F.when(hit, F.col("_r2")).alias("predicted_high_risk_count_vs_hour_baseline_ratio"),
        F.when(~hit, note).alias("note"), F.lit(None).cast("string").alias("message"))
    return out.withColumn("spike_context", ctx).drop("_sstep", "_stat", "_iso", "_r1", "_r2")


def _sq(text: str) -> str:
    """A Python string as a Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def decide(requests: DataFrame, frozen: DataFrame, modes: DataFrame, score_fn, spikes: DataFrame | None = None,
           contrib_fn=None, model_available: bool = True) -> DataFrame:
    """Validate, build features, look up the mode, score, band, act,
    explain, attach spike context, override LOW in a spike step.

    ``score_fn(df) -> df`` adds ``pred_prob``; ``contrib_fn(df) -> df`` adds
    ``c_<feature>`` contributions (optional)."""
    high, medium = band_bounds(modes)
    v = Q.validate(requests)
    f = online_features(v, frozen).selectExpr("*", f"{non_finite_sql()} AS _bad_features")
    f = with_mode(f, modes)
    # the model sees only finite values; rows with bad features are degraded anyway
    others = [f"`{c}`" for c in f.columns if c not in FEATURES]
    scoring_in = f.selectExpr(*others, *[finite_or_zero_sql(c) for c in FEATURES])
    if model_available:
        scored = score_fn(scoring_in)
    else:
        scored = scoring_in.selectExpr("*", "CAST(NULL AS double) AS pred_prob")
    if contrib_fn is not None and model_available:
        by_desc, by_asc = contributor_array_sql(-1), contributor_array_sql(1)
        scored = contrib_fn(scored)
    else:
        by_desc = by_asc = f"CAST(array() AS {CONTRIB_TYPE})"
    pos, neg = top_contributors_sql("_cdesc", "_casc")
    quote = _sq("'")
    bad_list = f"concat('[', array_join(transform(_bad_features, x -> concat({quote}, x, {quote})), ', '), ']')"
    modes_text = _sq(". Valid modes: ['BALANCED', 'HIGH_PRECISION', 'HIGH_RECALL']")
    # Status by precedence invalid_input > degraded > ok
    status = f"""CASE
      WHEN NOT is_valid THEN named_struct('s', 'invalid_input', 'm',
           concat('Transaction failed validation: ', array_join(errors, '; ')))
      WHEN {str(not model_available).lower()} THEN named_struct('s', 'degraded', 'm',
           'Transaction risk model unavailable: no model given')
      WHEN size(_bad_features) > 0 THEN named_struct('s', 'degraded', 'm',
           concat('Feature generation failed: feature(s) contained NaN/Infinity after generation: ', {bad_list}))
      WHEN threshold_used IS NULL THEN named_struct('s', 'degraded', 'm',
           concat('Unknown operating mode ', {quote}, mode, {quote}, {modes_text}))
      WHEN NOT {Q._finite_sql('pred_prob')} THEN named_struct('s', 'degraded', 'm',
           'Model produced a non-finite risk score (NaN/Infinity); refusing to report it.')
      ELSE named_struct('s', 'ok', 'm', CAST(NULL AS string)) END"""
    scored = scored.selectExpr("*", f"{by_desc} AS _cdesc", f"{by_asc} AS _casc").selectExpr(
        "*", f"{pos} AS _pos", f"{neg} AS _neg", f"{status} AS _st",
        f"CASE WHEN pred_prob >= {high} THEN 'HIGH' WHEN pred_prob >= {medium} THEN 'MEDIUM' ELSE 'LOW' END AS _band")
    scored = spike_context(scored, spikes)
    scored = scored.selectExpr(
        "*", "_st.s = 'ok' AS _ok",
        "_st.s = 'ok' AND coalesce(spike_context.available AND spike_context.is_spike, false) AND _band = 'LOW'"
        " AS _override")
    actions = " ".join(f"WHEN _band = '{b}' THEN '{a}'" for b, a in BAND_ACTION.items())
    reasons = ("CASE WHEN size(_pos) > 0 THEN transform(_pos, c -> c.phrase) "
               "ELSE transform(_neg, c -> c.phrase) END")
    has_expl = str(contrib_fn is not None).lower()
    return scored.selectExpr(
        *[f"`{c}`" for c in requests.columns],
        "_st.s AS status",
        "CASE WHEN _ok THEN round(pred_prob, 6) END AS risk_score",
        "CASE WHEN _ok THEN _band END AS risk_band",
        f"CASE WHEN _ok AND _override THEN 'REVIEW' WHEN _ok THEN CASE {actions} END "
        "WHEN _st.s = 'degraded' THEN 'MANUAL_REVIEW' END AS recommended_action",
        "mode",
        "CASE WHEN _ok THEN threshold_used END AS threshold_used",
        "CASE WHEN _ok THEN pred_prob >= threshold_used END AS alert",
        # Top reasons are the first 3 positive phrases, else the first 3 negative
        f"CASE WHEN _ok AND _override THEN concat({reasons}, array({_sq(SPIKE_REASON)})) WHEN _ok THEN {reasons} "
        "ELSE CAST(array() AS array<string>) END AS top_reasons",
        f"CASE WHEN _ok AND {has_expl} THEN named_struct('top_positive_contributors', _pos, "
        f"'top_negative_contributors', _neg, 'narrative', {PH.narrative_sql('pred_prob', '_band', '_pos', '_neg')}) "
        "END AS explanation",
        "CASE WHEN _ok THEN spike_context END AS spike_context",
        "_st.m AS message",
        "CASE WHEN NOT _ok THEN 'MANUAL_REVIEW' END AS fallback")
