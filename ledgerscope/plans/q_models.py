"""B6-B8 queries on fitted models (rows-only: fitted models have no SQL
oracle; the surrounding logic is checked through the linear-score queries)."""
from __future__ import annotations

import random

from pyspark.sql import functions as F

from ..operators import decide as D
from ..operators import explain as EX
from ..operators import leafwise as LW
from ..operators import metrics as M
from ..operators import spikes as SP
from ..operators import splits as S
from ..operators import train as TR
from ..operators.cumulative import running_totals
from ..operators.iforest import IsolationForestJob
from ..session import ensure_checkpoint_dir
from .catalog import features_table, ledger, register, steps_table
from .q_decide import frozen_stats
from .q_quality import as_requests

_RUNS: dict = {}
HISTORY_FIELDS = ["hist_dest_txn_count", "hist_dest_unique_origin_count", "hist_dest_total_amount",
                  "hist_dest_avg_amount", "hist_dest_max_amount"]
TEST = S.DEFAULT_SPLIT.test


def model_run(spark, sf_dir) -> TR.ModelRun:
    """Fit the three models once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        feats = features_table(spark, sf_dir)
        uni = S.with_split(S.modelling_universe(feats)).where(F.col("split").isNotNull()).persist()
        _RUNS[key] = TR.ModelRun(uni).fit_all()
    return _RUNS[key]


def _eval(run, name, part):
    d = TR.score(run.models[name], part)
    return M.evaluate(d, 0.5, score="pred_prob")


@register("model_comparison")
def model_comparison(spark, sf_dir):
    """Three models, validation and test metrics, the selection.
    The three models' scores on validation and test are one keyed evaluation
    (keys model, split), folded to one row per model."""
    run = model_run(spark, sf_dir)
    held_out = run.universe.where(F.col("split").isin("val", "test"))
    scored = None
    for n in run.names:
        s = TR.score(run.models[n], held_out).select(F.lit(n).alias("model"), "split", TR.LABEL, "pred_prob")
        scored = s if scored is None else scored.unionByName(s)
    ev = M.evaluate(scored, 0.5, score="pred_prob", keys=["model", "split"])

    def at(split, c):
        return F.first(F.when(F.col("split") == split, F.col(c)), ignorenulls=True).alias(f"{split}_{c}")

    per_model = ev.groupBy("model").agg(
        *[at("val", c) for c in ["pr_auc", "roc_auc"]],
        *[at("test", c) for c in ["pr_auc", "roc_auc", "precision", "recall", "f1"]])
    secs = F.create_map(*[x for n in run.names for x in (F.lit(n), F.lit(round(run.seconds[n], 2)))])
    return per_model.select(
        "model", secs[F.col("model")].alias("train_time_sec"),
        *[c for c in per_model.columns if c != "model"],
        (F.col("model") == F.lit(run.selected)).alias("selected")).orderBy(
        F.array_position(F.array(*[F.lit(n) for n in run.names]), F.col("model")))


_LEAFWISE: dict = {}
#: M8: up to 500 rounds, stopped 30 rounds after the best one.
LEAFWISE_ROUNDS, LEAFWISE_PATIENCE = 500, 30


def leafwise_run(spark, sf_dir):
    """(model, validation average precision by round), fitted once per session
    and table folder on the training split, positives weighted n_neg / n_pos."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _LEAFWISE:
        uni = S.with_split(S.modelling_universe(features_table(spark, sf_dir))).where(F.col("split").isNotNull())
        train = TR.with_weights(uni.where(F.col("split") == "train"), "pos_ratio")
        _LEAFWISE[key] = (*LW.fit(train, uni.where(F.col("split") == "val"), TR.FEATURES, TR.LABEL, rounds=LEAFWISE_ROUNDS,
                                  patience=LEAFWISE_PATIENCE), uni)
    return _LEAFWISE[key]


@register("leafwise_rounds")
def leafwise_rounds(spark, sf_dir):
    """M8: validation average precision after every round of leaf-wise boosting,
    the round that is kept and the patience left at each."""
    model, curve, _ = leafwise_run(spark, sf_dir)
    best, rows = 0, []
    for r, ap in enumerate(curve):
        best = r if ap > curve[best] else best
        rows.append((r + 1, float(ap), r + 1 == len(model.trees), LEAFWISE_PATIENCE - (r - best)))
    return spark.createDataFrame(rows, "round int, val_pr_auc double, kept boolean, patience_left int")


@register("leafwise_evaluation")
def leafwise_evaluation(spark, sf_dir):
    """M8: the leaf-wise model at its best round on validation and test."""
    model, _, uni = leafwise_run(spark, sf_dir)
    scored = model.score(uni.where(F.col("split").isin("val", "test")).select("split", TR.LABEL, *TR.FEATURES))
    return M.evaluate(scored, 0.5, score="pred_prob", keys=["split"]).withColumn("n_trees", F.lit(len(model.trees)))


@register("leafwise_importances")
def leafwise_importances(spark, sf_dir):
    """M15 + K6 for the leaf-wise model: share of the total gain, descending."""
    model = leafwise_run(spark, sf_dir)[0]
    return spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(model.importances())], "feature string, importance double, rank int")


_SCORES: dict = {}


def _selected_scores(spark, sf_dir, part):
    """Labels and the selected model's scores of a split, scored once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, part)
    if key not in _SCORES:
        run = model_run(spark, sf_dir)
        _SCORES[key] = TR.score(run.models[run.selected], getattr(run, part)).select(TR.LABEL, "pred_prob").checkpoint()
    return _SCORES[key]


@register("model_threshold_sweep")
def model_threshold_sweep(spark, sf_dir):
    """M7 on the selected model's validation scores."""
    return M.threshold_sweep(_selected_scores(spark, sf_dir, "val"), score="pred_prob")


@register("model_operating_points")
def model_operating_points(spark, sf_dir):
    """M11 from the selected model's validation sweep."""
    return M.operating_points(model_threshold_sweep(spark, sf_dir))


_POINTS: dict = {}


def selected_points(spark, sf_dir):
    """The three operating points of the fitted run, computed once per session
    and kept as a three-row table for the jobs that apply them (M12, L2, E3)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _POINTS:
        pts = model_operating_points(spark, sf_dir)
        _POINTS[key] = (pts.collect(), pts.schema)      # three rows
    rows, schema = _POINTS[key]
    return spark.createDataFrame(rows, schema)


@register("model_test_by_mode")
def model_test_by_mode(spark, sf_dir):
    """Each operating point applied once to the untouched test split."""
    pts = selected_points(spark, sf_dir).select("mode", "threshold").collect()   # three rows
    test = _selected_scores(spark, sf_dir, "test")
    return M.evaluate_at(test, [(p["mode"], p["threshold"]) for p in pts], score="pred_prob")


@register("model_importances")
def model_importances(spark, sf_dir):
    """M15 + K6: built-in importances of the selected model, descending."""
    run = model_run(spark, sf_dir)
    rows = TR.importances(run.selected, run.models[run.selected])
    return spark.createDataFrame([(run.selected, f, v, i + 1) for i, (f, v) in enumerate(rows)],
                                 "model string, feature string, importance double, rank int")


_STEPS: dict = {}


def model_steps(spark, sf_dir, n_trees=200):
    """Memoised per session: the fitted-model step table with both detectors
    (one row per step), persisted so the three queries that read it share it."""
    key = (spark.sparkContext.applicationId, sf_dir, n_trees)
    if key not in _STEPS:
        _STEPS[key] = _model_steps(spark, sf_dir, n_trees).persist()
    return _STEPS[key]


def _model_steps(spark, sf_dir, n_trees=200):
    """L2: score every eligible row with the selected model (M13), aggregate
    per step at the balanced threshold (A22), extend (J5, W7, W8, T2), flag by
    z-score (T3) and isolation forest (T4)."""
    run = model_run(spark, sf_dir)
    feats = features_table(spark, sf_dir)
    steps = steps_table(spark, sf_dir)
    pts = selected_points(spark, sf_dir)
    thr = float(pts.where(F.col("mode") == "balanced").first()["threshold"])
    scored = TR.score(run.models[run.selected], S.modelling_universe(feats))
    ext = SP.zscore_flag(SP.extend_step_table(steps, SP.step_model_signal(scored, thr))).cache()
    job = IsolationForestJob(SP.PREDICTIVE_SPIKE_FEATURES, n_trees=n_trees, seed=TR.SEED)
    nodes = job.fit(ext.where(F.col("step").between(*S.DEFAULT_SPLIT.train)))
    return job.transform(ext, nodes)


@register("model_spike_table")
def model_spike_table(spark, sf_dir):
    """L2 step table with both detectors' outputs."""
    e = model_steps(spark, sf_dir)
    return e.select("step", "hour_of_day", "transaction_count", "predicted_high_risk_count",
                    "predicted_risk_score_sum", "predicted_high_risk_count_zscore_vs_hour_baseline",
                    "gt_fraud_count", "gt_fraud_spike", "stat_method_pred", "iso_method_pred", "iso_method_score")


@register("model_spike_eval")
def model_spike_eval(spark, sf_dir):
    """T5 for both detectors, all steps and test window (4 rows)."""
    e = model_steps(spark, sf_dir)
    parts = [SP.evaluate_detector(e, n, p, sc) for n, p in [("statistical_zscore", "stat_method_pred"),
                                                             ("isolation_forest", "iso_method_pred")]
             for sc in (None, TEST)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Shuffled copies in a task of the join that gives them the other features.
COPIES_PER_TASK = 500_000


@register("permutation_importance")
def permutation_importance(spark, sf_dir, repeats=5):
    """Drop in validation PR-AUC when one feature is shuffled, mean of 5
    repeats, over all validation rows. The rows get one seeded random order by
    running totals over range partitions; a shuffle is a seeded shift along it
    (each row takes the feature of the row ``shift`` places on), so a copy
    costs one narrow row per validation row and no window of its own."""
    run = model_run(spark, sf_dir)
    model = run.models[run.selected]
    order = F.struct(F.xxhash64(F.lit(TR.SEED), "event_id"), "event_id").alias("_o")
    rows = (running_totals(run.val.select(order, F.lit(1).alias("_one"), TR.LABEL, *TR.FEATURES), [], "_o", ["_one"])
            .withColumn("_i", F.col("cum__one") - 1).drop("_o", "_one", "cum__one").checkpoint())
    n = rows.count()
    base = M.ranking_metrics(M.curve(TR.score(model, rows), TR.LABEL, "pred_prob")).first()["pr_auc"]
    rng = random.Random(TR.SEED)
    moves = F.explode(F.array(*[
        F.struct(F.lit(f).alias("pf"), F.lit(r).alias("rep"), F.col(f).cast("double").alias("v"),
                 F.pmod(F.col("_i") - F.lit(rng.randrange(1, max(n, 2))), F.lit(max(n, 1))).alias("_i"))
        for f in TR.FEATURES for r in range(repeats)])).alias("m")
    # so many partitions, which Spark doesn't merge by their packed size, that a task's memory stays as the rows grow
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(TR.FEATURES) * repeats // COPIES_PER_TASK))
    moved = rows.select(moves).select("m.*").repartition(parts, "_i").join(rows.repartition(parts, "_i"), "_i")
    for f in TR.FEATURES:
        moved = moved.withColumn(f, F.when(F.col("pf") == f, F.col("v")).otherwise(F.col(f)))
    cv = M.curve(TR.score(model, moved.drop("_i", "v")), TR.LABEL, "pred_prob", keys=["pf", "rep"])
    ap = M.ranking_metrics(cv, keys=["pf", "rep"])
    return (ap.groupBy(F.col("pf").alias("feature"))
              .agg(F.round(F.lit(base) - F.avg("pr_auc"), 6).alias("pr_auc_drop"))
              .withColumn("sample_size", F.lit(n)))


@register("contribution_importance")
def contribution_importance(spark, sf_dir):
    """Mean absolute contribution per feature over all test rows."""
    run = model_run(spark, sf_dir)
    model = run.models[run.selected]
    out, _ = EX.contributions(spark, run.selected, model, TR.score(model, run.test), ensure_checkpoint_dir(spark))
    cols = [F.round(F.avg(F.abs(f"c_{f}")), 6).alias(f) for f in TR.FEATURES]
    row = out.agg(*cols)
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_contribution"))
                                          for f in TR.FEATURES])).alias("s")).select("s.*")


@register("example_explanation")
def example_explanation(spark, sf_dir):
    """K7 + F7: the first confident true positive in the test split (label 1,
    score >= 0.9, by step then id) and its 8 strongest contributions."""
    run = model_run(spark, sf_dir)
    model = run.models[run.selected]
    sc = TR.score(model, run.test)
    first = sc.where((F.col(TR.LABEL) == 1) & (F.col("pred_prob") >= 0.9)).orderBy("step", "event_id").limit(1)
    out, base = EX.contributions(spark, run.selected, model, first, ensure_checkpoint_dir(spark))
    arr = EX.contribution_array()
    top = F.slice(F.array_sort(arr, lambda a, b: F.when(F.abs(a["shap_value"]) > F.abs(b["shap_value"]), -1)
                               .when(F.abs(a["shap_value"]) < F.abs(b["shap_value"]), 1).otherwise(0)), 1, 8)
    return out.select("event_id", "step", TR.LABEL, F.round("pred_prob", 6).alias("predicted_probability"),
                      F.lit(round(base, 6)).alias("base_value"), F.explode(top).alias("c")).select(
        "event_id", "step", TR.LABEL, "predicted_probability", "base_value", F.col("c.feature").alias("feature"),
        F.round("c.shap_value", 6).alias("shap_value"), F.col("c.value").alias("feature_value"))


@register("model_decisions")
def model_decisions(spark, sf_dir):
    """A decision record for every ledger request with the selected
    model, its contributions, phrases, narrative and spike context."""
    run = model_run(spark, sf_dir)
    model = run.models[run.selected]
    work = ensure_checkpoint_dir(spark)
    spikes = model_steps(spark, sf_dir)
    modes = D.modes_table(spark, selected_points(spark, sf_dir))

    def score_fn(df):
        return TR.score(model, df)

    def contrib_fn(df):
        return EX.contributions(spark, run.selected, model, df, work)[0]

    # the caller supplies destination history, as a feature store would: here
    # the ledger's own strictly-prior history (W1) for each request
    requests = as_requests(features_table(spark, sf_dir), HISTORY_FIELDS)
    return D.decide(requests, frozen_stats(spark, sf_dir), modes, score_fn, spikes, contrib_fn=contrib_fn)
