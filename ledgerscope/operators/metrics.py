"""Classifier metrics on a (label, score) DataFrame.

* M2 PR-AUC is average precision: sum over distinct scores s (descending) of
  (pos_s / P) * precision(s), a step sum, not a trapezoid.
* M3 ROC-AUC counts tied scores half: sum_s pos_s * (neg below s + neg_s / 2) / (P N).
* M5 best precision among curve points with recall >= target, ties -> higher recall.
Everything works on one row per distinct score; running sums use the global
range-partitioned helper, so no key's scores sit in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .combine import side_by_side
from .cumulative import running_totals

# The recall targets and the 50 sweep thresholds 0.01, 0.03, ..., 0.99.
RECALL_TARGETS = [0.5, 0.7, 0.8, 0.9]
SWEEP_THRESHOLDS = [round(0.01 + 0.02 * i, 3) for i in range(50)]


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def score_table(df: DataFrame, label: str, score: str, keys: list[str]) -> DataFrame:
    """One row per (keys, distinct score): positives and negatives."""
    y = F.col(label).cast("long")
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def curve(df: DataFrame, label: str = "isFraud", score: str = "score",
          keys: list[str] | None = None) -> DataFrame:
    """Per distinct score, tp/fp at threshold ``score >= s`` plus P, N,
    precision and recall."""
    keys = list(keys or [])
    st = score_table(df, label, score, keys)
    cum = running_totals(st, keys, "score", ["pos", "neg"], descending=True, totals=True)
    return (cum.withColumnsRenamed({"cum_pos": "tp", "cum_neg": "fp", "all_pos": "P", "all_neg": "N"})
               .withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
               .withColumn("recall", _safe_div(F.col("tp"), F.col("P"))))


def ranking_metrics(cv: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """M2 + M3 from a curve table: pr_auc, roc_auc, n_samples, n_fraud."""
    keys = list(keys or [])
    ap = F.sum(F.col("pos") / F.col("P") * F.col("precision"))
    auc = F.sum(F.col("pos") * (F.col("N") - F.col("fp") + 0.5 * F.col("neg"))) / (F.first("P") * F.first("N"))
    g = cv.groupBy(*keys) if keys else cv.groupBy()
    return g.agg(F.when(F.first("P") > 0, ap).alias("pr_auc"),
                 F.when((F.first("P") > 0) & (F.first("N") > 0), auc).alias("roc_auc"),
                 (F.first("P") + F.first("N")).alias("n_samples"), F.first("P").alias("n_fraud"))


def precision_at_recall(cv: DataFrame, targets: list[float] = RECALL_TARGETS,
                        keys: list[str] | None = None) -> DataFrame:
    """M5: per target, the best precision among points with recall >= target
    (ties -> higher recall); null when no point reaches the target. One partial
    aggregate of max(struct(precision, recall)) per target."""
    keys = list(keys or [])
    aggs = []
    for t in targets:
        best = F.max(F.when(F.col("recall") >= t, F.struct(F.col("precision").alias("p"), F.col("recall").alias("r"))))
        aggs.append(best.alias(f"_b{int(round(t * 100))}"))
    g = cv.groupBy(*keys) if keys else cv.groupBy()
    out = g.agg(*aggs)
    cols = [F.col(k) for k in keys]
    for t in targets:
        n = int(round(t * 100))
        cols += [F.col(f"_b{n}.p").alias(f"precision_at_recall_{n}"),
                 F.col(f"_b{n}.r").alias(f"actual_recall_{n}")]
    return out.select(*cols)


def confusion_at(df: DataFrame, threshold: Column | float, label: str = "isFraud", score: str = "score",
                 keys: list[str] | None = None) -> DataFrame:
    """M4: confusion counts, precision, recall, F1 at ``score >= threshold``
    (0 when undefined)."""
    keys = list(keys or [])
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    y = F.col(label) == 1
    g = df.groupBy(*keys) if keys else df.groupBy()
    out = g.agg(F.count(F.when(pred & y, 1)).alias("tp"), F.count(F.when(~pred & ~y, 1)).alias("tn"),
                F.count(F.when(pred & ~y, 1)).alias("fp"), F.count(F.when(~pred & y, 1)).alias("fn"))
    return with_rates(out)


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p = _safe_div(tp, tp + fp)
    rc = _safe_div(tp, tp + fn)
    return (df.withColumn("precision", p).withColumn("recall", rc)
              .withColumn("f1", _safe_div(2 * tp, 2 * tp + fp + fn)))


def evaluate(df: DataFrame, threshold: float = 0.5, label: str = "isFraud", score: str = "score",
             keys: list[str] | None = None) -> DataFrame:
    """The reference's evaluate(): ranking metrics, confusion at the threshold
    and precision at recall targets, one row (per key), rounded like the report."""
    keys = list(keys or [])
    cv = curve(df, label, score, keys)
    rk = ranking_metrics(cv, keys)
    pr = precision_at_recall(cv, keys=keys)
    cf = confusion_at(df, threshold, label, score, keys)
    if keys:
        out = rk.join(cf, keys).join(pr, keys)
    else:
        out = side_by_side(rk, cf, pr)
    r6 = [c for c in out.columns if c.startswith(("precision", "actual_recall")) or c in
          ("pr_auc", "roc_auc", "recall", "f1")]
    # P20: reported metrics are rounded (6 digits here; 4 and 8 where the report uses them)
    return out.select(*[F.round(c, 6).alias(c) if c in r6 else F.col(c) for c in out.columns]).withColumn(
        "threshold", F.lit(float(threshold)))


def evaluate_at(df: DataFrame, points: list[tuple[str, float]], label: str = "isFraud", score: str = "score",
                key: str = "mode") -> DataFrame:
    """``evaluate`` at several named thresholds in one pass. Ranking
    metrics and precision at recall do not depend on the threshold, so they
    are computed once; the confusion counts of every threshold come from one
    conditional aggregate. One row per point, columns as ``evaluate`` plus
    ``key``."""
    cv = curve(df, label, score)
    rk = ranking_metrics(cv)
    pr = precision_at_recall(cv)
    y = F.col(label) == 1
    aggs = []
    for i, (_, t) in enumerate(points):
        pred = F.col(score) >= F.lit(float(t))
        aggs += [F.count(F.when(pred & y, 1)).alias(f"_tp{i}"), F.count(F.when(~pred & ~y, 1)).alias(f"_tn{i}"),
                 F.count(F.when(pred & ~y, 1)).alias(f"_fp{i}"), F.count(F.when(~pred & y, 1)).alias(f"_fn{i}")]
    one = side_by_side(rk, df.agg(*aggs), pr)
    per = F.array(*[F.struct(F.lit(name).alias(key), F.lit(float(t)).alias("threshold"),
                             *[F.col(f"_{c}{i}").alias(c) for c in ("tp", "tn", "fp", "fn")])
                    for i, (name, t) in enumerate(points)])
    out = one.select(*rk.columns, *pr.columns, F.explode(per).alias("_p"))
    out = with_rates(out.select(*rk.columns, "_p.tp", "_p.tn", "_p.fp", "_p.fn", *pr.columns,
                                "_p.threshold", f"_p.{key}"))
    cols = [*rk.columns, "tp", "tn", "fp", "fn", "precision", "recall", "f1", *pr.columns]
    r6 = [c for c in cols if c.startswith(("precision", "actual_recall")) or c in ("pr_auc", "roc_auc", "recall", "f1")]
    return out.select(*[F.round(c, 6).alias(c) if c in r6 else F.col(c) for c in cols], "threshold", key)


def _threshold_index(score: Column) -> Column:
    """Number of sweep thresholds <= score, exactly (a guess from arithmetic,
    corrected by comparing against the literal thresholds)."""
    arr = F.array(*[F.lit(t) for t in SWEEP_THRESHOLDS])
    n = len(SWEEP_THRESHOLDS)
    g = F.least(F.lit(n), F.greatest(F.lit(0), (F.floor((score - 0.01) / 0.02) + 1).cast("int")))
    # g may be off by one either way at a threshold: fix with two comparisons
    down = F.when((g > 0) & (score < F.element_at(arr, F.greatest(g, F.lit(1)))), g - 1).otherwise(g)
    return F.when((down < n) & (score >= F.element_at(arr, F.least(down + 1, F.lit(n)))), down + 1).otherwise(down)


def threshold_sweep(df: DataFrame, label: str = "isFraud", score: str = "score",
                    keys: list[str] | None = None) -> DataFrame:
    """M7 + J7: confusion, precision, recall, F1 and alert rate at each of the 50
    thresholds. Each row is bucketed once by how many thresholds it reaches
    (0..50); a reverse running sum over those 51 buckets gives tp and fp at
    every threshold. No explode of rows, no pairing of rows with thresholds."""
    keys = list(keys or [])
    n = len(SWEEP_THRESHOLDS)
    y = F.col(label).cast("long")
    b = df.groupBy(*keys, _threshold_index(F.col(score)).alias("i")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    idx = F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")
    grid = b.select(*keys).distinct().select(*keys, idx) if keys else \
        df.sparkSession.range(0, n + 1).select(F.col("id").cast("int").alias("i"))
    full = grid.join(b, [*keys, "i"], "left").fillna(0, subset=["pos", "neg"])
    wk = Window.partitionBy(*keys)
    wc = wk.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    arr = F.array(*[F.lit(t) for t in SWEEP_THRESHOLDS])
    out = (full.select(*keys, "i", F.sum("pos").over(wc).alias("tp"), F.sum("neg").over(wc).alias("fp"),
                       F.sum("pos").over(wk).alias("P"), F.sum("neg").over(wk).alias("N"))
               .where(F.col("i") >= 1)
               .withColumn("threshold", F.element_at(arr, F.col("i")))
               .withColumn("fn", F.col("P") - F.col("tp")).withColumn("tn", F.col("N") - F.col("fp"))
               .transform(with_rates)
               .withColumn("alert_rate", (F.col("tp") + F.col("fp")) / (F.col("P") + F.col("N"))))
    return out.select(*keys, "threshold", F.round("precision", 6).alias("precision"),
                      F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"),
                      F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"),
                      F.col("tp").cast("long").alias("tp"), F.col("tn").cast("long").alias("tn"),
                      F.round("alert_rate", 8).alias("alert_rate"))


def operating_points(sweep: DataFrame) -> DataFrame:
    """Three operating modes from the (rounded) sweep rows; ties go to
    the lowest threshold.
      high_recall    = max precision with recall >= 0.90, else max recall
      balanced       = max F1
      high_precision = max recall with precision >= 0.80, else max precision
    One aggregate: each pick is max(struct(metric, -threshold, row)) over the
    rows meeting its condition (argmax, first-wins on the lowest threshold);
    a pick with no qualifying row is null and its fallback is used."""
    row = F.struct(*[F.col(c) for c in sweep.columns])

    def best(metric: str, cond: Column) -> Column:
        return F.max(F.when(cond, F.struct(F.col(metric).alias("_m"), (-F.col("threshold")).alias("_t"),
                                           row.alias("r"))))

    agg = sweep.agg(best("precision", F.col("recall") >= 0.90).alias("hr"), best("recall", F.lit(True)).alias("hr0"),
                    best("f1", F.lit(True)).alias("bal"),
                    best("recall", F.col("precision") >= 0.80).alias("hp"),
                    best("precision", F.lit(True)).alias("hp0"))
    picks = F.array(
        F.struct(F.lit("high_recall").alias("mode"), F.coalesce("hr", "hr0")["r"].alias("r")),
        F.struct(F.lit("balanced").alias("mode"), F.col("bal")["r"].alias("r")),
        F.struct(F.lit("high_precision").alias("mode"), F.coalesce("hp", "hp0")["r"].alias("r")))
    return (agg.select(F.explode(picks).alias("p")).where(F.col("p.r").isNotNull())
               .select("p.r.*", F.col("p.mode").alias("mode")))
