"""Scores of predictions: one aggregate per fold table, prefix sums for curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.operators.prefix import prefix_sums

# Fixed value: weight of recall against precision in the F score used to choose models.
BETA = 0.5
METRICS = ["accuracy", "precision", "recall", "f1", "f_beta"]


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else F.col(weight).cast("double")


def _f_score(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.coalesce(F.try_divide((1 + b2) * tp, (1 + b2) * tp + b2 * fn + fp), F.lit(0.0))


def confusion(preds: DataFrame, groups: list[str], target: str, prediction: str,
              weight: str | None = None) -> DataFrame:
    """Weighted true/false positives/negatives per group."""
    w, y, p = _weight(weight), F.col(target) == 1, F.col(prediction) == 1
    return preds.groupBy(*groups).agg(
        F.sum(F.when(y & p, w).otherwise(0.0)).alias("tp"),
        F.sum(F.when(~y & p, w).otherwise(0.0)).alias("fp"),
        F.sum(F.when(y & ~p, w).otherwise(0.0)).alias("fn"),
        F.sum(F.when(~y & ~p, w).otherwise(0.0)).alias("tn"))


def score_folds(preds: DataFrame, groups: list[str], target: str, prediction: str,
                weight: str | None = None, beta: float = BETA) -> DataFrame:
    """Accuracy, precision, recall, F1 and F-beta per group, tall (groups, metric, value).

    Undefined ratios are 0.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    values = {"accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
              "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
              "recall": F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)),
              "f1": _f_score(tp, fp, fn, 1.0), "f_beta": _f_score(tp, fp, fn, beta)}
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), values[m].alias("value"))
                      for m in METRICS])
    return confusion(preds, groups, target, prediction, weight).select(*groups, F.inline(cells))


def _cumulative(preds: DataFrame, groups: list[str], target: str, score: str,
                weight: str | None, buckets: int | None) -> DataFrame:
    w = _weight(weight)
    rows = preds.select(*groups, F.col(score).cast("double").alias("threshold"), w.alias("all"),
                        F.when(F.col(target) == 1, w).otherwise(0.0).alias("pos"))
    sums = prefix_sums(rows, groups, "threshold", ["pos", "all"], descending=True, buckets=buckets,
                       force_buckets=buckets is not None)
    totals = rows.groupBy(*groups).agg(F.sum("pos").alias("_total"))    # one row per group
    totals = totals.select(*[F.col(g).alias(f"_t{i}") for i, g in enumerate(groups)], "_total")
    if groups:
        cond = [F.col(g).eqNullSafe(F.col(f"_t{i}")) for i, g in enumerate(groups)]
        sums = sums.join(F.broadcast(totals), on=cond, how="left")
    else:
        sums = sums.withColumn("_total", totals.scalar())
    tp = F.col("pos") + F.col("pos_before")
    return sums.select(*groups, "threshold", F.try_divide(F.col("pos"), F.col("_total"))
                       .alias("step"), F.try_divide(tp, F.col("all") + F.col("all_before"))
                       .alias("precision"), F.try_divide(tp, F.col("_total")).alias("recall"))


def pr_curve(preds: DataFrame, groups: list[str], target: str, score: str,
             weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """Precision and recall when everything at or above each distinct score is taken.

    Each curve ends in the point (precision 1, recall 0), written with threshold 1.
    """
    curve = _cumulative(preds, groups, target, score, weight, buckets).drop("step")
    last = preds.select(*groups).distinct() if groups else preds.limit(1).select()
    return curve.unionByName(last.withColumns({
        "threshold": F.lit(1.0), "precision": F.lit(1.0), "recall": F.lit(0.0)}))


def average_precision(preds: DataFrame, groups: list[str], target: str, score: str,
                      weight: str | None = None, buckets: int | None = None) -> DataFrame:
    """Sum over the curve of the recall gained times the precision there."""
    curve = _cumulative(preds, groups, target, score, weight, buckets)
    return curve.groupBy(*groups).agg(
        F.sum(F.col("step") * F.col("precision")).alias("average_precision"))


def brier(preds: DataFrame, groups: list[str], target: str, score: str,
          weight: str | None = None) -> DataFrame:
    """Mean squared distance of score and target."""
    w, gap = _weight(weight), F.col(score) - F.col(target)
    return preds.groupBy(*groups).agg((F.sum(w * gap * gap) / F.sum(w)).alias("brier"))
