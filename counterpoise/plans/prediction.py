"""Evaluating classifiers and scoring the population."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE
from counterpoise.operators import evaluate, hierarchy, models, summary
from counterpoise.operators.bootstrap import bootstrap_mean_ci
from counterpoise.operators.features import Preparation


def settings_for(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE, **options) -> Preparation:
    """Preparation of the prediction features, with components of the continuous ones."""
    features = [c for c in cat.prediction_features if c in df.columns]
    for banned in cat.not_predictors:
        assert banned not in features
    return Preparation(features=features, target=cat.target,
                       categorical=[c for c in cat.encoded if c in features],
                       may_be_numeric=[c for c in cat.encoded if c in cat.may_be_null],
                       binary=cat.binary, continuous=cat.continuous, pca=True, **options)


def standard_models(medicinal: str = "Medicinal",
                    specific: str = "Antimalarial_Use") -> list[models.ModelSpec]:
    return [models.averaged_network(), models.boosted_trees(), models.logit(), models.kernel_svm(),
            models.rule_model("Ethno (M)", [specific]), models.rule_model("Ethno (G)", [medicinal])]


def evaluate_models(labelled: DataFrame, unlabelled: DataFrame, specs: list[models.ModelSpec],
                    cat: Catalogue = DEFAULT_CATALOGUE, k: int = 10, repeats: int = 10,
                    weight: str | None = None, **options) -> dict[str, DataFrame]:
    """Fold scores, their summary and box statistics, and the curves of models with scores."""
    settings = settings_for(labelled, cat)
    hierarchy.require_no_twins(labelled, settings.features)
    scores, preds = models.cross_validate(labelled, unlabelled, settings, specs, cat.name, k,
                                          repeats, weight, **options)
    scored = preds.filter(F.col("model").isin([s.name for s in specs if not s.rule]))
    boxes = None
    for metric in evaluate.METRICS:
        part = summary.boxplot_stats(scores.filter(F.col("metric") == metric), "model",
                                     "value").withColumn("metric", F.lit(metric))
        boxes = part if boxes is None else boxes.unionByName(part)
    return {
        "scores": scores, "summary": summary.fold_score_summary(scores), "boxes": boxes,
        "pr_curves": evaluate.pr_curve(scored, ["model"], "y", "p", "w"),
        "average_precision": evaluate.average_precision(scored, ["model"], "y", "p", "w"),
    }


def surprises(scored_unlabelled: DataFrame, weighted: DataFrame, scores: DataFrame,
              chosen: str = "SVC", cat: Catalogue = DEFAULT_CATALOGUE,
              propensity: str = "P(s|x)") -> DataFrame:
    """Predicted positives among rows unlikely to have been selected, with the interval of the
    chosen model's precision.
    """
    kept = weighted.select(cat.name, cat.target, F.col(f"`{propensity}`").alias("p_s"))
    unlabelled = scored_unlabelled.select(
        cat.name, F.col(f"`{chosen} Prediction`").alias("prediction")).join(
        kept.filter(F.col(cat.target).isNull()), on=cat.name)
    labelled = kept.filter(F.col(cat.target).isNotNull())
    precision = scores.filter((F.col("model") == chosen) & (F.col("metric") == "precision"))
    ci = bootstrap_mean_ci(precision, "value").first()
    return summary.surprise_report(unlabelled, labelled, "p_s", "prediction", cat.target,
                                   ci["low"], ci["high"])
