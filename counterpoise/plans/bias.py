"""Measuring and correcting the selection bias of the labelled rows, with all reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE
from counterpoise.operators import regions, summary, tests2s, weights
from counterpoise.session import cut_lineage


def quantify_bias(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE) -> dict[str, DataFrame]:
    """Comparison of labelled rows with all rows, corrected p-values, summaries and means."""
    features = set(df.columns)
    discrete = [c for c in cat.binary if c in features and c not in cat.compounds]
    continuous = [c for c in cat.continuous if c in features]
    comparison, corrected = tests2s.selection_bias_report(df, cat.target, continuous, discrete)
    numeric = discrete + continuous + [cat.target]
    labelled = F.col(cat.target).isNotNull()
    return {
        "comparison": comparison, "corrected": corrected,
        "all": summary.describe(df, numeric),
        "labelled": summary.describe(df.filter(labelled), numeric),
        "unlabelled": summary.describe(df.filter(~labelled), numeric),
        "discrete_means": summary.compare_means(df, discrete, cat.target),
        "continuous_means": summary.compare_means(df, continuous, cat.target, scale=True),
    }


def weight_by_selection(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE,
                        **options) -> DataFrame:
    """Every row with P(selected | features) and its inverse as weight."""
    features = [c for c in cat.bias_features if c in df.columns]
    out = weights.propensity_logit(
        df, cat.name, cat.target, features, [c for c in cat.encoded if c in features],
        may_be_numeric=[c for c in cat.encoded if c in cat.may_be_null],
        binary=cat.binary, continuous=cat.continuous, **options)
    return cut_lineage(out)


def corrected_reports(weighted: DataFrame, strategies: dict[str, str],
                      cat: Catalogue = DEFAULT_CATALOGUE) -> dict[str, DataFrame]:
    """Prevalence, screening strategies, means, co-occurrence and diagnostics from a weighted table."""
    y = cat.target
    labelled = weighted.filter(F.col(y).isNotNull())
    discrete = [c for c in cat.binary if c in weighted.columns and c not in cat.compounds]
    continuous = [c for c in cat.continuous if c in weighted.columns]
    related = [c for c in discrete if c not in cat.habits] + [y]
    return {
        "prevalence": summary.prevalence_by_group(labelled, cat.family, y, "weight"),
        "positives": summary.estimated_positive_count(labelled, weighted, y, "weight"),
        "precision": summary.strategy_precision(labelled, y, "weight", strategies),
        "accuracy": summary.strategy_accuracy(labelled, y, "weight", strategies),
        "discrete_means": summary.compare_means(weighted, discrete, y, "weight"),
        "continuous_means": summary.compare_means(weighted, continuous, y, "weight", scale=True),
        "cooccurrence": summary.conditional_cooccurrence(weighted, related),
        **{f"propensity_{k}": v for k, v in weights.propensity_diagnostics(weighted, y).items()},
    }


def geography(df: DataFrame, codes: str = "native_tdwg3_codes",
              cat: Catalogue = DEFAULT_CATALOGUE) -> dict[str, DataFrame]:
    """Species per region (all, labelled, active) and the share of active ones."""
    return {
        "counts": regions.species_region_counts(df, codes, cat.target, cat),
        "proportion": regions.proportion_per_region(df, codes, cat.target),
        "proportion_supported": regions.proportion_per_region(df, codes, cat.target, more_than=2),
    }
