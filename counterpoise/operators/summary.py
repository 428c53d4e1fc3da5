"""Summaries of one table: describe, prevalence, screening strategies, co-occurrence, means, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.functions.scalars import (equality_flag, round_half_even_2, tidy_text,
                                            weighted_mean)
from counterpoise.operators.quantiles import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if t in kinds or t.startswith("decimal")]


def describe(df: DataFrame, columns: list[str] | None = None,
             by: DataFrame | None = None) -> DataFrame:
    """Count, mean, sd (n-1), min, quartiles and max, one row per column.

    All but the quartiles is one aggregate; the quartiles are exact.
    """
    cols = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs: list[Column] = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(c).alias(f"n{i}"), F.avg(x).alias(f"a{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"),
                 F.max(x).alias(f"hi{i}")]
    cells = F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"n{i}").alias("count"), F.col(f"a{i}").alias("mean"),
        F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
        *[F.lit(q).cast("double").alias(name)
          for q, name in zip(quartiles[c], ("q25", "q50", "q75"))],
        F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.inline(cells))


def describe_small(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Describe per group for score tables, whose groups are bounded by the number of folds."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*groups).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("_q"),
        F.max(value).alias("max")
    ).select(*groups, "count", "mean", "std", "min", F.col("_q")[0].alias("q25"),
             F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max")


def prevalence_by_group(df: DataFrame, group: str, target: str, weight: str,
                        everything: str = "All") -> DataFrame:
    """Raw and weighted mean of the target per group and over all rows, in one pass."""
    label = F.when(F.grouping(group) == 1, F.lit(everything)).otherwise(F.col(group))
    return (df.filter(F.col(target).isNotNull())
            .groupingSets([[F.col(group)], []], F.col(group))
            .agg(label.alias("label"), F.avg(target).alias("uncorrected"),
                 weighted_mean(target, weight).alias("corrected"),
                 F.count(target).alias("n_labelled"))
            .select(F.col("label").alias(group), "uncorrected", "corrected", "n_labelled"))


def estimated_positive_count(labelled: DataFrame, population: DataFrame, target: str,
                             weight: str) -> DataFrame:
    """Weighted mean of the labelled target times the population size."""
    size = population.agg(F.count(F.lit(1))).scalar()
    return labelled.agg(weighted_mean(target, weight).alias("corrected_mean")).select(
        "corrected_mean", size.alias("population"),
        (F.col("corrected_mean") * size).alias("estimated_positives"))


def strategy_precision(df: DataFrame, target: str, weight: str,
                       strategies: dict[str, str]) -> DataFrame:
    """Raw and weighted mean target where a feature is 1; "Random" takes all rows.

    ``strategies`` maps a name to its feature.
    """
    y, w = F.col(target), F.col(weight)
    aggs, names = [], {"Random": F.lit(True)}
    names.update({n: F.coalesce(F.col(f) == 1, F.lit(False)) for n, f in strategies.items()})
    for i, on in enumerate(names.values()):
        aggs += [F.avg(F.when(on, y)).alias(f"u{i}"),
                 weighted_mean(F.when(on, y), w).alias(f"c{i}")]
    cells = F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"u{i}").alias("uncorrected"),
                               F.col(f"c{i}").alias("corrected")) for i, n in enumerate(names)])
    return df.filter(y.isNotNull()).agg(*aggs).select(F.inline(cells))


def strategy_result(df: DataFrame, feature: str, target: str, weight: str) -> DataFrame:
    """Per row: feature, target, whether they agree (unknown never does), and the weight."""
    return df.select(feature, target, equality_flag(feature, target).alias("result"), weight)


def strategy_accuracy(df: DataFrame, target: str, weight: str,
                      strategies: dict[str, str]) -> DataFrame:
    """Raw and weighted share of rows where feature and target agree; "Random" is 0.5."""
    aggs = []
    for i, f in enumerate(strategies.values()):
        hit = equality_flag(f, target).cast("double")
        aggs += [F.avg(hit).alias(f"u{i}"), weighted_mean(hit, weight).alias(f"c{i}")]
    half = F.struct(F.lit("Random").alias("strategy"), F.lit(0.5).alias("uncorrected"),
                    F.lit(0.5).alias("corrected"))
    cells = F.array(half, *[
        F.struct(F.lit(n).alias("strategy"), F.col(f"u{i}").alias("uncorrected"),
                 F.col(f"c{i}").alias("corrected")) for i, n in enumerate(strategies)])
    return df.agg(*aggs).select(F.inline(cells))


def conditional_cooccurrence(df: DataFrame, variables: list[str],
                             everything: str = "All Species") -> DataFrame:
    """P(var2 = 1 | var1 = 1) among rows with both known, for every ordered pair.

    Null on the diagonal, 0 where var1 never occurs; a last var1 stands for all rows.  ``ratio`` is
    unrounded, ``value`` has 2 decimals.  All counts come from one aggregate.
    """
    ones = {v: F.col(v) == 1 for v in variables}
    known = {v: F.col(v).isNotNull() for v in variables}
    ones[everything], known[everything] = F.lit(True), F.lit(True)
    pairs = [(a, b) for a in [*variables, everything] for b in variables]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [F.count_if(ones[a] & known[b]).alias(f"n{i}"),
                 F.count_if(ones[a] & ones[b]).alias(f"m{i}")]
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n"),
                               F.col(f"m{i}").alias("m")) for i, (a, b) in enumerate(pairs)])
    ratio = (F.when(F.col("n") == 0, 0.0).when(F.col("a") != F.col("b"),
                                               F.try_divide(F.col("m"), F.col("n"))))
    return (df.agg(*aggs).select(F.inline(cells))
            .select(tidy_text("a").alias("var1"), tidy_text("b").alias("var2"),
                    ratio.alias("ratio"))
            .withColumn("value", round_half_even_2("ratio")))


def cooccurrence_matrix(pairs: DataFrame, value: str = "value") -> DataFrame:
    """Pivot of the pair table: one row per var2, one column per var1."""
    return pairs.groupBy("var2").pivot("var1").agg(F.first(value))


def mean_target_by_presence(df: DataFrame, binary: list[str], target: str) -> DataFrame:
    """Mean target where each binary trait is 1 and where it is 0."""
    aggs = [F.avg(F.when(F.col(c) == v, F.col(target))).alias(f"m{v}_{i}")
            for i, c in enumerate(binary) for v in (1, 0)]
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m1_{i}").alias("presence"),
                               F.col(f"m0_{i}").alias("absence")) for i, c in enumerate(binary)])
    return df.agg(*aggs).select(F.inline(cells))


def trait_means_by_class(df: DataFrame, traits: list[str], target: str) -> DataFrame:
    """Mean of each trait among active (1) and inactive (0) rows."""
    y = F.col(target)
    aggs = [F.avg(F.when(y == v, F.col(c))).alias(f"m{v}_{i}")
            for i, c in enumerate(traits) for v in (1, 0)]
    cells = F.array(*[F.struct(F.lit(c).alias("trait"), F.col(f"m1_{i}").alias("active"),
                               F.col(f"m0_{i}").alias("inactive")) for i, c in enumerate(traits)])
    return df.agg(*aggs).select(F.inline(cells))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """Rows per target value 2, 1 and 0 (active, weak, inactive)."""
    names = {2: "Active", 1: "Weak", 0: "Inactive"}
    cells = F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"n{v}").alias("n"))
                      for v, n in names.items()])
    return df.agg(*[F.count_if(F.col(target) == v).alias(f"n{v}") for v in names]).select(
        F.inline(cells))


def _scaled(mean: Column, low: Column, high: Column, scale: bool) -> Column:
    if not scale:
        return mean
    width = high - low
    return (mean - low) / F.when(width == 0, 1.0).otherwise(width)


def compare_means(df: DataFrame, features: list[str], target: str, weight: str | None = None,
                  scale: bool = False) -> DataFrame:
    """Means in the labelled rows, (weighted) corrected, and in the population.

    With ``scale`` they are min-max scaled by the population's limits: the scaled mean is the scaling
    of the mean, so no row is rewritten.
    """
    labelled = F.col(target).isNotNull()
    aggs = []
    for i, c in enumerate(features):
        x = F.col(c).cast("double")
        aggs += [F.avg(F.when(labelled, x)).alias(f"l{i}"), F.avg(x).alias(f"p{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if weight:
            aggs.append(weighted_mean(F.when(labelled, x), F.when(labelled, F.col(weight)))
                        .alias(f"c{i}"))
    cells = []
    for i, c in enumerate(features):
        kinds = {"labelled": f"l{i}", **({"corrected": f"c{i}"} if weight else {}),
                 "population": f"p{i}"}
        cells.append(F.struct(F.lit(c).alias("feature"), *[
            _scaled(F.col(k), F.col(f"lo{i}"), F.col(f"hi{i}"), scale).alias(n)
            for n, k in kinds.items()]))
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def mean_propensity_by_class(df: DataFrame, target: str, propensity: str) -> DataFrame:
    return trait_means_by_class(df, [propensity], target).select("active", "inactive")


def histogram(df: DataFrame, value: str, width: float | None = None, bins: int | None = None,
              by: str | None = None) -> DataFrame:
    """Counts per bin from the smallest value on, by bin width or number of equal bins.

    The last bin is closed on the right.
    """
    if (width is None) == (bins is None):
        raise ValueError("give either width or bins")
    x = F.col(value)
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        last = 0
        low = high = 0.0
    elif width is not None:
        last = max(0, int(-(-(high - low) // width)) - 1)
    else:
        last = bins - 1
    step = width if width is not None else (high - low) / bins
    number = (F.floor((x - F.lit(low)) / F.lit(step or 1.0)) if step else F.lit(0)).cast("bigint")
    number = F.least(number, F.lit(last).cast("bigint"))
    groups = [number.alias("bin")] + ([F.col(by)] if by else [])
    return (df.filter(x.isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("left_edge", F.lit(low) + F.col("bin") * F.lit(step)))


def boxplot_stats(scores: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and whiskers (furthest values within 1.5 IQR) per model of a score table."""
    box = describe_small(scores, [group], value).select(group, "q25", "q50", "q75")
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return (scores.join(box, on=group)
            .groupBy(group, "q25", "q50", "q75")
            .agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"),
                 F.max(F.when(inside, F.col(value))).alias("whisker_high"),
                 F.count_if(~inside).alias("n_outliers")))


def fold_score_summary(scores: DataFrame, model: str = "model", metric: str = "metric",
                       value: str = "value") -> DataFrame:
    """Describe per model and metric of the tall fold-score table."""
    return describe_small(scores, [model, metric], value)


def fold_score_table(scores: DataFrame, metric: str, models: list[str]) -> DataFrame:
    """One metric with a column per model, a row per fold."""
    return (scores.filter(F.col("metric") == metric).groupBy("rep", "fold")
            .pivot("model", models).agg(F.first("value")))


def surprise_report(unlabelled: DataFrame, labelled: DataFrame, propensity: str, prediction: str,
                    target: str, low: float, high: float) -> DataFrame:
    """Predicted positives among rows whose propensity lies below the unlabelled median; the same
    scaled by a confidence interval of the precision; and the labelled truth there.
    """
    median = exact_quantiles(unlabelled, [propensity], [0.5])[propensity][0]
    rare = F.col(propensity) < F.lit(median)

    def part(df: DataFrame, column: str) -> DataFrame:
        return df.filter(rare).agg(F.sum(column).cast("double").alias("num"),
                                   F.avg(column).alias("rate"), F.count(F.lit(1)).alias("len"))

    cells = F.array(*[F.struct(F.lit(n).alias("case"), (F.col("num") * k).alias("num"),
                               (F.col("rate") * k).alias("rate"), F.col("len").alias("len"))
                      for n, k in (("unlabelled", 1.0), ("upperlim", high), ("lowerlim", low))])
    known = part(labelled, target).select(F.lit("labelled").alias("case"), "num", "rate", "len")
    return part(unlabelled, prediction).select(F.inline(cells)).unionByName(known)
