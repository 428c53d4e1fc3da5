"""Two-sample tests of a sample against a population.

Work that grows with the rows is aggregated per feature (and value); p-values are computed on the
result of one row per feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from counterpoise.functions.special import (chi2_p_udf, fisher_p_udf, ks_p_udf,
                                            mann_whitney_p_udf)
from counterpoise.operators.prefix import prefix_sums
from counterpoise.session import cut_lineage


def tall_two_samples(first: DataFrame, second: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, in1, in2) of the features both tables have; nulls and NaN left out."""
    both = [c for c in features if c in first.columns and c in second.columns]

    def tall(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select(*[F.col(c).cast("double").alias(c) for c in both]).unpivot(
            [], both, "feature", "value").withColumns({"in1": F.lit(a), "in2": F.lit(b)})

    return _known(tall(first, 1, 0).unionByName(tall(second, 0, 1)))


def tall_labelled_vs_all(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """The same for the labelled rows against all rows of one table, from a single scan."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    tall = df.select(F.col(target).isNotNull().cast("int").alias("in1"), *cols).unpivot(
        ["in1"], features, "feature", "value")
    return _known(tall.withColumn("in2", F.lit(1)))


def _known(tall: DataFrame) -> DataFrame:
    return tall.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def contingency_table(tall: DataFrame) -> DataFrame:
    """2x2 counts per feature: value 1 / 0 in the first (pos1, neg1) and second sample."""
    one, zero = F.col("value") == 1, F.col("value") == 0
    return tall.groupBy("feature").agg(
        F.count_if(one & (F.col("in1") == 1)).alias("pos1"),
        F.count_if(zero & (F.col("in1") == 1)).alias("neg1"),
        F.count_if(one & (F.col("in2") == 1)).alias("pos2"),
        F.count_if(zero & (F.col("in2") == 1)).alias("neg2"))


def chi2_2x2(table: DataFrame, with_p: bool = True) -> DataFrame:
    """Chi-square with continuity correction; null if an expected count is 0."""
    a, b, c, d = (F.col(x).cast("double") for x in ("pos1", "neg1", "pos2", "neg2"))
    n = a + b + c + d
    shrunk = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    # divided step by step, as the product of four margins outgrows exact doubles
    stat = F.try_divide(F.try_divide(shrunk, a + b) * F.try_divide(shrunk, c + d) * n,
                        (a + c) * (b + d))
    out = table.withColumn("chi2_stat", stat)
    return out.withColumn("chi2_p", chi2_p_udf()("chi2_stat")) if with_p else out


def fisher_exact(table: DataFrame, with_p: bool = True) -> DataFrame:
    """Odds ratio and exact two-sided p."""
    a, b, c, d = (F.col(x).cast("double") for x in ("pos1", "neg1", "pos2", "neg2"))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    ratio = (F.when(margins == 0, None)
             .when(b * c == 0, F.lit(float("inf"))).otherwise(F.try_divide(a * d, b * c)))
    out = table.withColumn("fisher_odds_ratio", ratio)
    return out.withColumn("fisher_p", fisher_p_udf()("pos1", "neg1", "pos2", "neg2")) \
        if with_p else out


def value_counts(tall: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per feature and distinct value: counts in both samples and below the value."""
    counted = tall.select("feature", "value", F.col("in1").cast("long").alias("a"),
                          F.col("in2").cast("long").alias("b"))
    return prefix_sums(counted, ["feature"], "value", ["a", "b"], buckets=buckets,
                       force_buckets=buckets is not None)


def continuous_statistics(tall: DataFrame, buckets: int | None = None) -> DataFrame:
    """KS distance, Mann-Whitney U of the first sample and the tie term, per feature."""
    sizes = tall.groupBy("feature").agg(F.sum("in1").alias("n1"), F.sum("in2").alias("n2"))
    per_value = value_counts(tall, buckets).join(F.broadcast(sizes), "feature")  # row per feature
    cdf1 = F.try_divide(F.col("a_before") + F.col("a"), F.col("n1"))
    cdf2 = F.try_divide(F.col("b_before") + F.col("b"), F.col("n2"))
    tied = (F.col("a") + F.col("b")).cast("double")
    return per_value.groupBy("feature").agg(
        F.max("n1").alias("n1"), F.max("n2").alias("n2"),
        F.max(F.abs(cdf1 - cdf2)).alias("ks_statistic"),
        F.sum(F.col("a") * (F.col("b_before") + F.col("b") / 2)).alias("mwu_statistic"),
        F.sum(tied * tied * tied - tied).alias("ties"))


def compare_samples_continuous(tall: DataFrame, buckets: int | None = None,
                               with_p: bool = True) -> DataFrame:
    """KS and Mann-Whitney per continuous feature."""
    stats = continuous_statistics(tall, buckets)
    if not with_p:
        return stats
    return stats.withColumns({
        "ks_p": ks_p_udf()("ks_statistic", "n1", "n2"),
        "mwu_p": mann_whitney_p_udf()("mwu_statistic", F.col("n1").cast("double"),
                                      F.col("n2").cast("double"), "ties")})


def compare_samples_discrete(tall: DataFrame, binary: list[str], with_p: bool = True) -> DataFrame:
    """Chi-square and Fisher per binary feature; Mann-Whitney for the others (null for binary)."""
    is_binary = F.col("feature").isin(binary)
    tables = fisher_exact(chi2_2x2(contingency_table(tall.filter(is_binary)), with_p), with_p)
    tests = [c for c in ("chi2_stat", "chi2_p", "fisher_odds_ratio", "fisher_p")
             if c in tables.columns]
    out = tables.select("feature", *tests)
    rest = compare_samples_continuous(tall.filter(~is_binary), with_p=with_p)
    return out.unionByName(rest.select(
        "feature", "mwu_statistic", *(["mwu_p"] if with_p else [])), allowMissingColumns=True)


def compare_distributions(tall: DataFrame, continuous: list[str], discrete: list[str],
                          with_p: bool = True) -> DataFrame:
    """Both comparisons in one table; the feature sets are disjoint."""
    c = compare_samples_continuous(tall.filter(F.col("feature").isin(continuous)), with_p=with_p)
    c = c.withColumnRenamed("mwu_p", "mwu_p_value").drop("n1", "n2", "ties")
    d = compare_samples_discrete(tall.filter(F.col("feature").isin(discrete)), discrete, with_p)
    return c.unionByName(d, allowMissingColumns=True)


def stepdown_rank(df: DataFrame, p_value: str, key: str, out: str = "position") -> DataFrame:
    """Position from 0 by ascending p, nulls last, ties by key; for tables of one row per test."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(p_value).asc_nulls_last(), F.col(key))
    return df.withColumn(out, F.row_number().over(order) - 1)


def holm(df: DataFrame, p_value: str = "p_value", key: str = "feature",
         out: str = "corrected_p_value") -> DataFrame:
    """p times (number of tests - position): neither made monotone nor capped at 1."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return (stepdown_rank(df, p_value, key, "_position")
            .withColumn(out, F.col(p_value) * (n - F.col("_position"))).drop("_position")
            .orderBy(F.col(p_value).asc_nulls_last(), key))


def p_values_for_holm(comparison: DataFrame) -> DataFrame:
    """KS p of continuous features stacked on the chi-square p of the others (feature, p_value)."""
    known = F.col("ks_p").isNotNull()
    return comparison.filter(known).select("feature", F.col("ks_p").alias("p_value")).unionByName(
        comparison.filter(~known).select("feature", F.col("chi2_p").alias("p_value")))


def selection_bias_report(df: DataFrame, target: str, continuous: list[str],
                          discrete: list[str]) -> tuple[DataFrame, DataFrame]:
    """Labelled rows against all rows: the comparison, and its Holm-corrected p-values."""
    tall = tall_labelled_vs_all(df, continuous + discrete, target)
    # one row per feature, used for the p-values, their number and the report
    comparison = cut_lineage(compare_distributions(tall, continuous, discrete))
    return comparison, holm(p_values_for_holm(comparison))
