"""Counts per region from arrays of region codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from counterpoise.operators.cleaning import rank_filter
from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE


def count_per_region(df: DataFrame, codes: str, out: str = "n_species") -> DataFrame:
    """Rows that list each region; a code repeated within a row counts once."""
    return (df.select(F.explode(F.array_distinct(codes)).alias("Region"))
            .groupBy("Region").agg(F.count(F.lit(1)).alias(out)))


def region_counts(df: DataFrame, codes: str, target: str) -> DataFrame:
    """All, labelled and active rows per region, from one pass."""
    y = F.col(target)
    return (df.select(F.explode(F.array_distinct(codes)).alias("Region"), y.alias("_y"))
            .groupBy("Region").agg(F.count(F.lit(1)).alias("num_all"),
                                   F.count("_y").alias("num_labelled"),
                                   F.count_if(F.col("_y") == 1).alias("num_active")))


def proportion_per_region(df: DataFrame, codes: str, target: str,
                          more_than: int = 0) -> DataFrame:
    """Active / labelled for regions that have both; ``more_than`` labelled rows."""
    return (region_counts(df, codes, target)
            .filter((F.col("num_active") > 0) & (F.col("num_labelled") > more_than))
            .select("Region", "num_active", "num_labelled",
                    (F.col("num_active") / F.col("num_labelled")).alias("proportion")))


def species_region_counts(df: DataFrame, codes: str, target: str,
                          cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """:func:`region_counts` of species-rank rows, in the order of the region codes."""
    return region_counts(rank_filter(df, cat), codes, target).orderBy("Region")


def multilabel_onehot(df: DataFrame, column: str, labels: list[str], sep: str = "/",
                      unknown: str = "?", nullable: list[str] | None = None,
                      extra: bool = True, max_labels: int = 1000) -> DataFrame:
    """Indicator columns for the labels of a separated text column, which is dropped.

    The ``nullable`` columns (by default ``labels``) are null where the text is null or ``unknown``.
    With ``extra`` labels outside the list get columns too, 0 where unknown.
    """
    from counterpoise.functions.scalars import split_labels
    parts = split_labels(column, sep, unknown)
    names = list(labels)
    if extra:
        found = (df.select(F.explode(parts).alias("label")).distinct()
                 .filter(~F.col("label").isin(names)).orderBy("label").limit(max_labels + 1)
                 .collect())
        if len(found) > max_labels:
            raise ValueError(f"more than {max_labels} labels in {column}")
        names += [r["label"] for r in found]
    missing = set(labels if nullable is None else nullable)
    known = parts.isNotNull()
    columns = {}
    for label in names:
        hit = F.array_contains(parts, label).cast("double")
        columns[label] = F.when(known, hit) if label in missing else F.coalesce(hit, F.lit(0.0))
    return df.withColumns(columns).drop(column)
