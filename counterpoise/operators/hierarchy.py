"""Values shared within a species or genus, first rows and duplicates.

Groups are never gathered in one task: each operator aggregates per key (partial sums before the
shuffle) and hands the result back by the skew-safe lookup.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE
from counterpoise.operators.skew import key_counts, lookup


def resolve_to_species(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE,
                       target: str | None = None) -> DataFrame:
    """Give each row the largest target of its species, then keep species-rank rows only."""
    y = target or cat.target
    best = (df.dropna(subset=[cat.species]).groupBy(cat.species)
            .agg(F.max(y).alias("_best"), F.count_if(F.col(cat.rank) == cat.species_rank)
                 .alias("_n")))
    kept = df.filter(F.col(cat.rank) == cat.species_rank)
    out = lookup(kept, best, [cat.species], ["_best"], count="_n")
    value = F.when(F.col(cat.species).isNotNull(), F.col("_best")).otherwise(F.col(y))
    return out.withColumn(y, value).select(*df.columns)


def genus_evidence(df: DataFrame, variables: list[str], genus: str) -> DataFrame:
    """Per genus: whether any row is 1, or any is 0, for each variable; with the row count."""
    return df.dropna(subset=[genus]).groupBy(genus).agg(
        *[F.when(F.max((F.col(v) == 1).cast("int")) == 1, 1.0)
          .when(F.max((F.col(v) == 0).cast("int")) == 1, 0.0).alias(f"_g_{v}")
          for v in variables],
        F.count(F.lit(1)).alias("_n"))


def fill_from_genus(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE,
                    variables: list[str] | None = None, keep_before: bool = False) -> DataFrame:
    """Fill nulls of genus-level variables with 1 if any row of the genus has 1, else 0 if any has 0.

    ``keep_before`` adds the old values as ``before_<variable>``.
    """
    asked = cat.genus_level if variables is None else variables
    present = [v for v in asked if v in df.columns]
    if len(present) < len(asked):
        warnings.warn(f"variables not in the table: {sorted(set(asked) - set(present))}",
                      stacklevel=2)
    if not present:
        return df
    evidence = genus_evidence(df, present, cat.genus)
    out = lookup(df, evidence, [cat.genus], [f"_g_{v}" for v in present], count="_n")
    types = dict(df.dtypes)
    filled = {v: F.coalesce(F.col(v), F.col(f"_g_{v}").cast(types[v])) for v in present}
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns],
                      *[F.col(v).alias(f"before_{v}") for v in present if keep_before])


def change_report(df: DataFrame, variables: list[str], keys: list[str],
                  prefix: str = "before_") -> DataFrame:
    """Changed cells (keys, variable, before, after) of a table that carries the old values."""
    cells = F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"{prefix}{v}").cast("double").alias("before"),
                 F.col(v).cast("double").alias("after")) for v in variables])
    return df.select(*keys, F.inline(cells)).filter(~F.col("before").eqNullSafe(F.col("after")))


def keep_first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row of each key in the given order; a null key is a key like any other."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c)
                      for c in df.columns]))


def duplicated_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """All rows whose values in ``columns`` occur more than once; nulls equal nulls."""
    repeated = key_counts(df, columns).filter("_n > 1").withColumn("_dup", F.lit(True))
    return lookup(df, repeated, columns, ["_dup"], count="_n",
                  null_safe=True).filter("_dup").select(*df.columns)


def later_duplicates(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Duplicate rows other than the first of each group; ``order`` is unique per row."""
    first = df.groupBy(*columns).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return lookup(df, first.filter("_n > 1"), columns, ["_first"], count="_n",
                  null_safe=True).filter(
        F.col(order) > F.col("_first")).select(*df.columns)


def require_no_twins(df: DataFrame, columns: list[str]) -> None:
    """Raise if two rows agree in all of ``columns``."""
    twin = key_counts(df, columns).filter("_n > 1").limit(1).collect()
    if twin:
        raise ValueError(f"rows with equal features: {twin[0].asDict()}")


def attach_group_size(df: DataFrame, columns: list[str], out: str = "size") -> DataFrame:
    """Number of rows with the same values in ``columns`` (nulls equal), on every row."""
    sizes = key_counts(df, columns).withColumn(out, F.col("_n"))
    return lookup(df, sizes, columns, [out], count="_n", null_safe=True)


def combination_frequency(df: DataFrame, columns: list[str], out: str = "P(x)") -> DataFrame:
    """Share of all rows that have the row's combination of values."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return attach_group_size(df, columns, "size").withColumn(out, F.col("size") / total)
