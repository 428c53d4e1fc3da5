"""Checks on finished tables.  Each returns the violations; an empty result means the check holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.operators.skew import key_counts


def known_set_differences(df: DataFrame, key: str, flag: str, source: DataFrame,
                          source_key: str | None = None) -> DataFrame:
    """Keys flagged 1 but not in the source set, and the reverse (key, side)."""
    flagged = df.filter(F.col(flag) == 1).select(F.col(key).alias("key")).distinct()
    expected = source.select(F.col(source_key or key).alias("key")).dropna().distinct()
    sides = flagged.withColumn("f", F.lit(1)).unionByName(expected.withColumn("f", F.lit(2)))
    return (sides.groupBy("key").agg(F.sum("f").alias("f")).filter("f < 3")
            .select("key", F.when(F.col("f") == 1, "table only").otherwise("source only")
                    .alias("side")))


def same_members(a: DataFrame, b: DataFrame) -> Column:
    """True if two one-column tables hold the same set of values (a scalar to select)."""
    one = a.select(F.col(a.columns[0]).alias("v")).distinct()
    two = b.select(F.col(b.columns[0]).alias("v")).distinct()
    both = one.exceptAll(two).unionByName(two.exceptAll(one))
    return (both.agg(F.count(F.lit(1))).scalar() == 0)


def implication_violations(df: DataFrame, when: Column, then: Column) -> DataFrame:
    """Rows where ``when`` holds and ``then`` does not (unknown counts as not)."""
    return df.filter(F.coalesce(when, F.lit(False)) & ~F.coalesce(then, F.lit(False)))


def column_type_differences(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Columns that are absent, extra or of another type (column, expected, found)."""
    found = dict(df.dtypes)
    rows = [(c, expected.get(c), found.get(c)) for c in sorted(set(expected) | set(found))
            if expected.get(c) != found.get(c)]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string")


def varying_groups(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Groups in which a column takes more than one value, null counting as one (group, column)."""
    marks = df.dropna(subset=[group]).groupBy(group).agg(*[
        (~(F.min(c).eqNullSafe(F.max(c)) &
           F.count(c).isin(F.lit(0), F.count(F.lit(1))))).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("varies"))
                      for c in columns])
    return marks.select(group, F.inline(cells)).filter("varies").drop("varies")


def null_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls per column (column, n_null), by one aggregate."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null"))
                      for i, c in enumerate(columns)])
    return row.select(F.inline(cells))


def non_integral_cells(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Cells whose value differs from its rounding (keys, column, value)."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                      for c in columns])
    return df.select(*keys, F.inline(cells)).filter(F.col("value") != F.rint("value"))


def not_in_own_list(df: DataFrame, value: str, members: str) -> DataFrame:
    """Rows whose value is not in their own array, or where just one of the two is null."""
    one_null = F.col(value).isNull() != F.col(members).isNull()
    return df.filter(one_null | ~F.coalesce(F.array_contains(members, F.col(value)), F.lit(True)))


def bounds_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Least and largest value per column against its limits (column, low, high, ok)."""
    row = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(bounds)
                   for n, f in (("lo", F.min), ("hi", F.max))])
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("low"),
                 F.col(f"hi{i}").alias("high"),
                 F.coalesce((F.col(f"lo{i}") >= b[0]) & (F.col(f"hi{i}") <= b[1]), F.lit(True))
                 .cast("int").alias("ok"))
        for i, (c, b) in enumerate(bounds.items())])
    return row.select(F.inline(cells))


def unexpected_cells(df: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """Cells that differ from an expectation table (key, variable, expected); also absent keys."""
    variables = [r[0] for r in expected.select("variable").distinct().collect()]
    cells = F.array(*[F.struct(F.lit(v).alias("variable"),
                               F.col(v).cast("string").alias("found")) for v in variables])
    tall = df.join(expected.select(key).distinct(), on=key, how="left_semi").select(
        key, F.inline(cells))
    return (expected.select(key, "variable", F.col("expected").cast("string").alias("expected"))
            .join(tall, on=[key, "variable"], how="left")
            .filter(~F.col("found").eqNullSafe(F.col("expected"))))


def partition_counts(whole: DataFrame, *parts: DataFrame) -> DataFrame:
    """Rows of the whole, of the parts together, and whether they agree."""
    tagged = [whole.select(F.lit(0).alias("part"))]
    tagged += [p.select(F.lit(1).alias("part")) for p in parts]
    return reduce(DataFrame.unionByName, tagged).agg(
        F.count_if(F.col("part") == 0).alias("n_whole"), F.count_if(F.col("part") == 1).alias("n_parts")
    ).withColumn("ok", (F.col("n_whole") == F.col("n_parts")).cast("int"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once (keys, n)."""
    return key_counts(df, keys).filter("_n > 1").withColumnRenamed("_n", "n")


def empty_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that are null in all of ``columns``."""
    return df.filter(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull())


def domain_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the allowed set and how often they occur; null is outside."""
    inside = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.filter(~inside).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
