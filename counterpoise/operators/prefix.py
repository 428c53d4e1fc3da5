"""Global orderings without a one-task window.

Values are cut into buckets by a pure function of the value, so every bucket is ordered by itself and
the sums of the buckets before it are added.  Bucket limits are quantile estimates, fetched once to
the driver (``buckets`` numbers per group) and used as literals: a recomputed task gets the same
bucket.  A value that fills many quantiles is still one row once values are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from counterpoise.session import default_buckets

ONE_TASK_ROWS = 1_000_000


def _limits(df: DataFrame, group: list[str], value: str,
            buckets: int) -> tuple[list[tuple], bool]:
    """Per group the rows and the distinct quantile estimates of ``value``."""
    at = double_array([i / buckets for i in range(1, buckets)])
    rows = df.groupBy(*group).agg(F.count(value).alias("n"),
                                  F.percentile_approx(value, at, 10_000).alias("q")).collect()
    out = [(*row[:len(group)], sorted(set(row["q"] or []))) for row in rows]
    return out, max((row["n"] for row in rows), default=0) > ONE_TASK_ROWS


def with_bucket(df: DataFrame, group: list[str], value: str, buckets: int | None = None,
                force: bool = False) -> DataFrame | None:
    """Add ``_bucket``, which grows with ``value`` within a group; None if no group needs it."""
    count = buckets or default_buckets(df.sparkSession)
    limits, large = _limits(df, group, value, count)
    if not (large or force):
        return None
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if not group:
        cuts = [float(v) for v in limits[0][0]]
        return df.withColumn("_bucket", F.coalesce(count_at_most(
            double_array(padded(cuts)), F.col(value), len(cuts)), F.lit(0)))
    schema = ", ".join([f"`_g{i}` {kinds[g]}" for i, g in enumerate(group)]
                       + ["_limits array<double>"])
    longest = max(len(row[-1]) for row in limits)
    fill = [float("inf")] * (len(padded([0.0] * longest)))
    table = df.sparkSession.createDataFrame(                          # groups x buckets numbers
        [(*row[:-1], ([float(v) for v in row[-1]] + fill)[:len(fill)]) for row in limits], schema)
    cond = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    return (df.join(F.broadcast(table), on=cond, how="left")
            .withColumn("_bucket", F.coalesce(
                count_at_most(F.col("_limits"), F.col(value), longest), F.lit(0)))
            .drop("_limits", *[f"_g{i}" for i in range(len(group))]))


def double_array(values: list[float]) -> Column:
    """A literal array, passed to Spark as one text."""
    return F.expr("array(" + ", ".join(
        "double('Infinity')" if v == float("inf") else f"{float(v)!r}D" for v in values) + ")")


def padded(limits: list[float]) -> list[float]:
    """Limits filled up to 2**k - 1 numbers with infinity, for :func:`count_at_most`."""
    return list(limits) + [float("inf")] * ((1 << len(limits).bit_length()) - 1 - len(limits))


def count_at_most(limits: Column, value: Column, length: int) -> Column:
    """How many of the ascending ``limits`` (padded) are at most ``value``, by binary search."""
    steps = [1 << k for k in reversed(range(length.bit_length()))]
    if not steps:
        return F.lit(0)
    x = value.cast("double")
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda acc, s: F.when(
        F.element_at(limits, acc + s) <= x, acc + s).otherwise(acc))


def prefix_sums(df: DataFrame, group: list[str], value: str, measures: list[str],
                descending: bool = False, buckets: int | None = None,
                force_buckets: bool = False) -> DataFrame:
    """One row per (group, value) with the sums of ``measures`` and, as ``<measure>_before``, their
    sums over the values that come earlier in the order.
    """
    cut = with_bucket(df, group, value, buckets, force_buckets)
    bucketed = cut is not None
    keys = [*group, "_bucket"] if bucketed else list(group)
    rows = cut if bucketed else df
    per_value = rows.groupBy(*keys, value).agg(*[F.sum(m).alias(m) for m in measures])
    order = F.col(value).desc() if descending else F.col(value).asc()
    inside = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, -1))
    local = per_value.withColumns({f"{m}_before": F.coalesce(F.sum(m).over(inside), F.lit(0))
                                   for m in measures})
    if not bucketed:
        return local
    # at most groups x buckets rows
    totals = per_value.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    earlier = (Window.partitionBy(*(group or [F.lit(0)])).orderBy(bucket_order)
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_o_{m}") for m in measures])
    cond = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    return local.join(F.broadcast(offsets), on=cond, how="left").select(
        *group, value, *measures,
        *[(F.col(f"{m}_before") + F.col(f"_o_{m}")).alias(f"{m}_before") for m in measures])


def hashed_row_numbers(df: DataFrame, group: list[str], key: str, seed: str,
                       out: str = "position", digits: int | None = None) -> DataFrame:
    """Number the rows of each group from 0 in the order of a hash of their unique key.

    The leading hash digits are the bucket, so the buckets are even by themselves; by default there
    are enough digits (up to 5) for about 200,000 rows per bucket.
    """
    if digits is None:
        rows = df.count()
        digits = next((d for d in range(1, 5) if rows <= 200_000 * 16 ** d), 5)
    hashed = df.withColumn("_hash", F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed))))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, digits))
    keys = [*group, "_bucket"]
    # at most groups x 16**digits rows
    offsets = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(
            Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy("_hash", key)
    cond = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    return (hashed.withColumn("_rn", F.row_number().over(inside))
            .join(F.broadcast(offsets), on=cond, how="left")
            .withColumn(out, F.col("_rn") - 1 + F.col("_offset"))
            .select(*df.columns, out))
