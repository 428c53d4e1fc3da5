"""Joins of a large table with a table of one row per key, safe under hot keys.

The keyed table is written to the shared folder and counted first.  Up to ``BROADCAST_ROWS`` rows it is
broadcast, and the large table is not moved at all.  Beyond that, a plain shuffle join would send all
rows of one key to one task; and where the right side is itself a ``groupBy`` on the key, adaptive skew
splitting does not apply, as the aggregate's partitioning is reused.  So the keys that hold more than
``1/parts`` of the rows are found by an aggregate; there can be at most ``parts`` of them, so they and
their values are broadcast with a proven bound.  The other keys are joined by shuffle, and rows that
were served already, or have a null key, are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.session import cut_lineage

BROADCAST_ROWS = 250_000
HOT_PARTS = 4096
HOT_MIN_ROWS = 100_000
_SPREAD = 65_536


def key_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key; partial counts are merged before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def hot_only(counts: DataFrame, parts: int = HOT_PARTS, floor: int = HOT_MIN_ROWS) -> DataFrame:
    """Rows of ``counts`` (one per key, with ``_n``) whose key holds more than 1/parts of all rows.

    At most ``parts`` rows can qualify.
    """
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter((F.col("_n") > floor) & (F.col("_n") * parts > total))


def _same(left: str, right: str, null_safe: bool) -> Column:
    a, b = F.col(left), F.col(right)
    return a.eqNullSafe(b) if null_safe else a == b


def lookup(left: DataFrame, table: DataFrame, on: dict[str, str] | list[str], values: list[str],
           count: str | None = None, base: DataFrame | None = None, null_safe: bool = False,
           unique_left: bool = False, stored: bool = False, broadcast_rows: int = BROADCAST_ROWS,
           parts: int = HOT_PARTS, floor: int = HOT_MIN_ROWS) -> DataFrame:
    """Left join ``values`` of ``table`` (unique per key) to ``left``; the row count is unchanged.

    ``on`` maps left to right key columns.  ``count`` names a column of ``table`` with the rows per key
    in ``left``; without it they are counted if needed, on ``base`` (a cheaper table with the same
    keys) or on ``left``.  With ``unique_left`` the left keys are unique too, so no key can be hot.
    ``stored`` says that ``table`` is read from storage as it is.
    """
    pairs = list((on if isinstance(on, dict) else {c: c for c in on}).items())
    keep = [F.col(c) for c in left.columns if c not in values]
    keys = [f"_k{i}" for i in range(len(pairs))]
    cold = table.select(
        *[F.col(r).alias(k) for k, (_, r) in zip(keys, pairs)],
        *[F.col(v).alias(f"_v_{v}") for v in values],
        *([F.col(count).alias("_n")] if count else []))
    if not stored:
        cold = cut_lineage(cold)
    same = [_same(l, k, null_safe) for k, (l, _) in zip(keys, pairs)]
    small = cold.count() <= broadcast_rows
    if small:
        return left.select(*keep).join(F.broadcast(cold.drop("_n")), on=same, how="left").select(
            *keep, *[F.col(f"_v_{v}").alias(v) for v in values])

    # The partition number is the same again when a task is retried, unlike a random salt.
    spread = F.pmod(F.spark_partition_id().cast("long") * 7919, F.lit(_SPREAD))
    bucket = F.pmod(F.xxhash64(*[F.col(l) for l, _ in pairs]), F.lit(_SPREAD))
    keyed = cold.drop("_n").withColumn(
        "_cold_bucket", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(_SPREAD)))
    unkeyed = F.lit(False)
    if not null_safe:
        for l, _ in pairs:
            unkeyed = unkeyed | F.col(l).isNull()
    in_bucket = F.col("_bucket") == F.col("_cold_bucket")
    if unique_left:
        return left.select(*keep).withColumn(
            "_bucket", F.when(unkeyed, -1 - spread).otherwise(bucket)
        ).join(keyed, on=[in_bucket, *same], how="left").select(
            *keep, *[F.col(f"_v_{v}").alias(v) for v in values])

    counts = cold if count else key_counts((left if base is None else base).select(
        *[F.col(l).alias(k) for k, (l, _) in zip(keys, pairs)]), keys)
    hot_names = [f"_h{i}" for i in range(len(pairs))]
    hot = hot_only(counts, parts, floor).select(
        *[F.col(k).alias(h) for k, h in zip(keys, hot_names)])
    hot_values = hot.join(
        cold, on=[_same(h, k, null_safe) for k, h in zip(keys, hot_names)], how="left"
    ).select(*hot_names, *[F.col(f"_v_{v}").alias(f"_hv_{v}") for v in values],
             F.lit(True).alias("_hot"))
    served = F.coalesce(F.col("_hot"), F.lit(False)) | unkeyed
    flagged = (left.select(*keep)
               .join(F.broadcast(hot_values),
                     on=[_same(l, h, null_safe) for h, (l, _) in zip(hot_names, pairs)],
                     how="left")
               .withColumn("_bucket", F.when(served, -1 - spread).otherwise(bucket)))
    return flagged.join(keyed, on=[in_bucket, *same], how="left").select(
        *keep, *[F.coalesce(F.col(f"_hv_{v}"), F.col(f"_v_{v}")).alias(v) for v in values])
