"""Bootstrap confidence interval of a mean."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from counterpoise.session import cut_lineage

SMALL = 20_000          # distinct values that one task draws from, about
_CELLS = 1_000_000      # counts drawn at once


def _dealt(sizes: np.ndarray, block: int, replicates: int, seed: int) -> np.ndarray:
    """How many of each replicate's draws fall on rows of ``block``.

    The draws are split in two again and again, each split seeded by its place, so all tasks agree on them.
    """
    ends = np.r_[0, np.cumsum(sizes)]
    low, high, draws = 0, len(sizes), np.full(replicates, ends[-1])
    while high - low > 1:
        mid = (low + high) // 2
        share = (ends[mid] - ends[low]) / (ends[high] - ends[low])
        left = np.random.default_rng((seed, low, high)).binomial(draws, share)
        if block < mid:
            draws, high = left, mid
        else:
            draws, low = draws - left, mid
    return draws


def _replicates(known: DataFrame, value: str, replicates: int, seed: int) -> DataFrame:
    """Means of as many rows drawn with replacement as there are: (rep, mean).

    Rows are counted by value first, so equal values cost one, and a value's number of draws is part of a
    multinomial; values are dealt to blocks by hash.
    """
    counted = cut_lineage(known.groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n")))
    blocks = -(-counted.count() // SMALL)
    counted = counted.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    sizes = np.zeros(blocks, dtype=np.int64)
    for row in counted.groupBy("block").agg(F.sum("n").alias("n")).collect():    # one number per block
        sizes[row["block"]] = row["n"]

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame, block = frame.sort_values("v"), int(frame["block"].iloc[0])
        values, counts = frame["v"].to_numpy(), frame["n"].to_numpy()
        draws = _dealt(sizes, block, replicates, seed)
        rng, step = np.random.default_rng((seed, block, block)), max(1, _CELLS // len(values))
        totals = [rng.multinomial(draws[at:at + step], counts / counts.sum()) @ values
                  for at in range(0, replicates, step)]
        return pd.DataFrame({"rep": np.arange(replicates), "total": np.concatenate(totals)})

    return (counted.groupBy("block").applyInPandas(draw, "rep int, total double")
            .groupBy("rep").agg((F.sum("total") / F.lit(float(sizes.sum()))).alias("mean")))


def bootstrap_mean_ci(df: DataFrame, value: str, confidence: float = 0.95,
                      replicates: int = 9999, seed: int = 0) -> DataFrame:
    """Bias-corrected and accelerated interval (mean, low, high), by one method at every size.

    Null values are left out.  The limits are null where there is no value or all are equal.
    """
    known = df.filter(F.col(value).isNotNull())
    n, mean, skew = known.agg(F.count(value), F.avg(value), F.skewness(value)).first()
    spark = df.sparkSession
    schema = "mean double, low double, high double"
    if not n or skew is None or skew != skew:
        return spark.createDataFrame([(mean, None, None)], schema)
    means = cut_lineage(_replicates(known, value, replicates, seed))
    below, tied = means.agg(F.count_if(F.col("mean") < mean),
                            F.count_if(F.col("mean") == mean)).first()
    normal = NormalDist()
    share = min(max((below + tied / 2) / replicates, 1e-9), 1 - 1e-9)
    shift = normal.inv_cdf(share)
    accel = skew / (6 * math.sqrt(n))
    at = []
    for tail in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = shift + normal.inv_cdf(tail)
        at.append(normal.cdf(shift + z / (1 - accel * z)))
    # ``replicates`` numbers, a bound that does not grow with the data
    return means.agg(F.percentile("mean", F.array(F.lit(at[0]), F.lit(at[1]))).alias("q")).select(
        F.lit(mean).alias("mean"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
