"""v_weighted: v_part with the share selected per (family, x) cell and its inverse as weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from counterpoise.operators.weights import saturated_propensity
from workload.views import v_part


def v_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saturated_propensity(v_part(spark, sf_dir), "y", ["family", "x"])
