"""Writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                single_file: bool = False, partition_by: list[str] | None = None) -> None:
    """Write a result.  ``single_file`` is for small reports only."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_catalogue(spark: SparkSession, path: str, cat: Catalogue = DEFAULT_CATALOGUE) -> None:
    """The variable groups as a table (variable_group, position, variable)."""
    write_table(cat.table(spark), path, single_file=True)
