"""Reading tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE
from counterpoise.operators.cleaning import nan_to_null, require_columns


def _read(spark: SparkSession, path: str, fmt: str, schema: StructType | str | None) -> DataFrame:
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_tables(spark: SparkSession, paths: list[str], fmt: str = "csv",
                schema: StructType | str | None = None, drop_index: bool = False,
                order: str | None = "row_order") -> DataFrame:
    """Stack tables by column name; a column that one of them lacks is null there.

    ``drop_index`` discards the first column of each.  ``order`` names a column that sorts like the
    rows of the files, one after the other.
    """
    frames = []
    for number, path in enumerate(paths):
        df = _read(spark, path, fmt, schema)
        columns = df.columns[1:] if drop_index else df.columns
        if order is None:
            frames.append(df.select(*columns))
            continue
        # within a file block the running number follows the lines
        within = (F.struct(F.col("_metadata.row_index").alias("block"), F.lit(0).cast("bigint")
                           .alias("line")) if fmt == "parquet"
                  else F.struct(F.col("_metadata.file_block_start").alias("block"),
                                F.monotonically_increasing_id().alias("line")))
        frames.append(df.select(*columns, F.struct(
            F.lit(number).alias("source"), F.col("_metadata.file_path").alias("file"),
            within.alias("at")).alias(order)))
    return nan_to_null(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))


def read_trait_table(spark: SparkSession, path: str, columns: list[str] | None = None,
                     fmt: str = "parquet", schema: StructType | str | None = None,
                     cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """The finished table: its key and the analysis variables only."""
    df = _read(spark, path, fmt, schema)
    wanted = columns or [*cat.bias_features, cat.target]
    require_columns(df, [cat.name, *wanted])
    return nan_to_null(df.select(cat.name, *[c for c in wanted if c != cat.name]))


def taxa_checklist(spark: SparkSession, path: str, families: list[str],
                   ranks: list[str] | None = None, accepted: bool | None = True,
                   fmt: str = "parquet", family: str = "family", rank: str = "rank",
                   status: str = "accepted") -> DataFrame:
    """Checklist rows of the families and ranks; ``accepted`` filters on the status flag."""
    df = _read(spark, path, fmt, None)
    keep = F.col(family).isin(families)
    if ranks is not None:
        keep = keep & F.col(rank).isin(ranks)
    if accepted is not None and status in df.columns:
        keep = keep & (F.col(status) == accepted)
    return df.filter(keep)


def read_fold_scores(spark: SparkSession, path: str, model: str, metric: str,
                     fmt: str = "parquet") -> DataFrame:
    """One model's scores of one metric per fold, from the tall score table."""
    df = _read(spark, path, fmt, None)
    return df.filter((F.col("model") == model) & (F.col("metric") == metric)).select(
        "rep", "fold", "value")
