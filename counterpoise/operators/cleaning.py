"""Projections, filters and null handling."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, functions as F

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE
from counterpoise.functions.scalars import clean_nan, species_name


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in all floating columns; done once at ingest."""
    return df.withColumns({c: clean_nan(c) for c, t in df.dtypes if t in ("double", "float")})


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; unlike ``DataFrame.drop`` an absent one is an error."""
    require_columns(df, columns)
    return df.drop(*columns)


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def derive_names(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE, epithet: str = "Species",
                 name_copy: str = "Name") -> DataFrame:
    """Add a copy of the accepted name and the species name (genus and epithet)."""
    return df.withColumns({name_copy: F.col(cat.name),
                           cat.species: species_name(cat.genus, epithet)})


def derive_species_id(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE, own_id: str = "Accepted_ID",
                      parent_name: str = "parent_name", parent_id: str = "parent_kew_id",
                      out: str = "Accepted_Species_ID", check: bool = True) -> DataFrame:
    """Id of the row's species: the parent's where the parent is that species, else its own if the
    row is a species.  A row left without one fails the job when ``check`` is set.
    """
    value = (F.when(F.col(parent_name) == F.col(cat.species), F.col(parent_id))
             .when(F.col(cat.rank) == cat.species_rank, F.col(own_id)))
    if check:
        value = F.coalesce(value, F.raise_error(
            F.concat(F.lit("no species id for "), F.coalesce(F.col(own_id).cast("string"),
                                                             F.lit("a row without id")))
        ).cast(df.schema[own_id].dataType))
    return df.withColumn(out, value)


def align_schema(df: DataFrame, like: DataFrame) -> DataFrame:
    """Bring ``df`` to the columns, order and types of ``like``; absent columns are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
                       .alias(f.name) for f in like.schema.fields])


def reset_dtypes(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """Numeric traits become double, the plain text ones string; absent variables give a warning."""
    wanted = {c: "double" for c in cat.numeric}
    types = dict(df.dtypes)
    wanted.update({c: "string" for c in cat.text if not types.get(c, "").startswith("array")})
    absent = [c for c in cat.traits if c not in types]
    if absent:
        warnings.warn(f"variables not in the table: {absent}", stacklevel=2)
    return df.withColumns({
        c: clean_nan(F.col(c).try_cast(t)) if t == "double" else F.col(c).try_cast(t)
        for c, t in wanted.items() if c in types})


def null_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Nulls per column, by one aggregate."""
    if not columns:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}")
                   for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))


def select_features(df: DataFrame, traits: list[str], target: str, keep: list[str] | None = None,
                    drop_null_columns: bool = False, drop_null_rows: bool = False) -> DataFrame:
    """Project the traits present and the target (and ``keep``).

    ``drop_null_columns`` first drops every column that has a null; ``drop_null_rows`` drops rows
    with a null trait.
    """
    present = [c for c in traits if c in df.columns]
    if drop_null_columns:
        nulls = null_counts(df, present + [target])
        if nulls[target]:
            raise KeyError(f"{target} has nulls and was dropped")
        present = [c for c in present if not nulls[c]]
    out = df.select(*[c for c in keep or [] if c not in present], *present, target)
    return out.dropna(how="any", subset=present) if drop_null_rows and present else out


def require_key(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    return df.dropna(subset=[cat.name])


def _evidence(df: DataFrame, cat: Catalogue) -> list[str]:
    taxonomic = {cat.family, cat.genus}
    return [c for c in cat.traits if c not in taxonomic and c in df.columns] + [cat.target]


def drop_empty_samples(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """Drop rows that are null in every non-taxonomic trait and in the target."""
    return df.dropna(how="all", subset=_evidence(df, cat))


def count_empty_samples(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """How many rows :func:`drop_empty_samples` removes, and of how many."""
    empty = F.coalesce(*[F.col(c).cast("string") for c in _evidence(df, cat)]).isNull()
    return df.agg(F.count_if(empty).alias("n_removed"), F.count(F.lit(1)).alias("n_rows"))


def split_labelled(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(target).isNotNull()), df.filter(F.col(target).isNull())


def family_filter(df: DataFrame, family: str, cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    return df.filter(F.col(cat.family) == family)


def rank_filter(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    return df.filter(F.col(cat.rank) == cat.species_rank)


def label_value_filter(df: DataFrame, target: str, value: float) -> DataFrame:
    return df.filter(F.col(target) == value)


def zero_fill(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE,
              columns: list[str] | None = None) -> DataFrame:
    """0 for nulls in the traits that never stay unknown."""
    chosen = cat.zero_filled if columns is None else columns
    return df.fillna(0, subset=[c for c in chosen if c in df.columns])


def conditional_zero(df: DataFrame, column: str, family: str,
                     cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """0 where ``column`` is null and the family is the given one."""
    hit = F.col(column).isNull() & (F.col(cat.family) == family)
    return df.withColumn(column, F.when(hit, 0).otherwise(F.col(column)))


def require_no_nulls(df: DataFrame, columns: list[str]) -> None:
    bad = {c: n for c, n in null_counts(df, columns).items() if n}
    if bad:
        raise ValueError(f"nulls in the sample: {bad}")


def report_and_fill_nulls(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Fill nulls with 0; also say which columns had how many."""
    bad = {c: n for c, n in null_counts(df, columns).items() if n}
    return (df.fillna(0, subset=list(bad)) if bad else df), bad


def standard_layout(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """Drop empty rows, zero-fill, then order columns: names, the rest, target last."""
    require_columns(df, cat.names + [cat.target])
    filled = zero_fill(drop_empty_samples(df, cat), cat)
    apart = set(cat.names) | {cat.target} | set(cat.dropped_after_use)
    return filled.select(*cat.names, *[c for c in filled.columns if c not in apart], cat.target)


def semi_supervised_union(labelled: DataFrame, unlabelled: DataFrame, features: list[str],
                          target: str | None) -> DataFrame:
    """Features stacked; the unlabelled target is -1.  Without a target only features come back."""
    if target is None:
        return labelled.select(*features).unionByName(unlabelled.select(*features))
    kind = labelled.schema[target].dataType
    return labelled.select(*features, target).unionByName(
        unlabelled.select(*features, F.lit(-1).cast(kind).alias(target)))


def mark_selected(df: DataFrame, target: str, out: str = "selected") -> DataFrame:
    """1 for labelled rows, 0 for the rest, without stacking two tables."""
    return df.withColumn(out, F.col(target).isNotNull().cast("int"))


def stack_samples(labelled: DataFrame, unlabelled: DataFrame, out: str = "selected") -> DataFrame:
    """Labelled (1) and unlabelled (0) rows stacked by column name."""
    return labelled.withColumn(out, F.lit(1)).unionByName(unlabelled.withColumn(out, F.lit(0)),
                                                          allowMissingColumns=True)
