"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_nan(x: Column | str) -> Column:
    """NaN becomes NULL, so that aggregates and ``greatest`` skip it."""
    return F.when(~F.isnan(_c(x)), _c(x))


def row_max(*cols: Column | str) -> Column:
    """Largest non-null value of the row; null where all are null."""
    parts = [clean_nan(_c(c).cast("double")) for c in cols]
    return parts[0] if len(parts) == 1 else F.greatest(*parts)


def known_indicator(x: Column | str) -> Column:
    return _c(x).isNotNull().cast("double")


def equality_flag(a: Column | str, b: Column | str) -> Column:
    """1 where both are known and equal, else 0."""
    return F.coalesce((_c(a) == _c(b)).cast("int"), F.lit(0))


def split_labels(x: Column | str, sep: str = "/", unknown: str = "?") -> Column:
    """Labels of a separated string; null where the text is null or exactly ``unknown``."""
    return F.when(_c(x) != unknown, F.split(_c(x), "\\Q" + sep + "\\E"))


def parse_list(x: Column | str, element: str = "string") -> Column:
    """A list literal in text (``"['REU', 'MAU']"``) as an array; null for any other text."""
    return F.from_json(F.replace(_c(x), F.lit("'"), F.lit('"')), f"array<{element}>")


def genus_of_name(x: Column | str) -> Column:
    """First word of a name."""
    return F.split(_c(x), " ")[0]


def species_name(genus: Column | str, epithet: Column | str) -> Column:
    """Genus and epithet joined by a blank; null if either is null."""
    return F.concat(_c(genus), F.lit(" "), _c(epithet))


def yes_no_flag(x: Column | str) -> Column:
    """1 / 0 for yes / no in any case and with blanks around; null for all else."""
    word = F.lower(F.trim(_c(x)))
    return F.when(word == "yes", 1.0).when(word == "no", 0.0)


def tidy_names(df: DataFrame) -> DataFrame:
    """Underscores in column names become blanks."""
    return df.withColumnsRenamed({c: c.replace("_", " ") for c in df.columns})


def tidy_text(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("_"), F.lit(" "))


def round_half_even_2(x: Column | str) -> Column:
    """A value of [0, 1] to 2 decimals by its exact binary value, ties to even.

    Scaling by 2**60 is exact for doubles of this range from 2**-8 on, so ties are decided on
    integers.  Below that the result is 0 or 0.01 as 0.005 lies clear of the bound.
    """
    v = _c(x)
    # by bigint, as a double becomes a decimal by its shortest text only
    units = (v * F.lit(float(1 << 60))).cast("bigint").cast("decimal(20,0)")
    one = F.lit(1 << 60).cast("decimal(20,0)")
    twice = units * F.lit(200).cast("decimal(3,0)")          # 200 * v * 2**60
    low = F.floor(v * 100 + 1e-9).cast("int")                # candidate, at most one too high
    low = F.when((low.cast("decimal(3,0)") * F.lit(2).cast("decimal(1,0)")) * one > twice,
                 low - 1).otherwise(low)
    middle = (low * 2 + 1).cast("decimal(3,0)") * one
    up = (twice > middle) | ((twice == middle) & (low % 2 == 1))
    return (low + up.cast("int")) / F.lit(100.0)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Weighted mean over rows whose value is known; their weight alone counts."""
    v, w = _c(value), _c(weight)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))
