"""A suite of checks from one scan and one shuffle.

Every row gives one record with the flags of all rules on rows, and one record per distinct key set with the row's
key; a single aggregate by (key set, key) folds the first kind to one record per task before the shuffle and counts
the second kind by key.  Counts are plain aggregates, so they stay right when tasks run again (observed metrics and
accumulators do not).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``broken`` says of a row that it breaks the rule; unknown is not broken."""

    name: str
    broken: Column


@dataclass(frozen=True)
class Unique:
    """No two rows agree in ``keys`` (nulls agree)."""

    name: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Constant:
    """A column has one value, null counting as one, in each group of ``keys``; rows with a null key are left out."""

    name: str
    keys: tuple[str, ...]
    column: str


@dataclass(frozen=True)
class SameSet:
    """The keys of rows where ``flag`` is 1 are those of ``source``; nulls are left out on both sides."""

    name: str
    key: str
    flag: str
    source: DataFrame
    source_key: str | None = None


def implies(name: str, when: Column, then: Column) -> Rule:
    return Rule(name, F.coalesce(when, F.lit(False)) & ~F.coalesce(then, F.lit(False)))


def not_null(name: str, column: str) -> Rule:
    return Rule(name, F.col(column).isNull())


def integral(name: str, column: str) -> Rule:
    return Rule(name, F.col(column).cast("double") != F.rint(F.col(column).cast("double")))


def within(name: str, column: str, low: float, high: float) -> Rule:
    return Rule(name, (F.col(column) < low) | (F.col(column) > high))


def in_domain(name: str, column: str, allowed: list) -> Rule:
    return Rule(name, ~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def in_own_list(name: str, value: str, members: str) -> Rule:
    one_null = F.col(value).isNull() != F.col(members).isNull()
    return Rule(name, one_null | ~F.coalesce(F.array_contains(members, F.col(value)), F.lit(True)))


def not_empty(name: str, columns: list[str]) -> Rule:
    return Rule(name, F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull())


def one_part(name: str, parts: list[Column]) -> Rule:
    """Each row is in exactly one part."""
    return Rule(name, sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts), F.lit(0)) != 1)


def _text(df: DataFrame, column: str) -> Column:
    """A value as text, equal where the values are: -0.0 is 0.0."""
    c = F.col(column)
    kind = dict(df.dtypes)[column]
    if kind in ("double", "float"):
        c = F.when(c == 0, F.lit(0).cast(kind)).otherwise(c)
    return c.cast("string") if not kind.startswith(("array", "struct", "map")) else F.to_json(F.struct(c))


def _key(df: DataFrame, keys: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*[_text(df, k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})


def _grouped(df: DataFrame, rules: list) -> tuple[DataFrame, list[Rule], dict[tuple, list], dict]:
    """One record per (part, key): part -1 has the row flags, part p >= 0 the p-th key set or set comparison."""
    rows = [r for r in rules if isinstance(r, Rule)]
    sets: dict[tuple, list] = {}
    for r in rules:
        if isinstance(r, (Unique, Constant)):
            sets.setdefault(r.keys, []).append(r)
    width = max([sum(isinstance(r, Constant) for r in own) for own in sets.values()], default=0)
    pairs = {len(sets) + i: r for i, r in enumerate(r for r in rules if isinstance(r, SameSet))}

    def record(part: int, key: Column, flags: bool = False, values: list[Column] | None = None, known: Column | None = None,
               side: int = 1) -> Column:
        values = values or []
        return F.struct(
            F.lit(part).alias("part"), key.alias("key"), F.lit(side).alias("side"),
            (F.lit(True) if known is None else known).alias("known"),
            *[(F.coalesce(r.broken, F.lit(False)) if flags else F.lit(None).cast("boolean")).alias(f"f{i}")
              for i, r in enumerate(rows)],
            *[(values[i] if i < len(values) else F.lit(None).cast("string")).alias(f"v{i}") for i in range(width)])

    records = [record(-1, F.lit(""), flags=True)]
    for part, (keys, own) in enumerate(sets.items()):
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        records.append(record(part, _key(df, keys), values=[_text(df, r.column) for r in own if isinstance(r, Constant)],
                              known=known))
    for part, r in pairs.items():
        flagged = F.coalesce(F.col(r.flag) == 1, F.lit(False)) & F.col(r.key).isNotNull()
        records.append(record(part, F.when(flagged, _text(df, r.key))))
    tall = df.select(F.inline(F.array(*records)))
    for part, r in pairs.items():
        key = r.source_key or r.key
        tall = tall.unionByName(r.source.select(F.inline(F.array(record(part, _text(r.source, key), side=2)))))
    grouped = tall.where("key is not null").groupBy("part", "key").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("known").alias("known"),
        F.min("side").alias("first"), F.max("side").alias("last"),
        *[F.count_if(f"f{i}").alias(f"f{i}") for i in range(len(rows))],
        *[(F.min(f"v{i}").eqNullSafe(F.max(f"v{i}")) & F.count(f"v{i}").isin(F.lit(0), F.count(F.lit(1)))).alias(f"v{i}")
          for i in range(width)])
    return grouped, rows, sets, pairs


def _broken_keys(sets: dict[tuple, list], pairs: dict) -> list[tuple[str, Column]]:
    """Each rule on keys with the records of a grouped table that break it."""
    out = []
    for part, own in enumerate(sets.values()):
        constants = [r for r in own if isinstance(r, Constant)]
        for r in own:
            broken = F.col("n") > 1 if isinstance(r, Unique) else F.col("known") & ~F.col(f"v{constants.index(r)}")
            out.append((r.name, (F.col("part") == part) & broken))
    for part, r in pairs.items():
        out.append((r.name, (F.col("part") == part) & (F.col("first") == F.col("last"))))
    return out


def check_all(df: DataFrame, rules: list) -> DataFrame:
    """``(rule, violations)`` for all rules: rows that break a rule on rows, keys that break one on keys.

    One scan of ``df`` (and of each set's source) and one shuffle, whatever the number of rules.  An empty table breaks
    nothing but sets with a source."""
    grouped, rows, sets, pairs = _grouped(df, rules)
    counts = [(r.name, F.coalesce(F.sum(f"f{i}"), F.lit(0))) for i, r in enumerate(rows)]
    counts += [(name, F.count_if(broken)) for name, broken in _broken_keys(sets, pairs)]
    one = grouped.agg(*[c.cast("long").alias(f"c{i}") for i, (_, c) in enumerate(counts)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("violations"))
                                         for i, (name, _) in enumerate(counts)])))


def broken_rows(df: DataFrame, rules: list) -> DataFrame:
    """Rows of ``df`` that break rules on rows, with the names of those in ``broken``; no shuffle."""
    names = F.array(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.name)) for r in rules if isinstance(r, Rule)])
    return df.withColumn("broken", F.array_compact(names)).where(F.size("broken") > 0)


def broken_keys(df: DataFrame, rules: list) -> DataFrame:
    """``(rule, key, n)`` of all keys that break a rule on keys; ``key`` is JSON, or the key itself for sets."""
    grouped, _, sets, pairs = _grouped(df, [r for r in rules if not isinstance(r, Rule)])
    names = F.array(*[F.when(broken, F.lit(name)) for name, broken in _broken_keys(sets, pairs)])
    return cut_lineage(grouped.where("part >= 0").select(F.explode(F.array_compact(names)).alias("rule"), "key", "n"))
