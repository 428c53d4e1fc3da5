"""Enrichment: presence, absence and value data joined in by name, then species, then genus.

All rules of one call share one key table per level, so a table gains any number of variables by at
most three lookups, whatever the number of datasets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE
from counterpoise.functions.scalars import genus_of_name
from counterpoise.operators.cleaning import (align_schema, derive_names, derive_species_id,
                                             rename_columns, require_columns)
from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage

LEVELS = ("precise", "species", "genera")
_SETS_PER_MASK = 62      # presence and absence sets told by the bits of one mask column


@dataclass(frozen=True)
class FlagRule:
    """Set ``var`` to 1 / 0 where a taxon is in ``hits`` / ``absences``.

    ``priority`` says which set goes first within a level; an earlier level always wins.  With
    ``create`` the variable must be new; else values already present are kept.
    """

    var: str
    hits: DataFrame | None = None
    absences: DataFrame | None = None
    level: str | None = None
    priority: int = 1
    value: float = 1.0
    create: bool = False


@dataclass(frozen=True)
class ValueRule:
    """Take values of ``variables`` from ``data``; ``order`` names its file-order column."""

    variables: list[str]
    data: DataFrame
    level: str | None = None
    original_name: str | None = None
    order: str | None = None


def _flag_level(rule: FlagRule, cat: Catalogue) -> str:
    level = rule.level or ("genera" if rule.var in cat.genus_level else "species")
    if level not in LEVELS:
        raise ValueError(f"unknown level {level}")
    if level == "genera" and rule.var not in cat.genus_level:
        raise ValueError(f"{rule.var} is not a genus-level variable")
    if rule.priority not in (0, 1):
        raise ValueError("priority must be 0 or 1")
    return level


def _value_levels(rule: ValueRule, cat: Catalogue) -> dict[str, str]:
    """How far each variable of the rule falls back; without a level of the rule each has its own."""
    by_genus = set(cat.genus_level) | {"Habit"}
    return {v: rule.level or ("genera" if v in by_genus else "species") for v in rule.variables}


def _up_to(level: str) -> tuple[str, ...]:
    return LEVELS[:LEVELS.index(level) + 1]


def _genus_column(data: DataFrame, cat: Catalogue) -> Column:
    return F.col(cat.genus) if cat.genus in data.columns else genus_of_name(cat.name)


def _level_keys(data: DataFrame, level: str, bit: int, cat: Catalogue) -> DataFrame:
    """(level, key, part, mask): the keys by which a dataset reaches rows at each level, from one
    pass; ``part`` is the mask column that holds the set's bit.
    """
    pairs = [("precise", F.col(cat.name))]
    if level != "precise":
        pairs.append(("species", F.col(cat.name)))
        if cat.species in data.columns:
            pairs.append(("species", F.col(cat.species)))
    if level == "genera":
        pairs.append(("genera", _genus_column(data, cat)))
    cells = F.array(*[F.struct(F.lit(lev).alias("level"), key.cast("string").alias("key"))
                      for lev, key in pairs])
    part, place = divmod(bit, _SETS_PER_MASK)
    return data.select(F.inline(cells)).dropna(subset=["key"]).withColumns(
        {"part": F.lit(part), "mask": F.lit(1 << place).cast("long")})


def _resolve(data: DataFrame, cat: Catalogue, original_name: str | None,
             order: str | None) -> DataFrame:
    """One row per accepted name: the only one, or the one equal to the original name."""
    dataset = data if order else data.withColumn("_order", F.lit(0))
    cols = [c for c in dataset.columns if c != cat.name]
    if original_name is None:
        own = F.lit(False)
    else:
        own = F.coalesce(F.col(cat.name) == F.col(original_name), F.lit(False))
    return dataset.groupBy(cat.name).agg(
        F.max_by(F.struct(*cols), own).alias("_row"),
        F.count(F.lit(1)).alias("_n"), F.count_if(own).alias("_own"),
    ).select(cat.name, *[F.col(f"_row.`{c}`").alias(c) for c in cols], "_n", "_own")


def _check_resolved(resolved: DataFrame, cat: Catalogue, original_name: str | None) -> None:
    """Raise unless every duplicated name has exactly one row that carries its original name, and
    these are half of the duplicate rows.
    """
    row = resolved.filter("_n > 1").agg(
        F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_own"), F.lit(0)),
        F.count_if(F.col("_own") == 0), F.count_if(F.col("_own") > 1), F.min(cat.name)).first()
    duplicates, kept, uncovered, repeated, example = row
    if not duplicates:
        return
    if original_name is None:
        raise ValueError(f"duplicated names, such as {example!r}, and no original name to resolve "
                         "them by")
    if uncovered or repeated or 2 * kept != duplicates:
        raise ValueError(f"unresolved duplicates, such as {example!r}")


def resolve_duplicate_keys(data: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE,
                           original_name: str | None = None) -> DataFrame:
    """Of duplicated names keep the row whose name equals ``original_name``; raise if unclear."""
    resolved = cut_lineage(_resolve(data, cat, original_name, order=None))
    _check_resolved(resolved, cat, original_name)
    return resolved.drop("_n", "_own", "_order")


def _merge_tables(tables: list[DataFrame], columns: list[str]) -> DataFrame:
    """One row per key from tables that each bring their own columns."""
    if len(tables) == 1:
        return tables[0]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return stacked.groupBy("key").agg(*[F.max(c).alias(c) for c in columns])


def _mask_tables(rules: list[tuple[FlagRule, str]], cat: Catalogue) -> dict[str, DataFrame]:
    """Per level a table (key, mask0, mask1, ...); of all bits in turn, bit 2i is rule i's hits, bit
    2i+1 its absences.
    """
    sets, levels = [], set()
    for i, (rule, level) in enumerate(rules):
        levels |= set(_up_to(level))
        for bit, data in ((2 * i, rule.hits), (2 * i + 1, rule.absences)):
            if data is not None:
                sets.append(_level_keys(data, level, bit, cat))
    names = _mask_names(len(rules))
    masks = cut_lineage(reduce(DataFrame.unionByName, sets).groupBy("level", "key").agg(
        *[F.bit_or(F.when(F.col("part") == i, F.col("mask"))).alias(n) for i, n in enumerate(names)]))
    return {lev: masks.filter(F.col("level") == lev).select("key", *names) for lev in levels}


def _mask_names(rules: int) -> list[str]:
    return [f"mask{i}" for i in range((2 * rules - 1) // _SETS_PER_MASK + 1)]


def _has_bit(level: str, bit: int) -> Column:
    part, place = divmod(bit, _SETS_PER_MASK)
    return F.col(f"{level}_mask{part}").bitwiseAND(F.lit(1 << place).cast("long")) != 0


def _value_tables(rule: ValueRule, levels: dict[str, str], index: int, cat: Catalogue,
                  data: DataFrame) -> dict[str, DataFrame]:
    """Per level a table (key, one column per variable that falls back so far)."""
    order = F.col(rule.order) if rule.order else F.struct(F.col(cat.name))

    def reaching(level: str) -> dict[str, str]:
        return {v: f"_x{index}_{v}" for v in rule.variables if level in _up_to(levels[v])}

    def firsts(key: Column, names: dict[str, str]) -> DataFrame:
        # min_by passes over rows whose ordering is null, so each variable gets its own first value
        return data.select(key.alias("key"), order.alias("_o"), *names).dropna(
            subset=["key"]).groupBy("key").agg(
            *[F.min_by(v, F.when(F.col(v).isNotNull(), F.col("_o"))).alias(n)
              for v, n in names.items()])

    def by_name(names: dict[str, str]) -> DataFrame:
        return data.select(F.col(cat.name).alias("key"),
                           *[F.col(v).alias(n) for v, n in names.items()]).dropna(subset=["key"])

    tables = {"precise": by_name(reaching("precise"))}
    near, wide = reaching("species"), reaching("genera")
    if near:
        tables["species"] = by_name(near)
        if cat.species in data.columns:
            tables["species"] = by_name(near).withColumn("_p", F.lit(0)).unionByName(
                firsts(F.col(cat.species), near).withColumn("_p", F.lit(1))).groupBy("key").agg(
                *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("_p"))).alias(n)
                  for n in near.values()])
    if wide:
        if cat.genus in data.columns or rule.original_name is None:
            genus = _genus_column(data, cat)
        else:
            genus = F.col(rule.original_name)
        tables["genera"] = firsts(genus, wide)
    return tables


def enrich(df: DataFrame, rules: list[FlagRule | ValueRule],
           cat: Catalogue = DEFAULT_CATALOGUE, check: bool = True) -> DataFrame:
    """Apply all rules; values already present are never overwritten."""
    flags = [(r, _flag_level(r, cat)) for r in rules if isinstance(r, FlagRule)]
    values = [(r, _value_levels(r, cat)) for r in rules if isinstance(r, ValueRule)]
    for rule, _ in flags:
        if rule.create and rule.var in df.columns:
            raise ValueError(f"{rule.var} already exists")
    tables: dict[str, list[DataFrame]] = {}
    columns: dict[str, list[str]] = {}
    for lev, table in _mask_tables(flags, cat).items() if flags else ():
        tables.setdefault(lev, []).append(table)
        columns.setdefault(lev, []).extend(_mask_names(len(flags)))
    for i, (rule, levels) in enumerate(values):
        require_columns(rule.data, rule.variables)
        data = cut_lineage(_resolve(rule.data, cat, rule.original_name, rule.order))
        if check:
            _check_resolved(data, cat, rule.original_name)
        for lev, table in _value_tables(rule, levels, i, cat, data).items():
            tables.setdefault(lev, []).append(table)
            columns.setdefault(lev, []).extend(c for c in table.columns if c != "key")

    keys = {"precise": cat.name, "species": cat.species, "genera": cat.genus}
    out = df
    for lev in LEVELS:
        if lev in tables:
            merged = _merge_tables(tables[lev], columns[lev])
            merged = merged.select("key", *[F.col(c).alias(f"{lev}_{c}") for c in columns[lev]])
            out = lookup(out, merged, {keys[lev]: "key"}, [f"{lev}_{c}" for c in columns[lev]],
                         base=df, unique_left=lev == "precise",
                         stored=not values)

    new: dict[str, Column] = {}
    for i, (rule, level) in enumerate(flags):
        passes = [(2 * i, rule.hits, rule.value), (2 * i + 1, rule.absences, 0.0)]
        if rule.priority == 0:
            passes.reverse()
        current = new.get(rule.var, F.col(rule.var) if rule.var in df.columns else None)
        steps = [] if current is None else [current]
        for lev in _up_to(level):
            steps += [F.when(_has_bit(lev, bit), v) for bit, data, v in passes if data is not None]
        new[rule.var] = F.coalesce(*steps)
    for i, (rule, levels) in enumerate(values):
        for v in rule.variables:
            # a value that is there, or that an earlier rule found, stays
            present = new.get(v, F.col(v) if v in df.columns else None)
            found = [F.col(f"{lev}__x{i}_{v}") for lev in _up_to(levels[v])]
            new[v] = F.coalesce(*([] if present is None else [present]), *found)
    kept = [F.col(c) for c in df.columns if c not in new]
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns],
                      *[e.alias(v) for v, e in new.items() if v not in df.columns]) if new else \
        out.select(*kept)


def flag_hits(df: DataFrame, var: str, hits: DataFrame, level: str | None, value: float = 1.0,
              cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """A new variable set where the taxon is among the hits; the level must be given."""
    if level is None:
        raise ValueError("a level is needed")
    return enrich(df, [FlagRule(var, hits, level=level, value=value, create=True)], cat)


def update_hits(df: DataFrame, var: str, hits: DataFrame, value: float = 1.0,
                level: str | None = None, cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """Set nulls of an existing variable where the taxon is among the hits."""
    return enrich(df, [FlagRule(var, hits, level=level, value=value)], cat)


def flag_hits_absences(df: DataFrame, var: str, hits: DataFrame, absences: DataFrame,
                       level: str = "precise", priority: int = 1,
                       cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """A new variable from a presence and an absence set."""
    return enrich(df, [FlagRule(var, hits, absences, level=level, priority=priority, create=True)],
                  cat)


def lookup_values(df: DataFrame, variables: list[str], data: DataFrame, level: str | None = None,
                  original_name: str | None = None, order: str | None = None,
                  cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """Take the variables from ``data`` by name, then species, then genus."""
    return enrich(df, [ValueRule(list(variables), data, level, original_name, order)], cat)


def missing_taxa(df: DataFrame, checklist: DataFrame, df_id: str = "Accepted_ID",
                 checklist_id: str = "kew_id") -> DataFrame:
    """Checklist rows whose id is not in ``df``; a null id counts as present if ``df`` has one."""
    known = df.select(F.col(df_id).alias("_id")).distinct()
    # null ids are decided by one row, so they never meet in one task of the join
    null_known = known.agg(F.coalesce(F.bool_or(F.col("_id").isNull()), F.lit(False)).alias("_null_known"))
    nulls = (checklist.where(F.col(checklist_id).isNull()).join(F.broadcast(null_known))
             .where(~F.col("_null_known")).drop("_null_known"))
    named = checklist.where(F.col(checklist_id).isNotNull()).join(
        known.where(F.col("_id").isNotNull()), on=F.col(checklist_id) == F.col("_id"), how="left_anti")
    return named.unionByName(nulls)


def append_missing_taxa(df: DataFrame, checklist: DataFrame,
                        names: dict[str, str] | None = None,
                        cat: Catalogue = DEFAULT_CATALOGUE) -> DataFrame:
    """Append checklist taxa that ``df`` lacks, in the layout of ``df``.

    ``names`` maps checklist columns to table columns.
    """
    # Column names of the checklist and what they become.
    names = names or {"family": "Family", "genus": "Genus", "species": "Species",
                      "kew_id": "Accepted_ID", "taxon_name": "Accepted_Name",
                      "rank": "Accepted_Rank"}
    id_in = next(k for k, v in names.items() if v == "Accepted_ID")
    new = rename_columns(missing_taxa(df, checklist, "Accepted_ID", id_in), names)
    new = derive_species_id(derive_names(new, cat), cat)
    return df.unionByName(align_schema(new, df))


def natural_inner_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on all shared columns."""
    return a.join(b, on=[c for c in a.columns if c in b.columns], how="inner")


def inner_by_name(a: DataFrame, b: DataFrame, name: str = "Accepted_Name") -> DataFrame:
    return a.join(b, on=name, how="inner")
