"""From curated traits and datasets to the finished trait table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE
from counterpoise.functions.scalars import known_indicator, row_max
from counterpoise.operators import cleaning, enrich, hierarchy
from counterpoise.operators.regions import multilabel_onehot
from counterpoise.operators.summary import describe
from counterpoise.session import cut_lineage
from counterpoise.sources.writers import write_table


def related_features(df: DataFrame) -> DataFrame:
    """Traits implied by others: emergence, medicinal use, tested for alkaloids."""
    return df.withColumns({
        "Emergence": row_max("Spines", "Hairs"),
        "Medicinal": row_max("Medicinal", "Antimalarial_Use", "History_Fever"),
        "Tested_for_Alkaloids": row_max(known_indicator("Alkaloids"), "Tested_for_Alkaloids"),
    })


def assemble(curated: DataFrame, checklist: DataFrame,
             rules: list[enrich.FlagRule | enrich.ValueRule], habit: str | None = "Habit",
             cat: Catalogue = DEFAULT_CATALOGUE, source: str = "Source") -> DataFrame:
    """Curated traits plus checklist, at species level, with all rules applied and typed columns."""
    base = curated.drop(source) if source in curated.columns else curated
    base = enrich.append_missing_taxa(cleaning.nan_to_null(base), checklist, cat=cat)
    species = cut_lineage(hierarchy.resolve_to_species(base, cat))
    out = related_features(enrich.enrich(species, rules, cat))
    if habit:
        out = multilabel_onehot(cut_lineage(out), habit, cat.habits)
    return cleaning.reset_dtypes(out, cat)


@dataclass
class Finished:
    everything: DataFrame
    labelled: DataFrame
    unlabelled: DataFrame
    changes: DataFrame


def finalise(df: DataFrame, cat: Catalogue = DEFAULT_CATALOGUE,
             report: list[str] | None = None) -> Finished:
    """Drop unnamed rows and spent columns, fill from the genus, zero-fill, order, split.

    ``changes`` lists the cells that the genus filled, for ``report`` (by default all genus-level
    variables present).
    """
    kept = cleaning.drop_columns(cleaning.require_key(df, cat), cat.discarded)
    present = [v for v in cat.genus_level if v in kept.columns]
    filled = hierarchy.fill_from_genus(kept, cat, present, keep_before=True)
    changes = hierarchy.change_report(filled, report or present, [cat.name])
    everything = cut_lineage(cleaning.standard_layout(filled.select(*kept.columns), cat))
    labelled, unlabelled = cleaning.split_labelled(everything, cat.target)
    return Finished(everything, labelled, unlabelled, changes)


def write_finished(done: Finished, folder: str, families: list[str],
                   cat: Catalogue = DEFAULT_CATALOGUE, fmt: str = "parquet") -> None:
    """The three tables and their summaries, also per family."""
    parts = {"all": done.everything, "labelled": done.labelled, "unlabelled": done.unlabelled}
    for name, df in parts.items():
        write_table(df, f"{folder}/{name}_traits", fmt)
    parts.update({f: done.everything.filter(F.col(cat.family) == f) for f in families})
    for name, df in parts.items():
        numeric = [c for c in [*cat.numeric, cat.target] if c in df.columns]
        write_table(describe(df, numeric), f"{folder}/{name} trait summary", "csv",
                    single_file=True)
