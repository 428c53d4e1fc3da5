"""Variable catalogue: which columns play which role.

The operators take a :class:`Catalogue`, so another table with other columns needs only another
catalogue.  ``DEFAULT_CATALOGUE`` describes the published plant trait table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Column and variable names of the published trait table.
NAME_COLUMNS = ["Accepted_Name", "Accepted_ID", "Family", "Genus", "Accepted_Rank",
                "Accepted_Species", "Accepted_Species_ID"]
COLUMNS_TO_DROP = ["Ref_Alks", "Ref_H_Mal", "History_Fever", "Ref_H_Fever", "Ref_Activity", "Name",
                   "Species"]
FAMILIES = ["Apocynaceae", "Rubiaceae", "Loganiaceae"]
HABITS = ["herb", "liana", "succulent", "shrub", "subshrub", "tree"]
FLAGS = ["In_Malarial_Region", "Common_Name", "Poisonous", "Medicinal", "Wiki_Page",
         "Antimalarial_Use", "Emergence", "Tested_for_Alkaloids"]
COMPOUNDS = ["Alkaloids"]
MORPHOLOGY = ["Spines", "Emergence", "Hairs"]
CONTINUOUS = ["bio1", "bio4", "bio10", "bio11", "bio12", "bio15", "bio16", "bio17",
              "brkl_elevation", "elevation", "slope", "soil_nitrogen", "soil_ph", "soil_depth",
              "soil_ocs", "soil_water_cap", "latitude", "longitude"]
TEXT_TRAITS = ["Genus", "Family", "kg_mode", "kg_all", "native_tdwg3_codes"]
DROPPED_AFTER_USE = ["Spines", "Hairs"]
APRIORI_BIASING = ["Antimalarial_Use", "Tested_for_Alkaloids", "Medicinal", "In_Malarial_Region",
                   "Genus", "Family"]
TARGET_ENCODED = ["Genus", "Family", "kg_mode"]
NOT_PREDICTORS = ["In_Malarial_Region", "Tested_for_Alkaloids"]
TARGET = "Activity_Antimalarial"
BOUNDS = {"kg_mode": (0, 30), "bio1": (-20, 35), "brkl_elevation": (-500, 6500),
          "elevation": (-500, 6500), "soil_ocs": (0, 212), "soil_ph": (0, 92),
          "latitude": (-90, 85), "longitude": (-180, 180), "soil_nitrogen": (0, 2500)}


@dataclass(frozen=True)
class Catalogue:
    """Roles of the columns of one wide table."""

    names: list[str] = field(default_factory=lambda: list(NAME_COLUMNS))
    name: str = "Accepted_Name"
    species: str = "Accepted_Species"
    genus: str = "Genus"
    family: str = "Family"
    rank: str = "Accepted_Rank"
    species_rank: str = "Species"
    target: str = TARGET
    flags: list[str] = field(default_factory=lambda: list(FLAGS))
    habits: list[str] = field(default_factory=lambda: list(HABITS))
    compounds: list[str] = field(default_factory=lambda: list(COMPOUNDS))
    genus_level: list[str] = field(default_factory=lambda: MORPHOLOGY + HABITS)
    continuous: list[str] = field(default_factory=lambda: list(CONTINUOUS))
    text: list[str] = field(default_factory=lambda: list(TEXT_TRAITS))
    encoded: list[str] = field(default_factory=lambda: list(TARGET_ENCODED))
    discarded: list[str] = field(default_factory=lambda: list(COLUMNS_TO_DROP))
    dropped_after_use: list[str] = field(default_factory=lambda: list(DROPPED_AFTER_USE))
    not_predictors: list[str] = field(default_factory=lambda: list(NOT_PREDICTORS))

    @property
    def binary(self) -> list[str]:
        return self.flags + self.habits + self.compounds

    @property
    def numeric(self) -> list[str]:
        return self.binary + self.continuous

    @property
    def traits(self) -> list[str]:
        return self.numeric + self.text

    @property
    def may_be_null(self) -> list[str]:
        environment = self.continuous + [c for c in self.text if c.startswith("kg_")]
        return self.habits + environment + self.compounds

    @property
    def zero_filled(self) -> list[str]:
        """Traits whose nulls become 0; text and array traits keep their nulls."""
        keep = set(self.may_be_null) | set(self.text)
        return [c for c in self.traits if c not in keep]

    @property
    def bias_features(self) -> list[str]:
        return [c for c in self.numeric if c not in self.compounds] + [
            c for c in ("Family", "Genus", "kg_mode") if c in self.text]

    @property
    def prediction_features(self) -> list[str]:
        return [c for c in self.bias_features if c not in self.not_predictors]

    def groups(self) -> dict[str, list[str]]:
        return {
            "names": self.names, "flags": self.flags, "habits": self.habits,
            "compounds": self.compounds, "genus_level": self.genus_level, "binary": self.binary,
            "continuous": self.continuous, "text": self.text, "numeric": self.numeric,
            "traits": self.traits, "may_be_null": self.may_be_null,
            "zero_filled": self.zero_filled, "bias_features": self.bias_features,
            "prediction_features": self.prediction_features, "target_encoded": self.encoded,
        }

    def table(self, spark: SparkSession) -> DataFrame:
        """The groups as rows (variable_group, position, variable)."""
        rows = [(g, i, v) for g, vs in self.groups().items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "variable_group string, position int, variable string")


DEFAULT_CATALOGUE = Catalogue()
