"""Counterpoise: conclusions from partly labelled, unevenly sampled tables, on Spark.

Every public function takes and returns DataFrames.  See ``README.md`` for the layout.
"""

from counterpoise.catalogue import Catalogue, DEFAULT_CATALOGUE

__all__ = ["Catalogue", "DEFAULT_CATALOGUE"]
