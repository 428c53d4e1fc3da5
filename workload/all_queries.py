"""Importing this module registers every query."""

from workload import assembly_queries, feature_queries, model_queries, source_queries, summary_queries, comparison_queries  # noqa: F401
