"""Queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from counterpoise.llm import (alignment, bpe, fingerprints, licenses, lines, mixing, neardup_vectors, pseudo_likelihood,
                              quality, shingles, spelling, toxicity, url_filters)
from counterpoise.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_byte_bpe")
def byte_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                       public_tokenizers.PATTERN)


@query("op6_mixing", mixing.REPORT_SQL)
def source_mixing(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op8_fingerprints")
def document_fingerprints(spark, sf_dir):
    return fingerprints.report(table(spark, sf_dir, "documents"))


@query("op10_licenses", licenses.REPORT_SQL)
def license_scan(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


@query("op3_ngram_jaccard")
def ngram_jaccard(spark, sf_dir):
    return shingles.report(table(spark, sf_dir, "documents"))


@query("op5_embedding_dedup")
def embedding_dedup(spark, sf_dir):
    return neardup_vectors.report(table(spark, sf_dir, "embeddings"))


@query("op7_line_dedup")
def line_dedup(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def toxic_scores(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality")
def quality_scores(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_pseudo_likelihood")
def language_model_scores(spark, sf_dir):
    return pseudo_likelihood.report(table(spark, sf_dir, "documents"))


@query("op12_url_filters", url_filters.REPORT_SQL)
def url_verdicts(spark, sf_dir):
    return url_filters.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op13_spelling", spelling.REPORT_SQL)
def spelling_variants(spark, sf_dir):
    return spelling.report(table(spark, sf_dir, "documents"))


@query("op11_alignment")
def tokenizer_alignment(spark, sf_dir):
    return alignment.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
