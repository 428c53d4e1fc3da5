"""A bounded sample of labelled documents for the classifiers of this package."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_PER_LABEL = 1_500        # labelled documents of either label that a classifier is fitted on, at most
SAMPLE_CHARS = 12_000           # longer documents are not drawn into the sample


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(divisor))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column,
                    per_label: int = SAMPLE_PER_LABEL) -> tuple[pd.DataFrame, float]:
    """Texts with labels (columns text, label) and the share of label 1 among all learnable labels.

    Drawn by a hash of the id.  Null labels are ignored; of several labels of a document the largest counts.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.max(label).alias("label")).where(learnable).where(F.col("label").isin(0, 1)))
    share = known.agg(F.avg("label")).first()[0]
    # twice as many ids as wanted, as some have no document or a long one; bounded by per_label
    drawn = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_label) for v in (0, 1)]
    drawn = F.broadcast(drawn[0].union(drawn[1]))
    rows = (docs.where(F.length(F.coalesce("text", F.lit(""))) <= SAMPLE_CHARS)
            .select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(drawn, "doc_id"))
    taken = [rows.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(per_label) for v in (0, 1)]
    frame = taken[0].union(taken[1]).select("text", F.col("label").cast("int").alias("label")).toPandas()
    return frame, 0.5 if share is None else float(share)


def calibrate(told: np.ndarray, label: np.ndarray, share: float, steps: int = 50) -> tuple[float, ...]:
    """Weights and offset of the logistic curve from columns of ``told`` to the chance of label 1, by Newton
    steps; the sample is weighted to have ``share`` of label 1."""
    label = np.asarray(label, float)
    told = np.asarray(told, float).reshape(len(label), -1)
    share = min(max(share, 1e-3), 1 - 1e-3)
    weight = np.where(label == 1, share / max(1, label.sum()), (1 - share) / max(1, (1 - label).sum())) * len(label)
    middle, spread = told.mean(axis=0), told.std(axis=0)
    spread = np.maximum(spread, 0.1)          # a column that hardly varies gets no steep slope
    x = np.column_stack([(told - middle) / spread, np.ones(len(label))])
    beta = np.zeros(x.shape[1])
    beta[-1] = np.log(share / (1 - share))
    ridge = np.diag([1e-2] * told.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (label - p)) - ridge @ beta
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        move = np.linalg.solve(hess, grad)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-30))       # keeps the direction
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    slopes = beta[:-1] / spread
    return (*(float(b) for b in slopes), float(beta[-1] - slopes @ middle))
