"""Embedding near-duplicates by int8 tile products with error bounds.

Unit vectors are rounded to int8 with one scale each, and the length of what rounding cut off is kept.
By Cauchy and Schwarz, the product of two rounded vectors misses their cosine by at most
``e + (1 + e) * f`` (``e``, ``f``: the lengths cut off), so a tile of integer products tells which pairs are
surely linked and which surely are not; only the others are computed again in double precision.  Every pair
of vectors meets in exactly one tile, a tile gives counts and a spanning forest, and pairs are never rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.llm.components import connected
from counterpoise.llm.shared import by_tile, tiled, whole_groups
from counterpoise.operators.skew import lookup
from counterpoise.session import cut_lineage

THRESHOLD = 0.95
BLOCK = 2048
_STRIPE = 256
_SLACK = 1e-9           # above the rounding of double arithmetic on unit vectors


def usable(vector: Column | str) -> Column:
    """Whether a vector can link: not null or empty, no null, NaN or infinite component, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, their int8 form, its scales, and the lengths that rounding cut off."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)       # keeps squares finite
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    return unit, whole, scale, np.linalg.norm(unit - whole * scale[:, None], axis=1)


def tile_links(left: tuple, right: tuple, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """Stripes ``(first row, hits)`` of the boolean matrix of linked pairs, left against right."""
    unit_a, whole_a, scale_a, cut_a = left
    unit_b, whole_b, scale_b, cut_b = right
    # sums of int8 products are exact in float32 up to 2**24, in float64 beyond
    kind = np.float32 if unit_a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    other = whole_b.astype(kind).T.copy()
    for at in range(0, len(unit_a), _STRIPE):
        rows = slice(at, at + _STRIPE)
        near = (whole_a[rows].astype(kind) @ other) * (scale_a[rows, None] * scale_b[None, :])
        error = cut_a[rows, None] + (1 + cut_a[rows, None]) * cut_b[None, :] + _SLACK
        hit = near - error >= threshold
        i, j = np.nonzero((near + error >= threshold) & ~hit)
        if len(i):
            hit[i, j] = np.einsum("ij,ij->i", unit_a[at + i], unit_b[j]) >= threshold
        yield at, hit


def _tile(threshold: float):
    def rows(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts, ends in whole_groups(frames, ["dim", "tile_i", "tile_j"]):
            for start, end in zip(starts, ends):
                part = frame.iloc[start:end].sort_values("cid")
                ids, copies = part["cid"].to_numpy(), part["copies"].to_numpy()
                form = rounded(np.stack(part["embedding"].to_numpy()).astype(np.float64))
                blocks = part["part"].to_numpy()
                mixed = part["tile_i"].iloc[0] != part["tile_j"].iloc[0]
                one = np.flatnonzero(blocks == part["tile_i"].iloc[0])
                two = np.flatnonzero(blocks != part["tile_i"].iloc[0]) if mixed else one
                links, roots = np.zeros(len(ids), np.int64), np.arange(len(ids))
                for at, hit in tile_links([x[one] for x in form], [x[two] for x in form], threshold):
                    if not mixed:
                        hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
                    own = one[at:at + len(hit)]
                    links[own] += hit @ copies[two]
                    if mixed:
                        links[two] += hit.T @ copies[own]
                    for i in np.flatnonzero(hit.any(axis=1)):
                        met = np.unique(np.append(roots[two[hit[i]]], roots[own[i]]))
                        if len(met) > 1:
                            roots[np.isin(roots, met[1:])] = met[0]
                told = np.flatnonzero(links)
                yield pd.DataFrame({"a": ids[roots[told]], "b": ids[told], "links": links[told]})

    return rows


def report(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Per vector its number of links, its component (smallest vec_id) and whether it is kept.

    Equal vectors link and are compared once.  Vectors that are null or empty, hold null or non-finite
    components or only zeros link with nothing; vectors of different length do not link.  A null vec_id is
    larger than all others; rows that share a vec_id are different vectors of that name.
    """
    rows = cut_lineage(vectors.select("vec_id", F.when(usable("embedding"), F.transform(
        "embedding", lambda x: x + F.lit(0).cast("float"))).alias("embedding"))
        .withColumn("h1", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(1), "embedding")))
        .withColumn("h2", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(2), "embedding"))))
    merged = rows.where("h1 is not null").groupBy("embedding", "h1", "h2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = cut_lineage(merged.withColumn("dim", F.size("embedding"))
                          .withColumn("cid", F.monotonically_increasing_id()))
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("size"))
    dealt = by_tile(tiled(classes.drop("h1", "h2", "first").join(F.broadcast(sizes), "dim"), "dim", "size", "cid", block),
                    "dim")
    pairs = cut_lineage(dealt.mapInPandas(_tile(threshold), "a long, b long, links long"))
    groups = connected(pairs.select("a", "b"))
    links = pairs.groupBy(F.col("b").alias("cid")).agg(F.sum("links").alias("links"))
    named = cut_lineage(classes.drop("embedding").join(links, "cid", "left").join(
        groups.select(F.col("node").alias("cid"), F.col("component").alias("group")), "cid", "left")
        .withColumn("group", F.coalesce("group", "cid")))
    least = named.groupBy("group").agg(F.min("first").alias("least"))
    named = lookup(named, least, ["group"], ["least"])
    out = lookup(rows.drop("embedding"), named, ["h1", "h2"], ["copies", "links", "least"])
    component = F.when(F.col("h1").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long")
                      .alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
