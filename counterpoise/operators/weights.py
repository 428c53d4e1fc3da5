"""Selection probability of each row and the weights that undo it."""

from __future__ import annotations

import math
import warnings
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from counterpoise.operators.cleaning import (mark_selected, report_and_fill_nulls,
                                             require_no_nulls)
from counterpoise.operators.evaluate import brier, score_folds
from counterpoise.operators.features import Preparation, prepare
from counterpoise.operators.folds import each_fold, stratified_folds
from counterpoise.operators.hierarchy import duplicated_rows
from counterpoise.operators.logit_grid import GridModel, fit_grid, grid_rows, scored, stored
from counterpoise.operators.kernels import (TILES, LandmarkMap, feature_map, kernel_matrix, kernel_sums, landmark_map, mapped,
                                            sum_vectors)
from counterpoise.operators.skew import lookup
from counterpoise.operators.summary import describe, histogram, mean_propensity_by_class
from counterpoise.session import cut_lineage

PROPENSITY = "P(s|x)"
BLOCK = 2048            # rows whose kernel with each other one task holds
ROUNDS = 100            # rounds of kernel mean matching by blocks or landmarks at most
LANDMARKS = 512         # landmarks that stand for the kernel between exact products
SLACK = 20              # what is put on the landmarks' diagonal, in units of what they leave of a row on average,
DIAGONAL = 1e-3, 1.0    # and its limits; it grows by WIDEN where a round leads nowhere
WIDEN = 30
NEWTON = 50             # Newton steps at a diagonal at most
SHARES = 0.5 ** np.arange(1, 24)        # of a Newton step, tried in one pass where the whole goes too far


def saturated_propensity(df: DataFrame, target: str, cells: list[str], propensity: str = "ps",
                         weight: str = "weight") -> DataFrame:
    """P(selected | cell) as the labelled share of the cell; weight 1 / P where the cell has any.

    The closed form of a logistic model with one parameter per cell.
    """
    rate = df.groupBy(*cells).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.count(target) / F.count(F.lit(1))).alias(propensity))
    out = lookup(df, rate, cells, [propensity], count="_n", null_safe=True)
    return inverse_propensity_weight(out, propensity, weight)


def inverse_propensity_weight(df: DataFrame, propensity: str = PROPENSITY,
                              weight: str = "weight") -> DataFrame:
    """1 / P, neither clipped nor normalised; null where P is 0 (no labelled row is like it)."""
    p = F.col(f"`{propensity}`")
    return df.withColumn(weight, F.when(p > 0, 1 / p))


def l2_strength(c: float, total_weight: float) -> float:
    """Spark's regParam with the same optimum as a sum of losses times ``c`` plus half the norm."""
    return 1.0 / (c * total_weight)


def fit_logistic(train: DataFrame, features: list[str], target: str, c: float = 1.0,
                 weight: str | None = None, max_iter: int = 200):
    """L2-penalised logistic regression; returns a function adding ``probability`` to a table."""
    total = train.agg(F.count(F.lit(1)) if weight is None else F.sum(weight)).first()[0]
    assembler = VectorAssembler(inputCols=features, outputCol="_x")
    model = LogisticRegression(
        featuresCol="_x", labelCol="_y", regParam=l2_strength(c, float(total)), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=1e-10,
        **({"weightCol": weight} if weight else {})
    ).fit(assembler.transform(train.withColumn("_y", F.col(target).cast("double"))))

    def apply(df: DataFrame, out: str = "probability") -> DataFrame:
        scored = model.transform(assembler.transform(df))
        return scored.withColumn("_p", vector_to_array("probability")[1]).select(
            *[F.col(f"`{c}`") for c in df.columns], F.col("_p").alias(out))
    return model, apply


def propensity_settings(key: str, features: list[str], categorical: list[str],
                        **options) -> Preparation:
    return Preparation(features=features, target="selected", categorical=categorical, keep=[key],
                       **options)


def propensity_logit(df: DataFrame, key: str, target: str, features: list[str],
                     categorical: list[str], **options) -> DataFrame:
    """Add P(selected | features) and its inverse as weight to every row.

    Labelled rows count as selected; that is also the target of the category encoding.  ``options``
    go to the preparation (``impute``, ``neighbours``, ...).
    """
    # whole rows go through the preparation, so that no join brings scores and rows together again
    marked = mark_selected(df, target).withColumn("_row", F.struct(*df.columns))
    prepared = prepare(replace(propensity_settings(key, features, categorical, **options), keep=["_row"]), marked)
    _, apply = fit_logistic(prepared.train, prepared.features, "selected")
    return inverse_propensity_weight(apply(prepared.train).select(
        *[F.col("_row")[c].alias(c) for c in df.columns], F.col("probability").alias(PROPENSITY)))


def duplicate_report(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows that agree in all features of the selection model."""
    return duplicated_rows(df, features)


def propensity_diagnostics(df: DataFrame, target: str, propensity: str = PROPENSITY,
                           width: float = 0.001) -> dict[str, DataFrame]:
    """Describe P on all and on unlabelled rows, its mean by class, and histograms."""
    p = df.withColumnRenamed(propensity, "p")
    unlabelled = p.filter(F.col(target).isNull())
    labelled = p.filter(F.col(target).isNotNull())
    return {
        "all": describe(p, ["p"]), "unlabelled": describe(unlabelled, ["p"]),
        "by_class": mean_propensity_by_class(p, target, "p"),
        "histogram_all": histogram(p, "p", width=width),
        "histogram_unlabelled": histogram(unlabelled, "p", width=width),
        "histogram_labelled": histogram(labelled, "p", bins=101, by=target),
        "histogram_labelled_fine": histogram(labelled, "p", bins=1001, by=target),
    }


def propensity_model_check(df: DataFrame, key: str, target: str, all_features: list[str],
                           apriori: list[str], categorical: list[str], k: int = 10,
                           repeats: int = 10, **options) -> DataFrame:
    """Accuracy, recall and Brier score of the selection model per fold, with the a-priori and with
    all features (feature_set, rep, fold, metric, value).  Folds are prepared beside each other, all models fitted in
    the same passes.
    """
    marked = mark_selected(df, target)
    sets = (("apriori", apriori), ("all", all_features))
    spark = df.sparkSession
    folded = each_fold(spark, lambda rep, _: cut_lineage(stratified_folds(marked, key, "selected", k, rep)), repeats, 1)

    def run(rep: int, fold: int) -> list[tuple[DataFrame, DataFrame]]:
        prepared = prepare(propensity_settings(key, all_features, categorical, **options),
                           folded[rep].filter(F.col("fold") != fold),
                           folded[rep].filter(F.col("fold") == fold))
        out = []
        for place, (name, features) in enumerate(sets, (rep * k + fold) * len(sets)):
            out.append((cut_lineage(grid_rows(prepared.train, features, "selected", place)),
                        cut_lineage(grid_rows(prepared.test, features, "selected", place).select(
                            "table", "x", F.col("y").cast("int").alias("selected"), F.lit(name).alias("feature_set"),
                            F.lit(rep).alias("rep"), F.lit(fold).alias("fold")))))
        return out

    parts = [part for found in each_fold(spark, run, repeats, k) for part in found]
    rows, held = (stored([part[i] for part in parts]) for i in (0, 1))
    sizes = {r["table"]: r["count"] for r in rows.groupBy("table").count().collect()}
    tables = sorted(sizes)
    betas = fit_grid(rows, [GridModel(t, l2_strength(1.0, float(sizes[t]))) for t in tables])
    preds = scored(held, dict(zip(tables, betas)))
    groups = ["feature_set", "rep", "fold"]
    scores = score_folds(preds, groups, "selected", "prediction").filter(
        F.col("metric").isin("accuracy", "recall"))
    return scores.unionByName(brier(preds, groups, "selected", "probability").select(
        *groups, F.lit("brier").alias("metric"), F.col("brier").alias("value")))


def _vector(columns: list[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])


def kernel_mean_moments(sample: DataFrame, population: DataFrame, key: str, columns: list[str],
                        kernel: str = "rbf", gamma: float | None = None,
                        degree: int | None = None, method: str = "exact",
                        size: int = 2048) -> DataFrame:
    """kappa_i = n / m * sum over the population of k(x_i, z), for each sample row (key, kappa).

    ``exact`` at every size: polynomial kernels of few monomials by one vector sum, others block by block
    of the sample (:func:`kernel_sums`).  ``random`` takes ``size`` random features instead, an estimate
    that may be negative.  An empty sample gives no rows.
    """
    require_no_nulls(sample, columns)
    population, _ = report_and_fill_nulls(population.select(*columns), columns)
    n, m = sample.count(), population.count()
    fmap = feature_map(kernel, len(columns), gamma, degree, size, method=method)
    if method == "random" or fmap.short:
        total = sum_vectors(population.select(mapped(columns, fmap).alias("v")), "v") * (n / max(m, 1))

        @F.pandas_udf("double")
        def dot(v: pd.Series) -> pd.Series:
            return pd.Series(np.stack(v.to_numpy()) @ total)
        return sample.select(key, dot(mapped(columns, fmap)).alias("kappa"))

    points = cut_lineage(sample.select(key, _vector(columns).alias("v"))
                         .withColumn("i", F.monotonically_increasing_id()))
    sums = kernel_sums(points, population.select(_vector(columns).alias("v"), F.lit(1.0).alias("weight")),
                       fmap)
    return points.select(key, "i").join(sums, "i").select(key, (F.col("s") * F.lit(n / max(m, 1))).alias("kappa"))


def kernel_mean_matching(sample: DataFrame, population: DataFrame, key: str, columns: list[str],
                         weight_bound: float = 1000.0, kernel: str = "rbf",
                         gamma: float | None = None, degree: int | None = None,
                         iterations: int = 500, tolerance: float = 1e-6,
                         out: str = "weight") -> tuple[DataFrame, list[float]]:
    """Weights in [0, 1] that bring the sample's kernel mean to the population's (Huang et al. 2006).

    Minimises w'Kw / 2 - kappa'w with |sum(w) - n| <= n * weight_bound / sqrt(n), with the exact kernel at
    every size.  Up to ``BLOCK`` rows find their best weights in one task.  More rows go in rounds until no weight moves
    by more than ``tolerance`` (``ROUNDS`` at most): they move to the best weights under a kernel near the exact one
    (:func:`_landmark_moves`), as far as the exact objective falls.  With a polynomial kernel every block of about
    ``BLOCK`` rows finds its best weights with the other blocks' held, with the rows dealt to blocks anew in each
    round.  That is the end unless the sum's limits matter.  Then steps of accelerated projected gradient that start afresh where the objective rises.  A row
    carries its vector and its weights of two steps; a step is one set of kernel tiles (one vector sum for polynomial
    kernels of few monomials), written with its rows so that no step is replayed, and one aggregate.  Ends
    when no weight moves by more than ``tolerance``, and warns if ``iterations`` steps do not reach that.
    Also returns the objective at the start, after each round of blocks, and after each step.
    """
    require_no_nulls(sample, columns)
    population, _ = report_and_fill_nulls(population.select(*columns), columns)
    fmap = feature_map(kernel, len(columns), gamma, degree)
    n, m = sample.count(), population.count()
    named = cut_lineage(sample.withColumn("_i", F.monotonically_increasing_id()))
    points = named.select(F.col("_i").alias("i"), _vector(columns).alias("v"))
    if fmap.short:
        points = points.withColumn("phi", mapped(["v"], fmap, packed=True))
    points = cut_lineage(points)
    if not n:
        return named.drop("_i").withColumn(out, F.lit(None).cast("double")), []
    place = [c for c in points.columns if c != "i"]

    def sums(rows: DataFrame, weight: str) -> DataFrame:
        """(i, s): K times the weights of ``rows``, which have all columns of the points."""
        if not fmap.short:
            return kernel_sums(points, rows.select("v", F.col(weight).alias("weight")), fmap, count=n)
        total = sum_vectors(rows, "phi", weight)

        @F.pandas_udf("double")
        def dot(phi: pd.Series) -> pd.Series:
            return pd.Series(np.stack(phi.to_numpy()) @ total)
        return points.select("i", dot("phi").alias("s"))

    everyone = population.select(_vector(columns).alias("v"), F.lit(1.0).alias("weight"))
    goal = kernel_sums(points, everyone, fmap, count=n).select("i", (F.col("s") * F.lit(n / max(m, 1))).alias("kappa"))
    # no eigenvalue exceeds the largest row sum of absolute kernel values
    ones = points.select("v", F.lit(1.0).alias("weight"))
    rate = 1.0 / max(kernel_sums(points, ones, fmap, absolute=True, count=n).agg(F.max("s")).first()[0], 1e-12)
    least = n * (1 - weight_bound / math.sqrt(n))
    most = n * (1 + weight_bound / math.sqrt(n))

    # kw, kb: K times w and times the weights before w, so a step needs one new product
    start = points.withColumn("w", F.lit(0.5))
    state = cut_lineage(start.join(goal, "i").join(sums(start, "w"), "i").select(
        "i", *place, "kappa", "w", F.col("w").alias("before"), F.col("s").alias("kw"), F.col("s").alias("kb")))
    objective = F.sum(F.col("w") * (F.col("kw") / 2 - F.col("kappa")))
    history, moment, moved = [state.agg(objective).first()[0]], 1.0, math.inf

    blocks = max(1, math.ceil(n / BLOCK))
    near = landmark_map(named, columns, fmap.gamma, LANDMARKS) if blocks > 1 and fmap.kind == "rbf" else None
    diagonal = 0.0 if near is None else min(max(SLACK * near.mean_rest, DIAGONAL[0]), DIAGONAL[1])
    for turn in range(ROUNDS if blocks > 1 else 1):
        there = (_block_moves(state, blocks, turn, fmap, tolerance / 100) if near is None
                 else _landmark_moves(state, near, diagonal, n, turn == 0))
        ahead = cut_lineage(state.join(there, "i"))
        moves = cut_lineage(ahead.join(sums(ahead, "d").withColumnRenamed("s", "kd"), "i"))
        slope, bend, far = moves.agg(F.sum(F.col("d") * (F.col("kw") - F.col("kappa"))),
                                     F.sum(F.col("d") * F.col("kd")), F.max(F.abs("d"))).first()
        reach = min(1.0, max(0.0, -slope / bend)) if bend > 0 else float(slope < 0)
        state = moves.select("i", *place, "kappa", *[(F.col("w") + F.lit(reach) * F.col("d")).alias(c) for c in ("w", "before")],
                             *[(F.col("kw") + F.lit(reach) * F.col("kd")).alias(c) for c in ("kw", "kb")])
        history.append(history[-1] + reach * slope + reach * reach * bend / 2)
        if far <= tolerance or near is None and reach * far <= tolerance:
            break
        if reach * far <= tolerance:
            diagonal *= WIDEN

    def raw(push: float):
        return (F.col("w") + F.lit(push) * (F.col("w") - F.col("before"))
                - F.lit(rate) * (F.col("kw") + F.lit(push) * (F.col("kw") - F.col("kb")) - F.col("kappa")))

    def told(pushes: list[float]) -> tuple[float, float, dict[float, tuple]]:
        """Objective, largest move, and what :func:`_shift` must know of the next step with each of the pushes."""
        row = state.agg(objective, F.max(F.abs(F.col("w") - F.col("before"))),
                        *[f for push in pushes for f in _limits(raw(push))]).first()
        return row[0], row[1], {push: tuple(row[2 + 3 * i:5 + 3 * i]) for i, push in enumerate(pushes)}

    history[-1], _, limits = told([0.0])
    for _ in range(iterations):
        following = (1 + math.sqrt(1 + 4 * moment * moment)) / 2
        push, moment = (moment - 1) / following, following
        tried = state.withColumn("raw", raw(push))
        new = _clipped(F.lit(_shift(tried, least, most, limits[push])))
        stepped = tried.select("i", *place, "kappa", new.alias("w"), F.col("w").alias("before"), F.col("kw").alias("kb"))
        state = cut_lineage(stepped.join(sums(stepped, "w"), "i").withColumnRenamed("s", "kw"))
        # the next step starts afresh, without a push, or goes on
        onward = (moment - 1) / ((1 + math.sqrt(1 + 4 * moment * moment)) / 2)
        value, moved, limits = told([0.0, onward])
        if value > history[-1]:
            moment = 1.0
        history.append(value)
        if moved <= tolerance:
            break
    if moved > tolerance:
        warnings.warn(f"kernel mean matching: weights still move by {moved:.2g} after {iterations} steps")
    found = state.select(F.col("i").alias("_i"), F.col("w").alias(out))
    return named.join(found, "_i").drop("_i"), history


def _block_moves(rows: DataFrame, blocks: int, turn: int, fmap, tolerance: float) -> DataFrame:
    """``(i, d)``: what the best weights of each row's block add to ``w`` if other blocks stay as they are.

    Rows ``(i, v, w, kw, kappa)`` are dealt to ``blocks`` by a hash of ``i`` and the turn; a task holds the
    kernel of one block."""
    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(frame["v"].to_numpy()).astype(float)
        w, slope = frame["w"].to_numpy(dtype=float), (frame["kw"] - frame["kappa"]).to_numpy(dtype=float)
        kernel = kernel_matrix(v, v, fmap)
        rate = 1.0 / max(np.linalg.eigvalsh(kernel)[-1], 1e-12)
        d, last, moment = np.zeros(len(w)), np.zeros(len(w)), 1.0
        for _ in range(20_000):
            following = (1 + math.sqrt(1 + 4 * moment * moment)) / 2
            ahead = d + (moment - 1) / following * (d - last)
            new = np.clip(ahead - rate * (slope + kernel @ ahead), -w, 1 - w)
            moment = 1.0 if (ahead - new) @ (new - d) > 0 else following       # uphill: start afresh
            d, last = new, d
            if np.abs(d - last).max() <= tolerance:
                break
        return pd.DataFrame({"i": frame["i"], "d": d})
    dealt = rows.select("i", "v", "w", "kw", "kappa", F.pmod(F.xxhash64(F.lit(3 + turn), "i"), F.lit(blocks)).alias("block"))
    return dealt.groupBy("block").applyInPandas(solve, "i long, d double")


def _landmark_moves(rows: DataFrame, near: LandmarkMap, diagonal: float, count: int, afar: bool) -> DataFrame:
    """``(i, d)``: what the best weights add to ``w`` if the kernel is the landmarks' plus ``diagonal`` times the identity.

    The slope at ``w`` is the exact kernel's, so weights that do not move are the best ones under the exact kernel too.
    As phi is short, the best weights follow from one vector ``u`` of its length, w(u) = clip(w - (slope + phi u) /
    diagonal), which a Newton method finds: a pass sums the vectors phi and the products phi phi' of the rows that lie
    between 0 and 1, and where a step goes too far another one looks along it.  From ``afar`` it comes down to the
    diagonal by way of larger ones.
    """
    size = len(near.points)
    dealt = cut_lineage(rows.select("i", "v", "w", (F.col("kw") - F.col("kappa")).alias("slope")).repartition(TILES, "i"))

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                yield near.matrix(x), batch.column("w").to_numpy(), batch.column("slope").to_numpy()

    def summed(parts) -> dict[int, np.ndarray]:
        """Sums by their number of what ``parts`` makes of a task's rows; no row leaves its task."""
        def run(batches):
            found = parts(each(batches))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.int32()), pa.array(
                [s.tolist() for s in found.values()], type=pa.list_(pa.float64()))], ["j", "s"])
        told = dealt.select("v", "w", "slope").mapInArrow(run, "j int, s array<double>").groupBy("j").agg(
            vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
        return {r["j"]: np.array(r["s"]) for r in told.toLocalIterator()}

    def bends(u: np.ndarray, diagonal: float) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative at ``u``."""
        def parts(batches) -> dict[int, np.ndarray]:
            total, square = np.zeros(size), None
            for phi, w, slope in batches:
                raw = w - (slope + phi @ u) / diagonal
                total += phi.T @ (np.clip(raw, 0, 1) - w)
                free = phi[(raw > 0) & (raw < 1)]
                if len(free):
                    square = free.T @ free + (0 if square is None else square)
            return {-1: total, **({} if square is None else {j: square[j, j:] for j in range(size)})}
        found = summed(parts)
        bend = np.zeros((size, size))
        for j in range(size):
            bend[j, j:] = bend[j:, j] = found.get(j, 0.0)
        return u - found.get(-1, np.zeros(size)), np.eye(size) + bend / diagonal

    def along(u: np.ndarray, step: np.ndarray, diagonal: float) -> np.ndarray:
        """The derivative along ``step`` at ``SHARES`` of it."""
        def parts(batches) -> dict[int, np.ndarray]:
            total = np.zeros(len(SHARES))
            for phi, w, slope in batches:
                here, on = phi @ u, phi @ step
                total += [on @ (np.clip(w - (slope + here + a * on) / diagonal, 0, 1) - w) for a in SHARES]
            return {-1: total}
        return step @ u + SHARES * (step @ step) - summed(parts).get(-1, 0.0)

    ladder = [diagonal]
    if afar:
        top = dealt.agg(F.max(F.abs("slope"))).first()[0] / 40
        while ladder[0] * WIDEN < top:
            ladder.insert(0, ladder[0] * WIDEN)
    u = np.zeros(size)
    for diagonal in ladder:
        slant, bend = bends(u, diagonal)
        for _ in range(NEWTON):
            step = -np.linalg.solve(bend, slant)
            fall = slant @ step
            if -fall <= 1e-14 * count:
                break
            ahead = bends(u + step, diagonal)
            over = step @ ahead[0]
            if over <= -fall / 2:
                u, (slant, bend) = u + step, ahead
                continue
            # the derivative rises along the step: go to where it crosses 0
            low, high, below = 0.0, 1.0, fall
            for share, value in zip(SHARES, along(u, step, diagonal)):
                if value <= 0:
                    low, below = share, value
                    break
                high, over = share, value
            u = u + (low + (high - low) * -below / (over - below)) * step
            slant, bend = bends(u, diagonal)

    @F.pandas_udf("double")
    def moved(v: pd.Series, w: pd.Series, slope: pd.Series) -> pd.Series:
        phi = near.matrix(np.stack(v.to_numpy()).astype(float))
        return pd.Series(np.clip(w - (slope + phi @ u) / ladder[-1], 0, 1) - w)
    return dealt.select("i", moved("v", "w", "slope").alias("d"))


def _clipped(shift, raw=None):
    return F.least(F.greatest((F.col("raw") if raw is None else raw) + shift, F.lit(0.0)), F.lit(1.0))


def _limits(raw) -> list:
    """Aggregates of raw weights: the least, the largest, and the sum when clipped."""
    return [F.min(raw), F.max(raw), F.sum(_clipped(F.lit(0.0), raw))]


def _shift(tried: DataFrame, least: float, most: float, limits: tuple) -> float:
    """What to add to ``raw``, whose :func:`_limits` are given, so that the clipped sum lies within the limits; 0 where
    it does already."""
    def clipped(shifts: list[float]) -> list[float]:
        return list(tried.agg(*[F.sum(_clipped(F.lit(float(s)))) for s in shifts]).first())

    if least <= limits[2] <= most:
        return 0.0
    # all weights are 1 from 1 - min on, and 0 from -max on
    wanted, low, high = (least, 0.0, 1.0 - limits[0]) if limits[2] < least else (most, -limits[1], 0.0)
    for _ in range(8):                                          # each pass narrows by 32: to 1e-12 of the range
        trial = np.linspace(low, high, 33)
        i = max(0, min(31, int(np.searchsorted(clipped(list(trial)), wanted)) - 1))
        low, high = float(trial[i]), float(trial[i + 1])
    return high if wanted == least else low
