"""Many penalised logistic models fitted together.

A model is a table (an outer fold's prepared rows, say), a fold of it that is held out, a penalty and two class
weights.  All models take their Newton steps in the same passes: a pass reads the rows once, and every task sums the
loss, slope and curvature of all models over its rows.  So the number of jobs is the number of Newton steps of the
slowest model, whatever the number of folds, repeats and grid points.  What a task holds and the driver sees is models
times the square of the columns; no row leaves its task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.operators.evaluate import BETA
from counterpoise.session import cut_lineage

STEPS = 100
SETTLED = 1e-22         # half the squared Newton step, in units of the loss, at which a model has ended
CELLS = 8_000_000       # rows times models that a task scores at a time


@dataclass(frozen=True)
class GridModel:
    """Minimises the weighted mean loss on ``table`` without fold ``held`` plus ``reg`` / 2 times the squared norm."""

    table: int
    reg: float
    held: int = -1
    weight0: float = 1.0
    weight1: float = 1.0


def grid_rows(df: DataFrame, features: list[str], target: str, table: int | Column = 0, weight: str | None = None,
              fold: str | None = None) -> DataFrame:
    """Rows ``(table, x, y, w, fold)`` as the functions below take them; write them before use."""
    return df.select((F.lit(table) if isinstance(table, int) else table).cast("int").alias("table"),
                     F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
                     F.col(target).cast("double").alias("y"),
                     (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
                     (F.lit(-2) if fold is None else F.col(fold)).cast("int").alias("fold"))


def _batches(batches, own: dict[int, np.ndarray]):
    """Rows of one table at a time, with the places of the models that want them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tables = batch.column("table").to_numpy()
        for t in np.unique(tables):
            if int(t) not in own:
                continue
            part = batch.filter(pa.array(tables == t))
            models = own[int(t)]
            step = max(1, CELLS // len(models))
            for low in range(0, part.num_rows, step):
                piece = part.slice(low, step)
                x = piece.column("x").flatten().to_numpy().reshape(piece.num_rows, -1)
                yield (models, np.hstack([x, np.ones((len(x), 1))]),
                       *[piece.column(c).to_numpy() for c in ("y", "w", "fold")])


def _by_table(models: list[GridModel], active) -> dict[int, np.ndarray]:
    own: dict[int, list[int]] = {}
    for m in active:
        own.setdefault(models[m].table, []).append(m)
    return {t: np.array(places) for t, places in own.items()}


def _evaluate(rows: DataFrame, models: list[GridModel], betas: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each model of ``betas``: weight, loss, slope and curvature in a row, in one pass."""
    own = _by_table(models, betas)
    held = np.array([m.held for m in models])
    weights = np.array([(m.weight0, m.weight1) for m in models])

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for places, x, y, w, fold in _batches(batches, own):
            margins = x @ np.stack([betas[m] for m in places]).T
            chance = 1 / (1 + np.exp(-margins))
            loss = np.logaddexp(0, np.where(y[:, None] == 1, -margins, margins))
            mass = w[:, None] * np.where(y[:, None] == 1, weights[places, 1], weights[places, 0])
            mass = mass * (fold[:, None] != held[places])
            slopes = x.T @ (mass * (chance - y[:, None]))
            bends = mass * chance * (1 - chance)
            for i, m in enumerate(places):
                part = np.concatenate([[mass[:, i].sum(), mass[:, i] @ loss[:, i]], slopes[:, i],
                                       ((x * bends[:, i:i + 1]).T @ x).ravel()])
                sums[m] = part if m not in sums else sums[m] + part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(int, sums))), pa.array(
                [s.tolist() for s in sums.values()], type=pa.list_(pa.float64()))], ["model", "s"])

    parts = rows.select("table", "x", "y", "w", "fold").mapInArrow(run, "model long, s array<double>")
    found = parts.groupBy("model").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    return {r["model"]: np.array(r["s"]) for r in found.toLocalIterator()}


def fit_grid(rows: DataFrame, models: list[GridModel], steps: int = STEPS) -> list[np.ndarray]:
    """Coefficients of each model, the intercept last, by damped Newton steps taken together.

    ``rows (table, x, y, w, fold)`` are stored; ``x`` has the same length within a table.  A model without rows or
    weight gets an empty vector.  Raises if a model has not ended after ``steps`` passes."""
    sizes = {r["table"]: r["d"] + 1 for r in rows.groupBy("table").agg(F.max(F.size("x")).alias("d")).collect()}
    betas = [np.zeros(sizes.get(m.table, 0)) for m in models]
    active = {i: betas[i] for i, m in enumerate(models) if m.table in sizes}      # what each model tries next
    base: dict[int, tuple] = {}                                                   # loss, slope . step, step, share
    for _ in range(steps):
        if not active:
            return betas
        found = _evaluate(rows, models, active)
        following = {}
        for m, beta in active.items():
            if m not in found or found[m][0] <= 0:
                betas[m] = np.zeros(0)
                continue
            d, s = len(beta), found[m]
            ridge = np.full(d, models[m].reg)
            ridge[-1] = 0.0
            loss = s[1] / s[0] + beta @ (ridge * beta) / 2
            if m in base:
                before, slant, step, share = base[m]
                if loss > before + 1e-4 * share * slant + 1e-12 * abs(before) + 1e-16 and share > 1e-8:
                    base[m] = (before, slant, step, share / 2)
                    following[m] = betas[m] + share / 2 * step
                    continue
            slope = s[2:2 + d] / s[0] + ridge * beta
            bend = s[2 + d:].reshape(d, d) / s[0] + np.diag(ridge)
            step = -np.linalg.lstsq(bend, slope, rcond=None)[0]
            betas[m] = beta
            if -slope @ step / 2 > SETTLED:
                base[m] = (loss, slope @ step, step, 1.0)
                following[m] = beta + step
            else:
                betas[m] = beta + step
        active = following
    raise RuntimeError(f"{len(active)} logistic models have not ended after {steps} steps")


def held_out_scores(rows: DataFrame, models: list[GridModel], betas: list[np.ndarray]) -> np.ndarray:
    """F-beta (0.5) of each model's positive class on the fold that it holds out, in one pass; rows count once."""
    own = _by_table(models, [i for i, b in enumerate(betas) if len(b)])
    held = np.array([m.held for m in models])

    def run(batches):
        sums = np.zeros((len(models), 3), dtype=np.int64)
        for places, x, y, _, fold in _batches(batches, own):
            said = x @ np.stack([betas[m] for m in places]).T > 0
            tested, truth = fold[:, None] == held[places], y[:, None] == 1
            for i, hit in enumerate((said & truth, said & ~truth, ~said & truth)):
                sums[places, i] += (hit & tested).sum(0)
        seen = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *[pa.array(sums[seen, i]) for i in range(3)]],
                                         ["model", "tp", "fp", "fn"])

    counts = (rows.select("table", "x", "y", "w", "fold").mapInArrow(run, "model long, tp long, fp long, fn long")
              .groupBy("model").agg(F.sum("tp"), F.sum("fp"), F.sum("fn")).collect())
    out = np.zeros(len(models))
    for m, tp, fp, fn in counts:
        out[m] = (1 + BETA ** 2) * tp / ((1 + BETA ** 2) * tp + BETA ** 2 * fn + fp) if tp else 0.0
    return out


def choose_and_fit(rows: DataFrame, grid: list[float], class_weights: list, folds: int
                   ) -> dict[int, tuple[np.ndarray, dict]]:
    """Per table of ``rows``: coefficients at the best grid point on all its rows, and that point.

    The best point has the highest mean F-beta over the held-out folds, the first of several.  ``grid`` has the C of
    a sum of losses; class weights are None, ``balanced`` or per class."""
    facts: dict[int, dict[int, tuple]] = {}
    for r in rows.groupBy("table", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w")).collect():
        facts.setdefault(r["table"], {})[int(r["y"])] = (r["n"], r["w"])

    def weights(table: int, option) -> tuple[float, float]:
        if option == "balanced":
            counts = {y: n for y, (n, _) in facts[table].items()}
            option = {y: sum(counts.values()) / (len(counts) * n) for y, n in counts.items()}
        return tuple(float((option or {}).get(y, 1.0)) for y in (0, 1))

    points = [(option, c) for option in class_weights for c in grid]

    def model(table: int, point: tuple, held: int, share: float) -> GridModel:
        w = weights(table, point[0])
        total = sum(w[y] * mass for y, (_, mass) in facts[table].items())
        return GridModel(table, 1.0 / (point[1] * total * share), held, *w)

    best = {t: points[0] for t in facts}
    if len(points) > 1:
        tried = [(t, p) for t in facts for p in points]
        models = [model(t, p, fold, (folds - 1) / folds) for t, p in tried for fold in range(folds)]
        means = held_out_scores(rows, models, fit_grid(rows, models)).reshape(len(tried), folds).mean(1)
        top: dict[int, float] = {}
        for (t, p), score in zip(tried, means):
            if score > top.get(t, -1.0):
                top[t], best[t] = score, p
    tables = sorted(facts)
    final = fit_grid(rows, [model(t, best[t], -1, 1.0) for t in tables])
    return {t: (beta, {"class_weight": best[t][0], "C": best[t][1]}) for t, beta in zip(tables, final)}


def margin(x: Column | str, beta: np.ndarray) -> Column:
    """Intercept plus the products of array ``x`` and the coefficients."""
    x = F.col(x) if isinstance(x, str) else x
    products = F.zip_with(x, F.array(*[F.lit(float(b)) for b in beta[:-1]]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(beta[-1])), lambda s, v: s + v)


def scored(rows: DataFrame, betas: dict[int, np.ndarray]) -> DataFrame:
    """``rows (table, x, ...)`` with ``probability`` and ``prediction`` of their table's model, in one plan.

    The coefficients, one array per table, are broadcast."""
    known = rows.sparkSession.createDataFrame([(t, [float(b) for b in beta]) for t, beta in betas.items()],
                                              "table int, _beta array<double>")
    joined = rows.join(F.broadcast(known), "table")
    products = F.zip_with("x", F.slice("_beta", 1, F.size("x")), lambda a, b: a * b)
    m = F.aggregate(products, F.element_at("_beta", -1), lambda s, v: s + v)
    out = joined.withColumn("probability", 1 / (1 + F.exp(-m)))
    return out.withColumn("prediction", (F.col("probability") > 0.5).cast("int")).drop("_beta")


def stored(parts: list[DataFrame]) -> DataFrame:
    """The union of ``parts``, written once."""
    while len(parts) > 1:               # in pairs, as every union goes through what it is made of again
        parts = [a.unionByName(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2:]
    return cut_lineage(parts[0])
