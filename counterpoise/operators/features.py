"""Feature preparation, fitted on training (and unlabelled) rows and applied to any."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from counterpoise.operators.knn import knn_impute
from counterpoise.operators.skew import BROADCAST_ROWS, lookup
from counterpoise.session import cut_lineage

SPREAD_ROWS = 50_000    # rows from which the preparation deals them evenly to tasks


def reject_numeric_categories(df: DataFrame, columns: list[str],
                              allowed: list[str] | None = None) -> None:
    """Raise if a categorical column reads as numbers throughout: it was encoded before."""
    check = [c for c in columns if c not in (allowed or [])]
    if not check:
        return
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS double)").isNull())
                   .alias(f"n{i}") for i, c in enumerate(check)]).first()
    bad = [c for c, n in zip(check, row) if n == 0]
    if bad:
        raise ValueError(f"categorical columns hold numbers only: {bad}")


@dataclass
class TargetEncoding:
    """Smoothed mean target per category; unseen categories get the overall mean."""

    columns: list[str]
    prior: float
    tables: dict[str, DataFrame] = field(repr=False)
    stored: bool = False        # whether the tables are read from storage as they are

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.columns:
            out = lookup(df, self.tables[c], {c: "category"}, ["encoded"], null_safe=True, stored=self.stored)
            df = out.select(*[F.coalesce("encoded", F.lit(self.prior)).alias(x) if x == c
                              else F.col(x) for x in df.columns])
        return df


def fit_target_encoding(train: DataFrame, columns: list[str], target: str,
                        min_samples: float = 20.0, smoothing: float = 10.0) -> TargetEncoding:
    """share * mean + (1 - share) * prior with share = 1 / (1 + exp(-(n - min_samples) / smoothing)).

    A null that occurs in training is a category of its own.
    """
    prior = train.agg(F.avg(target)).first()[0]
    share = 1 / (1 + F.exp(-(F.col("n") - min_samples) / smoothing))
    tables = {c: train.groupBy(F.col(c).alias("category")).agg(
        F.count(target).alias("n"), F.avg(target).alias("mean")).select(
        "category", F.coalesce(share * F.col("mean") + (1 - share) * F.lit(prior), F.lit(prior))
        .alias("encoded")) for c in columns}
    return TargetEncoding(list(columns), prior, tables)


def variance_filter(train: DataFrame, features: list[str], binary: list[str],
                    share: float) -> list[str]:
    """Features to keep: binary ones with variance over share * (1 - share) first, then the rest."""
    checked = [c for c in features if c in binary]
    if not checked:
        return list(features)
    row = train.agg(*[F.var_pop(c) for c in checked]).first()
    kept = [c for c, v in zip(checked, row) if v is not None and v > share * (1 - share)]
    return kept + [c for c in features if c not in checked]


@dataclass
class Scaling:
    """x -> (x - shift) / width per column."""

    shift: dict[str, float]
    width: dict[str, float]

    def column(self, c: str) -> Column:
        return (F.col(c) - F.lit(self.shift[c])) / F.lit(self.width[c])

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.column(c).alias(c) if c in self.shift else F.col(c)
                           for c in df.columns])


def _fit_scaling(df: DataFrame, columns: list[str], shift, width) -> Scaling:
    row = df.agg(*[f(F.col(c).cast("double")) for c in columns for f in (shift, width)]).first()
    shifts, widths = row[0::2], row[1::2]
    return Scaling({c: s if s is not None else 0.0 for c, s in zip(columns, shifts)},
                   {c: w or 1.0 for c, w in zip(columns, widths)})


def fit_standard_scale(df: DataFrame, columns: list[str]) -> Scaling:
    """Mean 0 and sd 1 (sd over n); nulls are left out, a constant column is only shifted."""
    return _fit_scaling(df, columns, F.avg, F.stddev_pop)


def fit_minmax_scale(df: DataFrame, columns: list[str]) -> Scaling:
    """To [0, 1] by the limits of ``df``."""
    return _fit_scaling(df, columns, F.min, lambda x: F.max(x) - F.min(x))


@dataclass
class Components:
    """Leading principal components of some columns; the other columns pass through."""

    columns: list[str]
    means: list[float]
    loadings: np.ndarray
    explained: list[float]

    @property
    def names(self) -> list[str]:
        return [f"pca{i}" for i in range(self.loadings.shape[1])]

    def transform(self, df: DataFrame) -> DataFrame:
        centred = [F.col(c) - F.lit(m) for c, m in zip(self.columns, self.means)]
        parts = [sum((x * F.lit(float(w)) for x, w in zip(centred, self.loadings[:, j])),
                     F.lit(0.0)).alias(n) for j, n in enumerate(self.names)]
        return df.select(*parts, *[c for c in df.columns if c not in self.columns])


def fit_pca(df: DataFrame, columns: list[str], explain: float = 0.8) -> Components:
    """The fewest components whose explained share exceeds ``explain``.

    Each is signed so that its largest loading is positive.
    """
    means = list(df.agg(*[F.avg(c) for c in columns]).first())
    vectors = VectorAssembler(inputCols=columns, outputCol="_x").transform(df.select(*columns))
    model = PCA(k=len(columns), inputCol="_x", outputCol="_y").fit(vectors)
    explained = [float(x) for x in model.explainedVariance]
    count = min(len(columns), int(np.searchsorted(np.cumsum(explained), explain, "right")) + 1)
    loadings = model.pc.toArray()[:, :count]
    peak = np.abs(loadings).argmax(axis=0)
    loadings = loadings * np.where(loadings[peak, np.arange(count)] < 0, -1.0, 1.0)
    return Components(list(columns), means, loadings, explained[:count])


@dataclass
class Preparation:
    """Settings of :func:`prepare`."""

    features: list[str]
    target: str
    categorical: list[str] = field(default_factory=list)
    may_be_numeric: list[str] = field(default_factory=list)
    binary: list[str] = field(default_factory=list)
    continuous: list[str] = field(default_factory=list)
    keep: list[str] = field(default_factory=list)
    impute: bool = True
    variance: float | None = None
    scale: bool = True
    pca: bool = False
    explain: float = 0.8
    min_samples: float = 20.0
    smoothing: float = 10.0
    neighbours: int = 5


@dataclass
class FittedPreparation:
    """What :func:`prepare` has learnt: the steps that turn rows as they come into features."""

    settings: Preparation
    encoding: TargetEncoding | None
    kept: list[str]
    scaling: Scaling | None
    donors: DataFrame | None = field(repr=False)        # scaled rows that values are imputed from
    components: Components | None
    features: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its feature columns replaced by ``features``; other columns pass through."""
        if self.encoding is not None:
            df = self.encoding.transform(df)
        df = df.drop(*[c for c in self.settings.features if c not in self.kept])
        if self.scaling is not None:
            df = self.scaling.transform(df)
        if self.donors is not None:
            df = knn_impute(df, self.donors, self.kept, self.settings.neighbours)
        return df if self.components is None else self.components.transform(df)


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    unlabelled: DataFrame | None
    features: list[str]
    fitted: FittedPreparation


def prepare(settings: Preparation, train: DataFrame, test: DataFrame | None = None,
            unlabelled: DataFrame | None = None) -> Prepared:
    """Encode, filter, scale, impute and reduce.

    Categories and variances are fitted on ``train`` alone, scaling, donors and components on train
    and unlabelled rows, nothing on ``test``.  Without ``test`` the training rows are the test.
    """
    s = settings
    if s.impute and not s.scale:
        raise ValueError("scale before imputing")
    if s.pca and not s.scale:
        raise ValueError("scale before the principal components")
    same = test is None
    roles = {"train": train, **({} if same else {"test": test}),
             **({} if unlabelled is None else {"unlabelled": unlabelled})}
    carried = [c for c in [*s.keep, s.target] if c not in s.features]
    # all roles go through in one table, so each step is one job over all rows
    stacked = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.select(F.lit(role).alias("_role"), *[c for c in carried if c in df.columns],
                   *s.features) for role, df in roles.items()])
    spread = stacked.count() > SPREAD_ROWS
    if spread:
        # a file of a few MB is one task's work however many rows it has, and so is all that is made from it
        stacked = cut_lineage(stacked.hint("rebalance"))
    fitted_on = F.col("_role") != "test"
    features = list(s.features)
    categorical = [c for c in s.categorical if c in features]
    encoding = scaling = donors = components = None
    if categorical:
        first = stacked.filter(F.col("_role") == "train")
        reject_numeric_categories(first, categorical, s.may_be_numeric)
        encoding = fit_target_encoding(first, categorical, s.target, s.min_samples, s.smoothing)
        if spread:
            encoding.tables, encoding.stored = {c: cut_lineage(t) for c, t in encoding.tables.items()}, True
        stacked = encoding.transform(stacked)
        # rows that are written already and only meet broadcast tables are not written again
        if not spread or any(t.count() > BROADCAST_ROWS for t in encoding.tables.values()):
            stacked = cut_lineage(stacked)
    if s.variance is not None:
        features = variance_filter(stacked.filter(F.col("_role") == "train"), features, s.binary,
                                   s.variance)
        stacked = stacked.select("_role", *[c for c in carried if c in stacked.columns], *features)
    kept = list(features)
    if s.scale:
        scaling = fit_standard_scale(stacked.filter(fitted_on), features)
        stacked = scaling.transform(stacked)
    if s.impute:
        donors = stacked.filter(fitted_on).select(*features)
        stacked = cut_lineage(knn_impute(stacked, donors, features, s.neighbours))
    if s.pca:
        reduced = [c for c in s.continuous if c in features]
        if reduced:
            components = fit_pca(stacked.filter(fitted_on), reduced, s.explain)
            stacked = components.transform(stacked)
            features = components.names + [c for c in features if c not in reduced]

    def part(role: str) -> DataFrame:
        have = [c for c in carried if c in roles[role].columns]
        return stacked.filter(F.col("_role") == role).select(*have, *features)

    return Prepared(part("train"), part("train" if same else "test"),
                    part("unlabelled") if "unlabelled" in roles else None, features,
                    FittedPreparation(s, encoding, kept, scaling, donors, components, list(features)))
