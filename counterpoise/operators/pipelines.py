"""Fitted pipelines on storage: what preparation and model have learnt, to score other tables later.

Parts (encoding tables, donors, Spark ML models) are written to a folder of their own; the small rest is one row that
is published last, so a reader finds a whole pipeline or the one before.  Scoring is a plan of its own: it fits
nothing, and whole rows go through it without a join by key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F

from counterpoise.operators.features import (Components, FittedPreparation, Preparation, Scaling, TargetEncoding,
                                             prepare)
from counterpoise.operators.kernels import FeatureMap, LandmarkMap
from counterpoise.operators.models import Fitted, ModelSpec, Vectors, fit_model
from counterpoise.sources.publication import publish, read_published


@dataclass
class FittedPipeline:
    """A preparation and a model that were fitted together."""

    preparation: FittedPreparation
    model: Fitted

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with the model's class and probability per row; nothing is fitted.

        Rows need the features only; unknown categories, null features and repeated rows are served as in the
        fit.  Raises if ``df`` has the new columns already.
        """
        names = [f"{self.model.name} Probability Estimate", f"{self.model.name} Prediction"]
        if clash := sorted(set(names) & set(df.columns)):
            raise ValueError(f"the table has {clash} already")
        ruled = self.model.rule is not None
        rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                         *(self.model.rule if ruled else self.preparation.settings.features))
        ready = rows if ruled else self.preparation.transform(rows)
        return self.model.predict(ready).select(
            *[F.col("_row")[c].alias(c) for c in df.columns], F.col("probability").alias(names[0]),
            F.col("prediction").alias(names[1]))


def fit_pipeline(labelled: DataFrame, unlabelled: DataFrame | None, settings: Preparation, spec: ModelSpec, key: str,
                 weight: str | None = None, inner_folds: int = 10) -> FittedPipeline:
    """Fit preparation and model on all labelled rows (scaling and donors on the unlabelled ones too)."""
    keep = [key] + ([weight] if weight else [])
    prepared = prepare(replace(settings, keep=keep), labelled, unlabelled=unlabelled)
    model = fit_model(spec, prepared.train, prepared.features, settings.target, key, weight, inner_folds)
    return FittedPipeline(prepared.fitted, model)


def save_pipeline(pipeline: FittedPipeline, path: str, spark: SparkSession, keep: int = 2) -> int:
    """Store a pipeline as the next version at ``path`` and return the version; parts of earlier ones stay."""
    part = f"parts-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{part}"
    ready, model = pipeline.preparation, pipeline.model
    told: dict = {"parts": part, "settings": asdict(ready.settings), "kept": ready.kept, "features": ready.features,
                  "encoding": None, "scaling": None if ready.scaling is None else asdict(ready.scaling),
                  "donors": ready.donors is not None, "components": None}
    if ready.encoding is not None:
        told["encoding"] = {"columns": ready.encoding.columns, "prior": ready.encoding.prior}
        for place, column in enumerate(ready.encoding.columns):
            ready.encoding.tables[column].write.parquet(f"{folder}/encoding-{place}")
    if ready.donors is not None:
        ready.donors.write.parquet(f"{folder}/donors")
    if ready.components is not None:
        told["components"] = {**ready.components.__dict__, "loadings": ready.components.loadings.tolist()}
    fmap = model.vectors.fmap if model.vectors else None
    kernel = None
    if isinstance(fmap, LandmarkMap):
        kernel = {"landmarks": {"gamma": fmap.gamma, "points": fmap.points.tolist(), "inverse": fmap.inverse.tolist(),
                                "mean_rest": fmap.mean_rest, "max_rest": fmap.max_rest}}
    elif fmap is not None:
        kernel = {"random": asdict(fmap)}
    for place, fitted in enumerate(model.models):
        fitted.write().save(f"{folder}/model-{place}")
    told["model"] = {"name": model.name, "columns": model.columns, "rule": model.rule, "beta": model.beta,
                     "vectors": model.vectors and {"columns": model.vectors.columns, "kernel": kernel},
                     "models": len(model.models), "sigmoid": model.sigmoid, "averaged": model.averaged,
                     "chosen": {k: list(v.items()) if isinstance(v, dict) else v for k, v in model.chosen.items()}}
    return publish(spark.createDataFrame([(json.dumps(told),)], "pipeline string"), path, keep)


def load_pipeline(spark: SparkSession, path: str, version: int | None = None) -> FittedPipeline:
    """The newest (or named) version of the pipeline stored at ``path``, also in another session."""
    told = json.loads(read_published(spark, path, version).first()[0])
    folder = f"{path.rstrip('/')}/{told['parts']}"
    encoding = components = None
    if told["encoding"]:
        columns = told["encoding"]["columns"]
        encoding = TargetEncoding(columns, told["encoding"]["prior"], {
            c: spark.read.parquet(f"{folder}/encoding-{place}") for place, c in enumerate(columns)})
    if told["components"]:
        components = Components(**{**told["components"], "loadings": np.array(told["components"]["loadings"])})
    ready = FittedPreparation(
        Preparation(**told["settings"]), encoding, told["kept"], told["scaling"] and Scaling(**told["scaling"]),
        spark.read.parquet(f"{folder}/donors") if told["donors"] else None, components, told["features"])
    model, vectors = told["model"], None
    if model["vectors"]:
        kernel, fmap = model["vectors"]["kernel"], None
        if kernel and "landmarks" in kernel:
            own = kernel["landmarks"]
            size = len(own["points"])
            fmap = LandmarkMap(**{**own, "points": np.array(own["points"]).reshape(size, -1),
                                  "inverse": np.array(own["inverse"]).reshape(size, size)})
        elif kernel:
            fmap = FeatureMap(**kernel["random"])
        vectors = Vectors(model["vectors"]["columns"], fmap)
    stages = [DefaultParamsReader.loadParamsInstance(f"{folder}/model-{place}", spark)
              for place in range(model["models"])]
    chosen = {k: {a: b for a, b in v} if isinstance(v, list) else v for k, v in model["chosen"].items()}
    return FittedPipeline(ready, Fitted(
        model["name"], model["columns"], model["rule"], model["beta"], vectors, stages,
        tuple(model["sigmoid"]) if model["sigmoid"] else None, model["averaged"], chosen))
