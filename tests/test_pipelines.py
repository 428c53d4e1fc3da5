"""Stored pipelines and kernel landmarks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import features as X, models as M, pipelines as P
from counterpoise.operators.kernels import feature_map, kernel_matrix, landmark_map


@pytest.fixture(scope="module")
def rows(spark):
    """Rows with gaps, categories and repeated keys."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=160).round(3), rng.normal(size=160).round(3)
    truth = (a + b > 0).astype(float)
    return spark.createDataFrame(
        [(f"r{i % 150}", float(a[i]) if i % 11 else None, float(b[i]) if i % 7 else None, "uvw"[i % 3],
          float(a[i] > 0), float(truth[i]) if i % 4 else None) for i in range(160)],
        "id string, a double, b double, grp string, flag double, y double").cache()


SETTINGS = X.Preparation(["a", "b", "grp", "flag"], "y", categorical=["grp"], binary=["flag"], continuous=["a", "b"],
                         variance=0.9, pca=True)


@pytest.mark.parametrize("spec", [
    M.logit([1.0], ["balanced"]), M.kernel_svm([1.0], [None], size=24), M.boosted_trees([2], rounds=3),
    M.averaged_network(2, [3]), M.rule_model("rule", ["flag"])], ids=lambda s: s.name)
def test_a_loaded_pipeline_scores_as_the_fitted_one(spark, rows, tmp_path, spec):
    labelled, unlabelled = rows.filter("y is not null"), rows.filter("y is null")
    fitted = P.fit_pipeline(labelled, unlabelled, SETTINGS, spec, "id", inner_folds=3)
    path = str(tmp_path / "pipeline")
    assert P.save_pipeline(fitted, path, spark) == 1
    loaded = P.load_pipeline(spark.newSession(), path)
    names = [f"{spec.name} Probability Estimate", f"{spec.name} Prediction"]
    want = sorted(map(str, fitted.score(rows).collect()))
    other = spark.newSession().createDataFrame(rows.collect(), rows.schema)
    scored = loaded.score(other)
    assert scored.columns == [*rows.columns, *names]
    assert sorted(map(str, scored.collect())) == want
    assert loaded.model.chosen == fitted.model.chosen
    assert loaded.score(other.limit(0)).count() == 0
    if not spec.rule:
        strange = other.limit(1).withColumns({"grp": F.lit("never seen"), "a": F.lit(None).cast("double")})
        assert 0 <= loaded.score(strange).first()[names[0]] <= 1
    if spec.name == "Logit":                # the same model as scoring while fitting gives
        both = M.score_population(labelled, unlabelled, SETTINGS, spec, "id", inner_folds=3)
        once = sorted((r["id"], str(r["a"]), round(r[names[0]], 9)) for df in both for r in df.collect())
        assert once == sorted((r["id"], str(r["a"]), round(r[names[0]], 9)) for r in scored.collect())
    with pytest.raises(ValueError, match="already"):
        fitted.score(scored)


def test_scoring_moves_no_row_by_key(spark, rows):
    fitted = P.fit_pipeline(rows.filter("y is not null"), None, X.Preparation(["flag"], "y"), M.logit([1.0], [None]), "id")
    plan = fitted.score(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0]


def test_versions_of_a_pipeline(spark, rows, tmp_path):
    path, settings = str(tmp_path / "p"), X.Preparation(["flag"], "y")
    for c in (1.0, 0.01):
        fitted = P.fit_pipeline(rows.filter("y is not null"), None, settings, M.logit([c], [None]), "id")
        P.save_pipeline(fitted, path, spark)
    assert P.load_pipeline(spark, path).model.beta == fitted.model.beta
    assert P.load_pipeline(spark, path, 1).model.beta != fitted.model.beta


def test_landmarks_bound_the_kernel_and_beat_random_features(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(150, 3)) * 0.3 + c for c in rng.normal(size=(4, 3)) * 3]).round(4)
    df = spark.createDataFrame([tuple(map(float, v)) for v in x] + [(None, 1.0, 1.0)], "a double, b double, c double")
    true = kernel_matrix(x, x, feature_map("rbf", 3, 0.7))
    found = landmark_map(df, ["a", "b", "c"], 0.7, 64)
    phi = found.matrix(x)
    off = np.abs(true - phi @ phi.T)
    assert len(found.points) == 64 and off.max() <= found.max_rest + 1e-9
    assert found.mean_rest == pytest.approx(np.mean(1 - (phi ** 2).sum(1)), abs=1e-9)
    blind = feature_map("rbf", 3, 0.7, size=64).matrix(x)
    assert off.mean() < 0.2 * np.abs(true - blind @ blind.T).mean()
    again = landmark_map(df.repartition(5), ["a", "b", "c"], 0.7, 64)
    assert np.array_equal(again.points, found.points)


def test_few_rows_make_an_exact_map(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (3.0,), (None,)], "a double")
    found = landmark_map(df, ["a"], 1.0, 10)
    x = np.array([[0.0], [1.0], [3.0]])
    assert len(found.points) == 3 and found.max_rest < 1e-9
    assert np.allclose(found.matrix(x) @ found.matrix(x).T, kernel_matrix(x, x, found))
    none = landmark_map(df.limit(0), ["a"], 1.0, 10)
    assert len(none.points) == 0 and none.matrix(x).shape == (3, 0)
