"""Features, weights and models against direct computation."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from counterpoise.operators import evaluate as V, features as X, folds as K, logit_grid as G, models as M, weights as W
from counterpoise.operators.kernels import feature_map, kernel_matrix, kernel_sums


@pytest.fixture(scope="module")
def parts(spark):
    """300 rows: the target depends on a and b, labelling on a."""
    rng = np.random.default_rng(11)
    n = 300
    a, b = rng.normal(size=n).round(3), rng.normal(size=n).round(3)
    truth = (a + b + rng.normal(size=n) * 0.4 > 0).astype(float)
    seen = rng.random(n) < 1 / (1 + np.exp(-a))
    group = np.where(a > 0, "u", "v")
    rows = [(f"r{i}", float(a[i]), float(b[i]), str(group[i]),
             float(truth[i]) if seen[i] else None, float(truth[i])) for i in range(n)]
    df = spark.createDataFrame(
        rows, "id string, a double, b double, grp string, y double, truth double").cache()
    return df


def newton(x, y, c, w=None, steps=50):
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.ones(len(x)) if w is None else w
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 0
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        grad = c * x.T @ (w * (p - y)) + ridge @ beta
        hess = c * (x * (w * p * (1 - p))[:, None]).T @ x + ridge
        beta -= np.linalg.solve(hess, grad)
    return beta


@pytest.mark.parametrize("c,weighted", [(1.0, False), (0.1, True)])
def test_logistic_is_the_penalised_optimum(parts, c, weighted):
    df = parts.withColumn("w", F.lit(1.0) + (F.col("b") > 0).cast("double"))
    model, _ = W.fit_logistic(df, ["a", "b"], "truth", c, "w" if weighted else None)
    pdf = df.toPandas()
    beta = newton(pdf[["a", "b"]].to_numpy(), pdf["truth"].to_numpy(), c,
                  pdf["w"].to_numpy() if weighted else None)
    assert np.allclose([*model.coefficients, model.intercept], beta, atol=1e-4)


def test_propensity_weights(parts):
    out = W.propensity_logit(parts, "id", "y", ["a", "b", "grp"], ["grp"]).toPandas()
    assert len(out) == 300 and out["P(s|x)"].between(0, 1).all()
    assert np.allclose(out["weight"], 1 / out["P(s|x)"]) and (out["weight"] >= 1).all()
    # labelling follows a, so labelled rows are the likelier ones
    assert out[out.y.notna()]["P(s|x)"].mean() > out[out.y.isna()]["P(s|x)"].mean() + 0.05
    # weighting brings the labelled mean of a nearer to that of all rows
    lab = out[out.y.notna()]
    assert abs(np.average(lab.a, weights=lab.weight) - out.a.mean()) < abs(lab.a.mean() - out.a.mean())


def test_target_encoding_of_unseen_and_null_categories(spark):
    train = spark.createDataFrame([("p", 1.0)] * 3 + [("q", 0.0)] * 2 + [(None, 1.0)],
                                  "g string, y double")
    fit = X.fit_target_encoding(train, ["g"], "y", min_samples=1, smoothing=1)
    new = spark.createDataFrame([("p",), ("z",), (None,)], "g string")
    got = [r[0] for r in fit.transform(new).collect()]
    prior = 4 / 6
    share3, share1 = 1 / (1 + np.exp(-2)), 0.5
    assert got == pytest.approx([share3 + (1 - share3) * prior, prior,
                                 share1 + (1 - share1) * prior])
    with pytest.raises(ValueError):
        X.reject_numeric_categories(spark.createDataFrame([("1",), ("2.5",)], "g string"), ["g"])


def test_scale_of_constant_and_null_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    got = X.fit_standard_scale(df, ["a", "b"]).transform(df).collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0), (None, 0.0)]


def test_variance_filter_puts_kept_binary_columns_first(parts):
    df = parts.select("a", (F.col("a") > 0).cast("double").alias("half"),
                      (F.col("a") > 2.5).cast("double").alias("rare"))
    assert X.variance_filter(df, ["a", "half", "rare"], ["half", "rare"], 0.9) == ["half", "a"]


def test_pca_against_eigenvectors(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4)) + 3
    df = spark.createDataFrame([tuple(map(float, r)) for r in data],
                               ", ".join(f"x{i} double" for i in range(4)))
    fit = X.fit_pca(df, [f"x{i}" for i in range(4)], 0.8)
    values, vectors = np.linalg.eigh(np.cov(data.T))
    order = values.argsort()[::-1]
    ratio = np.cumsum(values[order]) / values.sum()
    assert len(fit.names) == int(np.argmax(ratio > 0.8)) + 1
    for j in range(len(fit.names)):
        want = vectors[:, order[j]]
        want = want * np.sign(want[np.abs(want).argmax()])
        assert np.allclose(fit.loadings[:, j], want, atol=1e-6)
    got = np.array(fit.transform(df).collect())
    assert np.allclose(got, (data - data.mean(0)) @ fit.loadings, atol=1e-8)


def test_prepare_fits_nothing_on_the_test_rows(parts):
    s = X.Preparation(["a", "b", "grp"], "truth", categorical=["grp"], keep=["id"])
    train, test = parts.filter("id < 'r2'"), parts.filter("id >= 'r2'")
    one = X.prepare(s, train, test.filter("a > 0"))
    two = X.prepare(s, train, test)
    a, b = ({r["id"]: r[2:] for df in (x.train, x.test) for r in df.collect()} for x in (one, two))
    assert len(a) < len(b) and all(v == pytest.approx(b[k], abs=1e-9) for k, v in a.items())
    for bad in (dict(scale=False), dict(scale=False, impute=False, pca=True)):
        with pytest.raises(ValueError):
            X.prepare(X.Preparation(["a"], "truth", **bad), train)


@pytest.mark.parametrize("kernel", ["rbf", "poly"])
def test_feature_maps_reproduce_their_kernels(kernel):
    x = np.random.default_rng(0).uniform(-0.3, 0.3, size=(40, 3))
    fmap = feature_map(kernel, 3, gamma=2.0 if kernel == "rbf" else None, size=4000)
    z = fmap.matrix(x)
    assert np.allclose(z @ z.T, kernel_matrix(x, x, fmap), atol=0.06 if kernel == "rbf" else 1e-12)


def test_random_features_for_large_samples(spark):
    x = np.random.default_rng(1).uniform(size=(60, 2)).round(3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "id int, a double, b double")
    sample = df.filter("id < 20")
    exact = dict(W.kernel_mean_moments(sample, df, "id", ["a", "b"], gamma=1.0).collect())
    rough = dict(W.kernel_mean_moments(sample, df, "id", ["a", "b"], gamma=1.0, method="random",
                                       size=4096).collect())
    want = kernel_matrix(x[:20], x, feature_map("rbf", 2, 1.0)).sum(1) * 20 / 60
    assert np.allclose([exact[i] for i in range(20)], want)
    assert np.allclose([rough[i] for i in range(20)], want, rtol=0.03)
    with pytest.raises(ValueError):
        W.kernel_mean_moments(sample, df, "id", ["a", "b"], kernel="other")


def box_optimum(k, kappa, least, steps=20000):
    """Projected gradient on the whole problem."""
    w, rate = np.full(len(k), 0.5), 1 / np.linalg.eigvalsh(k).max()
    for _ in range(steps):
        v = w - rate * (k @ w - kappa)
        w = np.clip(v, 0, 1)
        if w.sum() < least:
            lo, hi = 0.0, 2 + np.abs(v).max()
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if np.clip(v + mid, 0, 1).sum() < least else (lo, mid)
            w = np.clip(v + hi, 0, 1)
    return w


def test_kernel_means_are_exact_at_every_size(spark):
    x = np.random.default_rng(8).normal(size=(5003, 9)).round(3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)],
                               "id int, " + ", ".join(f"x{j} double" for j in range(9)))
    columns = [f"x{j}" for j in range(9)]
    for few, options in ((4, dict(gamma=1.0)), (9, dict(kernel="poly"))):     # 48620 monomials for 9 columns
        own = {k: v for k, v in options.items() if k != "kernel"}
        fmap = feature_map(options.get("kernel", "rbf"), few, **own)
        want = kernel_matrix(x[:, :few], x[:40, :few], fmap).sum(1) * 5003 / 40
        got = dict(W.kernel_mean_moments(df, df.filter("id < 40"), "id", columns[:few], **options).collect())
        assert len(got) == 5003 and np.allclose([got[i] for i in range(5003)], want)


def test_kernel_sums_by_blocks(spark):
    x = np.random.default_rng(9).normal(size=(50, 2))
    fmap = feature_map("rbf", 2, gamma=1.0)
    rows = spark.createDataFrame([(i, list(map(float, v)), float(i)) for i, v in enumerate(x)],
                                 "i long, v array<double>, weight double")
    for options in (dict(block=7), dict(block=7, tiles=1), dict(tiles=30)):
        got = dict(kernel_sums(rows, rows, fmap, **options).collect())
        assert np.allclose([got[i] for i in range(50)], kernel_matrix(x, x, fmap) @ np.arange(50))
    copies = rows.withColumn("v", F.array(F.lit(0.5), F.lit(1.0)))      # one hot vector
    same = kernel_matrix(x, np.array([[0.5, 1.0]]), fmap)[:, 0] * np.arange(50).sum()
    assert np.allclose([v for _, v in sorted(kernel_sums(rows, copies, fmap, block=7).collect())], same)
    none = kernel_sums(rows, rows.limit(0), fmap, block=7).collect()
    assert sorted(none) == [(i, 0.0) for i in range(50)]
    assert kernel_sums(rows.limit(0), rows, fmap).count() == 0


@pytest.mark.parametrize("block", [2048, 15])
def test_kernel_mean_matching_with_the_exact_kernel(spark, monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    x = np.random.default_rng(5).normal(size=(120, 3)).round(3)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double")
    picked = np.flatnonzero(x[:, 0] > 0.4)
    out, history = W.kernel_mean_matching(df.filter("a > 0.4"), df, "id", ["a", "b", "c"],
                                          tolerance=1e-5 if block > 1000 else 1e-4)
    fmap = feature_map("rbf", 3)
    k = kernel_matrix(x[picked], x[picked], fmap)
    kappa = kernel_matrix(x[picked], x, fmap).sum(1) * len(picked) / len(x)
    w = np.array([r["weight"] for r in sorted(out.select("id", "weight").collect())])
    best = box_optimum(k, kappa, -1e9)
    reached = w @ k @ w / 2 - kappa @ w
    assert reached == pytest.approx(best @ k @ best / 2 - kappa @ best, abs=1e-6)
    assert history[-1] == pytest.approx(reached, abs=1e-9)
    slope = k @ w - kappa                   # the conditions that hold at the optimum alone
    assert (slope[w < 1 - 1e-4] > -1e-3).all() and (slope[w > 1e-4] < 1e-3).all()
    if block > 1000:
        assert len(history) == 3            # one block ends at once


def test_kernel_mean_matching_of_several_blocks_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 120)
    x = (np.random.default_rng(6).normal(size=(300, 4)) / 8).round(4)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double, d double")
    out, history = W.kernel_mean_matching(df.filter("a > -0.1"), df, "id", ["a", "b", "c", "d"])
    assert len(history) < 70                # gradient steps alone, after one round, are 513
    picked = np.flatnonzero(x[:, 0] > -0.1)
    fmap = feature_map("rbf", 4)
    k = kernel_matrix(x[picked], x[picked], fmap)
    kappa = kernel_matrix(x[picked], x, fmap).sum(1) * len(picked) / len(x)
    w = np.array([r["weight"] for r in sorted(out.select("id", "weight").collect())])
    slope = k @ w - kappa
    assert (slope[w < 1 - 1e-5] > -1e-3).all() and (slope[w > 1e-5] < 1e-3).all()


def test_poisson_copies_of_heavy_rows(spark):
    from counterpoise.operators.models import poisson_copies
    for rate in (3.0, 700.0, 800.0, 20000.0):
        got = [r[0] for r in spark.range(2000).select(poisson_copies(F.lit(rate), "id", 1)).collect()]
        assert np.mean(got) == pytest.approx(rate, abs=5 * np.sqrt(rate / 2000))
        assert np.std(got) == pytest.approx(np.sqrt(rate), rel=0.1)


@pytest.mark.parametrize("bound", [1000.0, 0.5])
def test_kernel_mean_matching_reaches_the_optimum(spark, bound):
    x = np.random.default_rng(4).normal(size=(80, 2)).round(3)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)],
                               "id int, a double, b double")
    picked = np.flatnonzero(x[:, 0] > 0)
    sample = df.filter(F.col("a") > 0)
    out, history = W.kernel_mean_matching(sample, df, "id", ["a", "b"], weight_bound=bound,
                                          kernel="poly", degree=2, tolerance=1e-3, iterations=60)
    fmap = feature_map("poly", 2, degree=2)
    k = kernel_matrix(x[picked], x[picked], fmap)
    n = len(picked)
    kappa = kernel_matrix(x[picked], x, fmap).sum(1) * n / len(x)
    w = np.array([r["weight"] for r in sorted(out.select("id", "weight").collect())])
    assert (w >= 0).all() and (w <= 1).all()
    least = n * (1 - bound / np.sqrt(n))
    if bound < 1:
        assert w.sum() >= least - 1e-3 * n

    def goal(v):
        return v @ k @ v / 2 - kappa @ v
    assert goal(w) == pytest.approx(goal(box_optimum(k, kappa, least)), rel=5e-3)
    assert history[-1] < history[0]


def scores(df, **kw):
    return {r["metric"]: r["value"] for r in V.score_folds(df, [], "y", "p", **kw).collect()}


def test_scores_and_undefined_ratios(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 0, 1.0), (0, 1, 1.0), (0, 0, 4.0)],
                               "y int, p int, w double")
    s = scores(df, weight="w")
    assert s["accuracy"] == 6 / 8 and s["precision"] == s["recall"] == pytest.approx(2 / 3)
    assert s["f_beta"] == pytest.approx(1.25 * 2 / (1.25 * 2 + 0.25 + 1))
    none = scores(df.withColumn("p", F.lit(0)))
    assert none["precision"] == none["recall"] == none["f1"] == none["f_beta"] == 0.0


def test_curve_without_groups(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    rows = V.pr_curve(df, [], "y", "s").orderBy("recall", "threshold").collect()
    assert [(r["threshold"], r["precision"], r["recall"]) for r in rows] == [
        (1.0, 1.0, 0.0), (0.9, 1.0, 0.5), (0.1, 0.5, 1.0), (0.8, pytest.approx(2 / 3), 1.0)]
    assert V.average_precision(df, [], "y", "s").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


@pytest.mark.parametrize("spec", [
    M.logit([1.0], ["balanced", None]), M.kernel_svm([1.0], [None], size=64),
    M.boosted_trees([2], rounds=5), M.averaged_network(2, [4, 3]),
    M.rule_model("rule", ["flag"])], ids=lambda s: s.name)
def test_models_learn(parts, spec):
    df = parts.select("id", "a", "b", "truth", (F.col("a") > 0).cast("double").alias("flag"),
                      F.lit(1.0).alias("w"))
    train, test = df.filter("id < 'r2'"), df.filter("id >= 'r2'")
    fitted = M.fit_model(spec, train, ["a", "b"], "truth", "id", weight="w", folds=3)
    out = fitted.predict(test).toPandas()
    assert (out["prediction"] == out["truth"]).mean() > 0.65
    assert out["probability"].between(0, 1).all() and len(out) == test.count()


def test_poisson_copies_have_the_right_mean(spark):
    df = spark.range(20000).withColumn("r", F.when(F.col("id") % 2 == 0, 0.5).otherwise(3.0))
    out = df.withColumn("n", M.poisson_copies(F.col("r"), "id", 1)).groupBy("r").agg(
        F.avg("n").alias("m"), F.var_samp("n").alias("v")).collect()
    for r in out:
        assert r["m"] == pytest.approx(r["r"], rel=0.05) and r["v"] == pytest.approx(r["r"], rel=0.08)


def test_cross_validation_keeps_every_row_once(parts):
    labelled = parts.withColumn("w", F.lit(2.0))
    s = X.Preparation(["a", "b"], "truth", continuous=["a", "b"])
    specs = [M.logit([1.0], [None]), M.rule_model("rule", ["a"])]
    result, preds = M.cross_validate(labelled.withColumn("a", (F.col("a") > 0).cast("double")), None, s,
                                     specs, "id", k=2, repeats=1, weight="w", inner_folds=2)
    assert preds.groupBy("model", "id").count().filter("count > 1").count() == 0
    assert preds.count() == 600 and result.count() == 2 * 2 * 5
    good = result.filter("model = 'Logit' and metric = 'accuracy'").agg(F.avg("value")).first()[0]
    assert good > 0.7


def test_logistic_grid_is_the_penalised_optimum(spark):
    """Every model of two tables against its own Newton fit; jobs don't grow with the models."""
    rng = np.random.default_rng(3)
    tables = {}
    for t, d in ((4, 3), (9, 1)):
        x = rng.normal(size=(160, d)).round(3)
        y = (rng.random(160) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
        tables[t] = x, y, rng.integers(1, 4, 160).astype(float), rng.integers(0, 4, 160)
    rows = spark.createDataFrame([(t, x[i].tolist(), float(y[i]), float(w[i]), int(f[i])) for t, (x, y, w, f) in tables.items()
                                  for i in range(160)], "table int, x array<double>, y double, w double, fold int")
    rows = G.stored([rows])
    models = [G.GridModel(t, reg, held, w0, w1) for t in (4, 9) for reg in (1e-3, 0.1, 2.0) for held in (-1, 0, 3)
              for w0, w1 in ((1.0, 1.0), (0.4, 1.7))] + [G.GridModel(5, 1.0)]
    found = G.fit_grid(rows, models)
    scores = G.held_out_scores(rows, models, found)
    for m, beta, score in zip(models, found, scores):
        if m.table == 5:
            assert not len(beta)
            continue
        x, y, w, f = tables[m.table]
        keep = f != m.held
        mass = (w * np.where(y == 1, m.weight1, m.weight0))[keep]
        want = newton(x[keep], y[keep], 1 / (m.reg * mass.sum()), mass)
        assert np.allclose(beta, want, atol=1e-7)
        said, truth = (x[~keep] @ want[:-1] + want[-1] > 0), y[~keep] == 1
        hit, wrong, missed = (said & truth).sum(), (said & ~truth).sum(), (~said & truth).sum()
        assert score == pytest.approx(1.25 * hit / max(1.25 * hit + 0.25 * missed + wrong, 1e-9))


def test_logistic_grid_of_separable_and_one_class_tables(spark):
    rows = spark.createDataFrame([(0, [float(i)], float(i > 4), 1.0, i % 2) for i in range(10)]
                                 + [(1, [float(i)], 1.0, 1.0, i % 2) for i in range(6)],
                                 "table int, x array<double>, y double, w double, fold int")
    fits = G.choose_and_fit(G.stored([rows]), [0.1, 10.0], ["balanced", None], 2)
    assert fits[0][0][0] > 0 and np.isfinite(fits[1][0]).all()


def test_together_or_one_by_one(parts):
    """Cross-validation of all folds together gives what fits of each fold give."""
    labelled = parts.withColumn("w", F.lit(1.0) + (F.col("b") > 0).cast("double"))
    s = X.Preparation(["a", "b"], "truth", continuous=["a", "b"], keep=["id", "w"])
    spec = M.logit([0.1, 10.0], ["balanced", None])
    _, preds = M.cross_validate(labelled, None, s, [spec], "id", k=3, repeats=1, weight="w", inner_folds=3)
    got = {r["id"]: r["p"] for r in preds.collect()}
    folded = K.stratified_folds(labelled, "id", "truth", 3, 0, out="_outer")
    ready = X.prepare(s, folded.filter("_outer <> 1"), folded.filter("_outer = 1"))
    alone = M.fit_model(spec, ready.train, ready.features, "truth", "id", "w", 3).predict(ready.test).collect()
    assert len(alone) == 100 and all(got[r["id"]] == pytest.approx(r["probability"], abs=1e-6) for r in alone)
    assert len(got) == 300


@pytest.mark.parametrize("name, weight", [("cv_biased", None), ("cv_in_the_wild", "weight")])
def test_registered_cross_validation_is_whole(spark, sf_dir, monkeypatch, name, weight):
    """Ten folds of ten repeats, ten inner folds, and all of the grid."""
    import __spark_entry__
    asked = {}

    def caught(*given, **named):
        asked.update(inspect.signature(whole).bind(*given, **named).arguments)
        return given[0], None
    whole = M.cross_validate
    monkeypatch.setattr(M, "cross_validate", caught)
    __spark_entry__.queries()[name](spark, sf_dir)
    defaults = {p.name: p.default for p in inspect.signature(whole).parameters.values()}
    assert [asked.get(n, defaults[n]) for n in ("k", "repeats", "inner_folds", "weight")] == [10, 10, 10, weight]
    spec = asked["specs"][0]
    assert [p["C"] for p in spec.grid] == M.C_GRID and spec.class_weights == M.CLASS_WEIGHTS


def test_each_fold_comes_in_order_and_fails_as_one(spark):
    assert K.each_fold(spark, lambda rep, fold: spark.range(10 * rep + fold).count(), 3, 4, at_once=5) == [
        10 * rep + fold for rep in range(3) for fold in range(4)]
    with pytest.raises(ZeroDivisionError):
        K.each_fold(spark, lambda rep, fold: 1 // fold, 1, 3)


def test_registered_model_check_is_whole(spark, sf_dir, monkeypatch):
    """Ten folds of ten repeats of the selection model."""
    import __spark_entry__
    asked = {}

    def caught(*given, **named):
        asked.update(inspect.signature(whole).bind(*given, **named).arguments)
        return given[0]
    whole = W.propensity_model_check
    monkeypatch.setattr(W, "propensity_model_check", caught)
    __spark_entry__.queries()["propensity_model_check"](spark, sf_dir)
    defaults = {p.name: p.default for p in inspect.signature(whole).parameters.values()}
    assert [asked.get(n, defaults[n]) for n in ("k", "repeats")] == [10, 10]


def test_model_check_scores_every_fold_of_both_feature_sets(parts):
    got = W.propensity_model_check(parts, "id", "y", ["a", "b"], ["a"], [], k=2, repeats=2).collect()
    assert len(got) == 2 * 2 * 2 * 3
    marked = W.mark_selected(parts, "y")
    folded = K.stratified_folds(marked, "id", "selected", 2, 1)
    ready = X.prepare(W.propensity_settings("id", ["a", "b"], []), folded.filter("fold <> 1"), folded.filter("fold = 1"))
    _, apply = W.fit_logistic(ready.train, ["a"], "selected")
    want = apply(ready.test).agg(F.avg(F.pow(F.col("probability") - F.col("selected"), F.lit(2)))).first()[0]
    brier = [r["value"] for r in got if (r["feature_set"], r["rep"], r["fold"], r["metric"]) == ("apriori", 1, 1, "brier")]
    assert brier == [pytest.approx(want, abs=1e-5)]


def test_kernel_mean_matching_by_landmarks_takes_few_rounds(spark, monkeypatch):
    """Rows far beyond one block, and fewer landmarks than rows: few rounds, and the exact optimum."""
    monkeypatch.setattr(W, "BLOCK", 12)
    monkeypatch.setattr(W, "LANDMARKS", 64, raising=False)
    x = np.random.default_rng(8).normal(scale=0.13, size=(160, 4)).round(6)
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "id long, a double, b double, c double, d double")
    out, history = W.kernel_mean_matching(df.filter("a < 0.1"), df, "id", ["a", "b", "c", "d"], tolerance=1e-4)
    assert len(history) <= 14
    ids = np.flatnonzero(x[:, 0] < 0.1)
    w = {r["id"]: r["weight"] for r in out.collect()}
    assert sorted(w) == ids.tolist()
    own, fmap = x[ids], feature_map("rbf", 4)
    w = np.array([w[i] for i in ids.tolist()])
    slope = kernel_matrix(own, own, fmap) @ w - kernel_matrix(own, x, fmap).sum(1) * len(ids) / len(x)
    assert (slope[w < 1 - 1e-5] > -1e-2).all() and (slope[w > 1e-5] < 1e-2).all()
    assert np.all(np.diff(history) < 1e-6)


def test_landmark_moves_are_the_best_under_their_kernel(spark):
    """Weights at 0, at 1 and between, against coordinate descent on the landmarks' kernel plus the diagonal."""
    from counterpoise.operators.kernels import LandmarkMap
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 2)).round(4)
    near = LandmarkMap(0.5, np.empty((0, 2)), np.empty((0, 0)))
    for point in x[:6]:
        near = near.with_point(point)
    w, kw, kappa = rng.random(60), rng.normal(size=60) * 3, rng.normal(size=60) * 3
    state = spark.createDataFrame([(i, x[i].tolist(), float(w[i]), float(kw[i]), float(kappa[i])) for i in range(60)],
                                  "i long, v array<double>, w double, kw double, kappa double")
    phi, slope = near.matrix(x), kw - kappa
    kernel, want = phi @ phi.T + 0.05 * np.eye(60), w.copy()
    for _ in range(4000):
        for i in range(60):
            want[i] = np.clip(want[i] - (slope[i] + kernel[i] @ (want - w)) / kernel[i, i], 0, 1)
    for afar in (True, False):
        got = {r["i"]: r["d"] for r in W._landmark_moves(state, near, 0.05, 60, afar).collect()}
        assert np.allclose([w[i] + got[i] for i in range(60)], want, atol=1e-5)
    assert (want == 0).any() and (want == 1).any() and ((want > 0) & (want < 1)).any()
