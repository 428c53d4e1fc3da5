"""Feature preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators import features as X
from counterpoise.operators.knn import knn_impute
from workload.registry import query
from workload.summary_queries import r, rounded
from workload.views import EMB_DIMS, V_EMB, V_PART, v_emb, v_part

EMB = [f"e{i}" for i in range(EMB_DIMS)]


@query("target_encode", f"""WITH {V_PART}, t AS (SELECT genus, count(y) AS n, avg(y) AS m FROM v_part
    WHERE y IS NOT NULL AND part_id % 4 <> 0 GROUP BY 1),
  prior AS (SELECT avg(y) AS p FROM v_part WHERE y IS NOT NULL AND part_id % 4 <> 0)
  SELECT name, round(coalesce(m / (1 + exp(-(n - 20) / 10.0::DOUBLE))
    + p * (1 - 1 / (1 + exp(-(n - 20) / 10.0::DOUBLE))), p), 9) AS genus
  FROM v_part v LEFT JOIN t ON v.genus = t.genus, prior""")
def target_encode(spark, sf):
    df = v_part(spark, sf)
    train = df.filter(F.col("y").isNotNull() & (F.col("part_id") % 4 != 0))
    out = X.fit_target_encoding(train, ["genus"], "y").transform(df)
    return out.select("name", F.round("genus", 9).alias("genus"))


@query("reject_numeric_categories", f"WITH {V_PART} SELECT DISTINCT genus FROM v_part")
def reject_numeric_categories(spark, sf):
    df = v_part(spark, sf)
    X.reject_numeric_categories(df, ["genus", "family"])
    return df.select("genus").distinct()


_VAR = ["use_m", "use_g", "tested", "alk", "herb"]


@query("variance_filter", f"WITH {V_PART}, k AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature FROM v_part HAVING var_pop({c}) > 0.8 * (1 - 0.8)" for c in _VAR)
    + " UNION ALL SELECT 'price') SELECT feature FROM k")
def variance_filter(spark, sf):
    kept = X.variance_filter(v_part(spark, sf), ["price", *_VAR], _VAR, 0.8)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("standard_scale", f"WITH {V_PART}, s AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in ("price", "soil", "alk"))
    + " FROM v_part) SELECT name, " + ", ".join(
    r(f"({c} - m_{c}) / d_{c}", c) for c in ("price", "soil", "alk")) + " FROM v_part, s")
def standard_scale(spark, sf):
    df = v_part(spark, sf).select("name", "price", "soil", "alk")
    return rounded(X.fit_standard_scale(df, ["price", "soil", "alk"]).transform(df))


@query("minmax_scale", f"WITH {V_PART}, s AS (SELECT " + ", ".join(
    f"min({c}) AS m_{c}, max({c}) - min({c}) AS d_{c}" for c in ("price", "soil"))
    + " FROM v_part) SELECT name, " + ", ".join(
    r(f"({c} - m_{c}) / d_{c}", c) for c in ("price", "soil")) + " FROM v_part, s WHERE y IS NOT NULL")
def minmax_scale(spark, sf):
    df = v_part(spark, sf).select("name", "price", "soil", "y")
    out = X.fit_minmax_scale(df, ["price", "soil"]).transform(df.filter("y is not null"))
    return rounded(out.select("name", "price", "soil"))


_SHARED = " + ".join(f"(a.e{i} IS NOT NULL AND b.e{i} IS NOT NULL)::INTEGER" for i in range(EMB_DIMS))
_SQUARES = " + ".join(f"coalesce((a.e{i} - b.e{i}) * (a.e{i} - b.e{i}), 0)" for i in range(EMB_DIMS))
_KNN = f"""WITH {V_EMB}, pairs AS (SELECT a.vec_id, sqrt(({_SQUARES}) * ({EMB_DIMS}::DOUBLE /
    ({_SHARED}))) AS d, {', '.join(f'a.e{i} AS a{i}, b.e{i} AS b{i}' for i in range(EMB_DIMS))}
    FROM v_emb a, v_emb b WHERE {' + '.join(f'a.e{i}' for i in range(EMB_DIMS))} IS NULL)""" + "".join(
    f""", f{i} AS (SELECT vec_id, avg(b{i}) AS x FROM (SELECT vec_id, b{i}, row_number() OVER
      (PARTITION BY vec_id ORDER BY d, b{i}) AS rn FROM pairs WHERE a{i} IS NULL AND b{i} IS NOT NULL
      AND d IS NOT NULL) WHERE rn <= 5 GROUP BY 1)""" for i in range(EMB_DIMS)) + " SELECT v.vec_id, " \
    + ", ".join(r(f"coalesce(v.e{i}, f{i}.x)", f"e{i}") for i in range(EMB_DIMS)) + " FROM v_emb v " \
    + " ".join(f"LEFT JOIN f{i} ON v.vec_id = f{i}.vec_id" for i in range(EMB_DIMS))


@query("knn_impute", _KNN)
def knn_impute_query(spark, sf):
    df = v_emb(spark, sf).drop("label")
    return rounded(knn_impute(df, df, EMB))


@query("knn_impute_cells", f"""WITH {V_EMB}, half AS (SELECT vec_id, e0, e1, e2 FROM v_emb),
  known AS (SELECT vec_id, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1 FROM embeddings),
  t AS (SELECT k.vec_id, k.e0, k.e1, h.e2 FROM known k JOIN half h ON k.vec_id = h.vec_id),
  p AS (SELECT a.vec_id, b.e2 AS x, row_number() OVER (PARTITION BY a.vec_id ORDER BY
    sqrt(((a.e0 - b.e0) ** 2 + (a.e1 - b.e1) ** 2) * 1.5), b.e2) AS rn
    FROM t a, t b WHERE a.e2 IS NULL AND b.e2 IS NOT NULL),
  f AS (SELECT vec_id, avg(x) AS x FROM p WHERE rn <= 5 GROUP BY 1)
  SELECT t.vec_id, {r('t.e0', 'e0')}, {r('t.e1', 'e1')}, {r('coalesce(t.e2, f.x)', 'e2')}
  FROM t LEFT JOIN f ON t.vec_id = f.vec_id""")
def knn_impute_cells(spark, sf):
    """The pruned path: two columns known everywhere, cells around pivots, small blocks."""
    full = v_emb(spark, sf, blank=False).select("vec_id", "e0", "e1")
    df = full.join(v_emb(spark, sf).select("vec_id", "e2"), on="vec_id")
    return rounded(knn_impute(df, df, ["e0", "e1", "e2"], block_rows=60, pivots=12))


@query("pca_explained")
def pca_explained(spark, sf):
    """Share of variance per kept component; loadings are checked in the tests."""
    df = v_emb(spark, sf, blank=False)
    fitted = X.fit_pca(df, EMB, 0.8)
    out = fitted.transform(df)
    return out.agg(*[F.var_samp(n).alias(n) for n in fitted.names])


@query("prepare_features")
def prepare_features(spark, sf):
    df = v_part(spark, sf)
    settings = X.Preparation(
        features=["use_m", "use_g", "alk", "herb", "price", "soil", "family", "genus"], target="y",
        categorical=["family", "genus"], binary=["use_m", "use_g", "alk", "herb"],
        continuous=["price", "soil"], keep=["name"], pca=True)
    labelled, unlabelled = df.filter("y is not null"), df.filter("y is null")
    out = X.prepare(settings, labelled.filter("part_id % 5 <> 0"), labelled.filter("part_id % 5 = 0"),
                    unlabelled)
    return (out.train.withColumn("role", F.lit("train"))
            .unionByName(out.test.withColumn("role", F.lit("test")))
            .unionByName(out.unlabelled.withColumn("role", F.lit("unlabelled")),
                         allowMissingColumns=True))
