"""Two-sample tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators import tests2s as T
from workload.registry import query
from workload.summary_queries import r, rounded
from workload.views import DOC_BINARY, DOC_CONTINUOUS, V_DOC, table, v_doc

LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _tall_sql(view: str, features: list[str], labelled: str) -> str:
    """Sample 1 the labelled rows, sample 2 all rows."""
    return "tall AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f}::DOUBLE AS value, CAST({labelled} AS INTEGER) AS in1, 1 AS in2 "
        f"FROM {view} WHERE {f} IS NOT NULL" for f in features) + ")"


def _doc_tall(spark, sf, features):
    return T.tall_labelled_vs_all(v_doc(spark, sf), features, "y")


def _line_tall(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn(
        "mark", F.when(F.col("l_returnflag") == "R", 1))
    return T.tall_labelled_vs_all(lines, LINE_FEATURES, "mark")


_TABLE = """ct AS (SELECT feature,
  count(*) FILTER (value = 1 AND in1 = 1) AS pos1, count(*) FILTER (value = 0 AND in1 = 1) AS neg1,
  count(*) FILTER (value = 1) AS pos2, count(*) FILTER (value = 0) AS neg2 FROM tall GROUP BY 1)"""
_DISCRETE = f"{V_DOC}, {_tall_sql('v_doc', DOC_BINARY, 'y IS NOT NULL')}, {_TABLE}"

# erf(x) = exp(-x^2) * sum over n of x^(2n+1) / Gamma(n + 3/2)
_ERFC = """(CASE WHEN {x} <= 0 THEN 1.0::DOUBLE WHEN {x} > 20 THEN 0.0::DOUBLE ELSE
  1 - list_sum([exp((2 * n + 1) * ln({x}) - {x} * {x} - lgamma(n + 1.5::DOUBLE))
                for n in range(0, 1500)]) END)"""

_CHI2 = f"""{_DISCRETE}, chi AS (SELECT *, (pos1 + neg1)::DOUBLE AS r1, (pos2 + neg2)::DOUBLE AS r2,
    (pos1 + pos2)::DOUBLE AS c1, (neg1 + neg2)::DOUBLE AS c2 FROM ct),
  chi2 AS (SELECT *, CASE WHEN r1 * r2 * c1 * c2 > 0 THEN (r1 + r2) *
    greatest(abs(pos1::DOUBLE * neg2 - neg1::DOUBLE * pos2) - (r1 + r2) / 2, 0) ** 2
    / (r1 * r2 * c1 * c2) END AS stat FROM chi)"""


@query("contingency_table", f"WITH {_DISCRETE} SELECT * FROM ct")
def contingency_table(spark, sf):
    return T.contingency_table(_doc_tall(spark, sf, DOC_BINARY))


@query("contingency_table_two_frames", f"WITH {_DISCRETE} SELECT * FROM ct")
def contingency_table_two_frames(spark, sf):
    df = v_doc(spark, sf)
    return T.contingency_table(T.tall_two_samples(df.filter("y is not null"), df, DOC_BINARY))


@query("chi2_2x2", f"""WITH {_CHI2} SELECT feature, pos1, neg1, pos2, neg2, {r('stat', 'chi2_stat')},
  {r(_ERFC.format(x='sqrt(stat / 2)'), 'chi2_p', 8)} FROM chi2""")
def chi2_2x2(spark, sf):
    out = T.chi2_2x2(T.contingency_table(_doc_tall(spark, sf, DOC_BINARY)))
    return out.withColumns({"chi2_stat": F.round("chi2_stat", 6), "chi2_p": F.round("chi2_p", 8)})


_LOGP = ("(lgamma(r1 + 1) - lgamma({x} + 1) - lgamma(r1 - {x} + 1) + lgamma(r2 + 1) "
         "- lgamma(c1 - {x} + 1) - lgamma(r2 - c1 + {x} + 1) - lgamma(r1 + r2 + 1) "
         "+ lgamma(c1 + 1) + lgamma(r1 + r2 - c1 + 1))")


@query("fisher_exact", f"""WITH {_CHI2}, terms AS (SELECT feature, pos1, neg1, pos2, neg2, r1, r2, c1,
    unnest(range(greatest(0, (c1 - r2)::BIGINT), least(r1, c1)::BIGINT + 1)) AS k FROM chi)
  SELECT feature, any_value(pos1) AS pos1, any_value(neg1) AS neg1, any_value(pos2) AS pos2,
    any_value(neg2) AS neg2,
    round(any_value(CASE WHEN neg1 * pos2 > 0 THEN pos1::DOUBLE * neg2 / (neg1::DOUBLE * pos2) END), 6)
    AS fisher_odds_ratio,
    round(sum(exp({_LOGP.format(x='k::DOUBLE')})) FILTER ({_LOGP.format(x='k::DOUBLE')} <=
      {_LOGP.format(x='pos1::DOUBLE')} + 1e-7), 8) AS fisher_p
  FROM terms GROUP BY feature""")
def fisher_exact(spark, sf):
    out = T.fisher_exact(T.contingency_table(_doc_tall(spark, sf, DOC_BINARY)))
    return out.withColumns({"fisher_odds_ratio": F.round("fisher_odds_ratio", 6),
                            "fisher_p": F.round("fisher_p", 8)})


def _continuous_sql(tall: str) -> str:
    return f"""{tall}, pv AS (SELECT feature, value, sum(in1)::DOUBLE AS a, sum(in2)::DOUBLE AS b
    FROM tall GROUP BY 1, 2),
  cum AS (SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS n1,
    sum(b) OVER (PARTITION BY feature) AS n2 FROM pv
    WINDOW w AS (PARTITION BY feature ORDER BY value)),
  stat AS (SELECT feature, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2,
    max(abs(ca / n1 - cb / n2)) AS d, sum(a * (cb - b + b / 2)) AS u, sum((a + b) ** 3 - (a + b)) AS ties
    FROM cum GROUP BY 1)"""


_DOC_STATS = _continuous_sql(f"{V_DOC}, {_tall_sql('v_doc', DOC_CONTINUOUS, 'y IS NOT NULL')}")
_LINE_STATS = _continuous_sql(_tall_sql("lineitem", LINE_FEATURES, "l_returnflag = 'R'"))
_STATS = f"""SELECT feature, n1, n2, {r('d', 'ks_statistic', 9)}, u AS mwu_statistic, ties FROM stat"""


@query("ks_and_mann_whitney", f"WITH {_DOC_STATS} {_STATS}")
def ks_and_mann_whitney(spark, sf):
    out = T.continuous_statistics(_doc_tall(spark, sf, DOC_CONTINUOUS))
    return out.withColumn("ks_statistic", F.round("ks_statistic", 9))


@query("ks_and_mann_whitney_bucketed", f"WITH {_LINE_STATS} {_STATS}")
def ks_and_mann_whitney_bucketed(spark, sf):
    """The bucketed path of the global prefix sums."""
    out = T.continuous_statistics(_line_tall(spark, sf), buckets=16)
    return out.withColumn("ks_statistic", F.round("ks_statistic", 9))


@query("ecdf", f"""WITH {V_DOC}, {_tall_sql('v_doc', DOC_CONTINUOUS, 'y IS NOT NULL')},
  pv AS (SELECT feature, value, sum(in1)::BIGINT AS a, sum(in2)::BIGINT AS b FROM tall GROUP BY 1, 2)
  SELECT feature, value, a, b,
    coalesce(sum(a) OVER w, 0)::BIGINT AS a_before, coalesce(sum(b) OVER w, 0)::BIGINT AS b_before
  FROM pv WINDOW w AS (PARTITION BY feature ORDER BY value
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ecdf(spark, sf):
    return T.value_counts(_doc_tall(spark, sf, DOC_CONTINUOUS), buckets=8)


@query("mid_ranks", """SELECT l_orderkey, l_partkey, l_linenumber, l_quantity,
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE
  AS mid_rank FROM lineitem""")
def mid_ranks(spark, sf):
    from counterpoise.operators.prefix import prefix_sums
    from counterpoise.operators.skew import lookup
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                                "l_quantity")
    per = prefix_sums(lines.withColumn("n", F.lit(1).cast("bigint")), [], "l_quantity", ["n"])
    ranks = per.withColumn("mid_rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))
    return lookup(lines, ranks, ["l_quantity"], ["mid_rank"])


_MWU_P = f"""z AS (SELECT *, (greatest(u, n1::DOUBLE * n2 - u) - n1::DOUBLE * n2 / 2 - 0.5) /
  sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS z
  FROM stat)"""


@query("mann_whitney_p", f"""WITH {_LINE_STATS}, {_MWU_P} SELECT feature, u AS mwu_statistic,
  {r(f"least(1.0, {_ERFC.format(x='(z / sqrt(2.0::DOUBLE))')})", 'mwu_p', 8)} FROM z""")
def mann_whitney_p(spark, sf):
    out = T.compare_samples_continuous(_line_tall(spark, sf))
    return out.select("feature", "mwu_statistic", F.round("mwu_p", 8).alias("mwu_p"))


@query("ks_p_value")
def ks_p_value(spark, sf):
    return T.compare_samples_continuous(_doc_tall(spark, sf, DOC_CONTINUOUS))


_CHI2_P = f"""{_CHI2}, ps AS (SELECT feature, {_ERFC.format(x='sqrt(stat / 2)')} AS p FROM chi2)"""


@query("holm", f"""WITH {_CHI2_P} SELECT feature, {r('p', 'p_value', 8)},
  {r('p * ((SELECT count(*) FROM ps) - row_number() OVER (ORDER BY p NULLS LAST, feature) + 1)',
     'corrected_p_value', 8)} FROM ps""")
def holm(spark, sf):
    tables = T.chi2_2x2(T.contingency_table(_doc_tall(spark, sf, DOC_BINARY)))
    return rounded(T.holm(tables.select("feature", F.col("chi2_p").alias("p_value"))), 8)


@query("stepdown_rank", f"""WITH {_CHI2_P} SELECT feature, (row_number() OVER (ORDER BY p NULLS LAST,
  feature) - 1)::INTEGER AS position FROM ps""")
def stepdown_rank(spark, sf):
    tables = T.chi2_2x2(T.contingency_table(_doc_tall(spark, sf, DOC_BINARY)))
    return T.stepdown_rank(tables, "chi2_p", "feature").select("feature", "position")


@query("compare_samples_discrete", f"""WITH {_CHI2} SELECT feature, {r('stat', 'chi2_stat')},
  round(CASE WHEN neg1 * pos2 > 0 THEN pos1::DOUBLE * neg2 / (neg1::DOUBLE * pos2) END, 6)
  AS fisher_odds_ratio, NULL::DOUBLE AS mwu_statistic FROM chi2 UNION ALL
  SELECT feature, NULL, NULL, u FROM ({'SELECT * FROM (WITH ' + _DOC_STATS + ' SELECT * FROM stat)'})""")
def compare_samples_discrete(spark, sf):
    tall = _doc_tall(spark, sf, DOC_BINARY + DOC_CONTINUOUS)
    out = T.compare_samples_discrete(tall, DOC_BINARY, with_p=False)
    return out.withColumns({"chi2_stat": F.round("chi2_stat", 6),
                            "fisher_odds_ratio": F.round("fisher_odds_ratio", 6)})


@query("compare_distributions", f"""WITH {_CHI2}, c AS (SELECT * FROM
    (WITH {_DOC_STATS} SELECT * FROM stat))
  SELECT feature, {r('d', 'ks_statistic', 9)}, u AS mwu_statistic, NULL::DOUBLE AS chi2_stat,
    NULL::DOUBLE AS fisher_odds_ratio FROM c UNION ALL
  SELECT feature, NULL, NULL, {r('stat', 's')}, round(CASE WHEN neg1 * pos2 > 0 THEN
    pos1::DOUBLE * neg2 / (neg1::DOUBLE * pos2) END, 6) FROM chi2""")
def compare_distributions(spark, sf):
    tall = _doc_tall(spark, sf, DOC_BINARY + DOC_CONTINUOUS)
    out = T.compare_distributions(tall, DOC_CONTINUOUS, DOC_BINARY, with_p=False)
    return out.withColumns({"ks_statistic": F.round("ks_statistic", 9),
                            "chi2_stat": F.round("chi2_stat", 6),
                            "fisher_odds_ratio": F.round("fisher_odds_ratio", 6)})


@query("selection_bias_report")
def selection_bias_report(spark, sf):
    _, corrected = T.selection_bias_report(v_doc(spark, sf), "y", DOC_CONTINUOUS, DOC_BINARY)
    return corrected


@query("stack_results", f"""WITH {_CHI2} SELECT feature, {r('stat', 'value')} FROM chi2 UNION ALL
  SELECT feature, {r('d', 'value')} FROM (WITH {_DOC_STATS} SELECT * FROM stat)""")
def stack_results(spark, sf):
    one = T.chi2_2x2(T.contingency_table(_doc_tall(spark, sf, DOC_BINARY)), with_p=False)
    two = T.continuous_statistics(_doc_tall(spark, sf, DOC_CONTINUOUS))
    return rounded(one.select("feature", F.col("chi2_stat").alias("value")).unionByName(
        two.select("feature", F.col("ks_statistic").alias("value"))))
