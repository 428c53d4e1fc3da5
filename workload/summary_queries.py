"""Summaries, regions and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.catalogue import Catalogue
from counterpoise.operators import quality as Q, regions as R, summary as M
from counterpoise.operators.quantiles import exact_quantiles, quantile_table
from workload.registry import query
from workload.views import (DOC_BINARY, DOC_CONTINUOUS, V_DOC, V_PART, V_RANGE, V_TAXA, V_WEIGHTED,
                            table, v_doc, v_part, v_range, v_taxa)
from workload.weights import v_weighted


def rounded(df, digits=6, skip=()):
    """Round every double column for comparison."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" and c not in skip
                       else F.col(c) for c, t in df.dtypes])


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


@query("corrected_prevalence", f"""WITH {V_WEIGHTED},
  sums AS (SELECT coalesce(family, 'All') AS family, avg(y) AS a,
    sum(weight * y) / sum(CASE WHEN y IS NOT NULL THEN weight END) AS c, avg(truth) AS t,
    count(y) AS n_labelled, count(*) FILTER (weight IS NULL) AS n_uncovered
    FROM v_weighted GROUP BY GROUPING SETS ((family), ()))
  SELECT family, {r('a', 'uncorrected')}, {r('c', 'corrected')}, {r('t', 'truth')}, n_labelled,
    n_uncovered FROM sums""")
def corrected_prevalence(spark, sf):
    """The flagship: raw, corrected and true prevalence by family and over all rows."""
    from counterpoise.functions.scalars import weighted_mean
    df = v_weighted(spark, sf)
    label = F.when(F.grouping("family") == 1, "All").otherwise(F.col("family"))
    out = df.groupingSets([[F.col("family")], []], F.col("family")).agg(
        label.alias("label"), F.avg("y").alias("uncorrected"),
        weighted_mean("y", "weight").alias("corrected"), F.avg("truth").alias("truth"),
        F.count("y").alias("n_labelled"), F.count_if(F.col("weight").isNull()).alias("n_uncovered"))
    return rounded(out.select(F.col("label").alias("family"), "uncorrected", "corrected", "truth",
                              "n_labelled", "n_uncovered"))


@query("prevalence_by_group", f"""WITH {V_WEIGHTED} SELECT coalesce(family, 'All') AS family,
  {r('avg(y)', 'uncorrected')}, {r('sum(weight * y) / sum(weight)', 'corrected')},
  count(*) AS n_labelled FROM v_weighted WHERE y IS NOT NULL
  GROUP BY GROUPING SETS ((family), ())""")
def prevalence_by_group(spark, sf):
    return rounded(M.prevalence_by_group(v_weighted(spark, sf), "family", "y", "weight"))


@query("estimated_positive_count", f"""WITH {V_WEIGHTED}, one AS (
  SELECT sum(weight * y) / sum(weight) AS m FROM v_weighted WHERE y IS NOT NULL)
  SELECT {r('m', 'corrected_mean')}, (SELECT count(*) FROM v_part) AS population,
  {r('m * (SELECT count(*) FROM v_part)', 'estimated_positives')} FROM one""")
def estimated_positive_count(spark, sf):
    df = v_weighted(spark, sf)
    return rounded(M.estimated_positive_count(df.filter(F.col("y").isNotNull()),
                                              v_part(spark, sf), "y", "weight"))


STRATEGIES = {"Specific use": "use_m", "General use": "use_g", "Alkaloids": "alk"}


@query("strategy_precision", f"WITH {V_WEIGHTED} " + " UNION ALL ".join(
    f"""SELECT '{n}' AS strategy, {r('avg(y)', 'uncorrected')},
    {r('sum(weight * y) / sum(weight)', 'corrected')}
    FROM v_weighted WHERE y IS NOT NULL {cond}""" for n, cond in
    [("Random", ""), *[(n, f"AND {f} = 1") for n, f in STRATEGIES.items()]]))
def strategy_precision(spark, sf):
    return rounded(M.strategy_precision(v_weighted(spark, sf), "y", "weight", STRATEGIES))


@query("strategy_accuracy", f"""WITH {V_WEIGHTED}
  SELECT 'Random' AS strategy, 0.5::DOUBLE AS uncorrected, 0.5::DOUBLE AS corrected UNION ALL """
       + " UNION ALL ".join(f"""SELECT '{n}', {r(f'avg(CASE WHEN {f} = y THEN 1 ELSE 0 END)', 'u')},
       {r(f'sum(weight * CASE WHEN {f} = y THEN 1 ELSE 0 END) / sum(weight)', 'c')}
       FROM v_weighted WHERE y IS NOT NULL""" for n, f in STRATEGIES.items()))
def strategy_accuracy(spark, sf):
    df = v_weighted(spark, sf).filter(F.col("y").isNotNull())
    return rounded(M.strategy_accuracy(df, "y", "weight", STRATEGIES))


@query("strategy_result", f"""WITH {V_WEIGHTED} SELECT alk, y,
  CASE WHEN alk = y THEN 1 ELSE 0 END AS result, {r('weight', 'weight')} FROM v_weighted
  WHERE y IS NOT NULL""")
def strategy_result(spark, sf):
    df = v_weighted(spark, sf).filter(F.col("y").isNotNull())
    return rounded(M.strategy_result(df, "alk", "y", "weight"))


COOC = ["use_m", "use_g", "tested", "alk", "herb", "y"]


def _cooc_pair(a: str, b: str) -> str:
    first = "true" if a == "All Species" else f"{a} = 1"
    n, m = f"count(*) FILTER ({first} AND {b} IS NOT NULL)", f"count(*) FILTER ({first} AND {b} = 1)"
    ratio = "NULL::DOUBLE" if a == b else f"{m} / {n}::DOUBLE"
    value = f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE {ratio} END"
    return (f"SELECT '{a.replace('_', ' ')}' AS var1, '{b.replace('_', ' ')}' AS var2, "
            f"{value} AS ratio FROM v_part")


_UNIT = "1152921504606846976::HUGEINT"
_COOC = f"""WITH {V_PART}, pairs AS ({' UNION ALL '.join(
    _cooc_pair(a, b) for a in [*COOC, 'All Species'] for b in COOC)}),
  units AS (SELECT *, (ratio * 1152921504606846976::DOUBLE)::HUGEINT AS m FROM pairs),
  cut AS (SELECT *, (m * 100) // {_UNIT} AS low, (m * 100) % {_UNIT} AS rest FROM units),
  cooc AS (SELECT var1, var2, ratio, (low + CASE WHEN rest * 2 > {_UNIT} OR
    (rest * 2 = {_UNIT} AND low % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS value FROM cut)"""


@query("conditional_cooccurrence", f"""{_COOC} SELECT var1, var2, {r('ratio', 'ratio')}, value
  FROM cooc""")
def conditional_cooccurrence(spark, sf):
    return rounded(M.conditional_cooccurrence(v_part(spark, sf), COOC), skip=("value",))


@query("cooccurrence_matrix", f"{_COOC} SELECT var2, " + ", ".join(
    f"max(value) FILTER (var1 = '{a}') AS \"{a}\"" for a in
    [c.replace("_", " ") for c in [*COOC, "All Species"]]) + " FROM cooc GROUP BY var2")
def cooccurrence_matrix(spark, sf):
    return M.cooccurrence_matrix(M.conditional_cooccurrence(v_part(spark, sf), COOC))


@query("count_per_region", f"""WITH {V_RANGE} SELECT region_code AS "Region", count(*) AS n_species
  FROM v_pairs JOIN v_part USING (part_id) GROUP BY 1""")
def count_per_region(spark, sf):
    return R.count_per_region(v_range(spark, sf), "codes")


_REGION = """count(*) AS num_all, count(y) AS num_labelled, count(*) FILTER (y = 1) AS num_active"""


@query("region_counts", f"""WITH {V_RANGE} SELECT region_code AS "Region", {_REGION}
  FROM v_pairs JOIN v_part USING (part_id) GROUP BY 1""")
def region_counts(spark, sf):
    return R.region_counts(v_range(spark, sf), "codes", "y")


@query("species_region_counts", f"""WITH {V_RANGE} SELECT region_code AS "Region", {_REGION}
  FROM v_pairs JOIN v_part USING (part_id) WHERE family = 'PROMO' GROUP BY 1 ORDER BY 1""")
def species_region_counts(spark, sf):
    cat = Catalogue(rank="family", species_rank="PROMO")
    return R.species_region_counts(v_range(spark, sf), "codes", "y", cat)


@query("proportion_per_region", f"""WITH {V_RANGE}, c AS (SELECT region_code, {_REGION}
  FROM v_pairs JOIN v_part USING (part_id) GROUP BY 1)
  SELECT region_code AS "Region", num_active, num_labelled,
  {r('num_active / num_labelled::DOUBLE', 'proportion')} FROM c WHERE num_active > 0""")
def proportion_per_region(spark, sf):
    return rounded(R.proportion_per_region(v_range(spark, sf), "codes", "y"))


@query("proportion_min_support", f"""WITH {V_RANGE}, c AS (SELECT region_code, {_REGION}
  FROM v_pairs JOIN v_part USING (part_id) GROUP BY 1)
  SELECT region_code AS "Region", num_active, num_labelled,
  {r('num_active / num_labelled::DOUBLE', 'proportion')} FROM c
  WHERE num_active > 0 AND num_labelled > 2""")
def proportion_min_support(spark, sf):
    return rounded(R.proportion_per_region(v_range(spark, sf), "codes", "y", more_than=2))


@query("natural_inner_merge", f"""WITH {V_RANGE}, c AS (SELECT region_code, {_REGION}
  FROM v_pairs JOIN v_part USING (part_id) GROUP BY 1)
  SELECT region_code AS "Region", num_active, num_labelled FROM c WHERE num_active > 0""")
def natural_inner_merge(spark, sf):
    from counterpoise.operators.enrich import natural_inner_merge as merge
    df = v_range(spark, sf)
    return merge(R.count_per_region(df.filter("y = 1"), "codes", "num_active"),
                 R.count_per_region(df.filter("y is not null"), "codes", "num_labelled"))


def _describe_sql(view: str, cols: list[str], where: str = "", digits: int = 5) -> str:
    def q(c, p):
        return f"quantile_cont({c}, {p})"
    return " UNION ALL ".join(f"""SELECT '{c}' AS feature, count({c}) AS count,
      {r(f'avg({c})', 'mean', digits)}, {r(f'stddev_samp({c})', 'std', digits)},
      {r(f'min({c})', 'min', digits)}, {r(q(c, 0.25), 'q25', digits)}, {r(q(c, 0.5), 'q50', digits)},
      {r(q(c, 0.75), 'q75', digits)}, {r(f'max({c})', 'max', digits)} FROM {view} {where}"""
                              for c in cols)


DESCRIBED = ["alk", "herb", "price", "soil", "y"]


@query("describe_all", f"WITH {V_PART} " + _describe_sql("v_part", DESCRIBED))
def describe_all(spark, sf):
    return rounded(M.describe(v_part(spark, sf), DESCRIBED), 5)


@query("describe_labelled", f"WITH {V_PART} " + _describe_sql("v_part", DESCRIBED,
                                                              "WHERE y IS NOT NULL"))
def describe_labelled(spark, sf):
    return rounded(M.describe(v_part(spark, sf).filter("y is not null"), DESCRIBED), 5)


@query("describe_family", f"WITH {V_PART} " + _describe_sql("v_part", DESCRIBED,
                                                            "WHERE family = 'PROMO'"))
def describe_family(spark, sf):
    return rounded(M.describe(v_part(spark, sf).filter("family = 'PROMO'"), DESCRIBED), 5)


LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_lineitem", _describe_sql("lineitem", LINE_COLUMNS, digits=4))
def describe_lineitem(spark, sf):
    return rounded(M.describe(table(spark, sf, "lineitem"), LINE_COLUMNS), 4)


@query("exact_quantiles_narrowed", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {p}::DOUBLE AS prob, {r(f'quantile_cont({c}, {p})', 'value', 4)} "
    "FROM lineitem" for c in LINE_COLUMNS for p in (0.01, 0.5, 0.99)))
def exact_quantiles_narrowed(spark, sf):
    """The narrowing path, with stretches of at most 1000 rows ordered in one task."""
    probs = [0.01, 0.5, 0.99]
    found = exact_quantiles(table(spark, sf, "lineitem"), LINE_COLUMNS, probs, small=1000)
    return rounded(spark.createDataFrame(
        [(c, p, v) for c, vs in found.items() for p, v in zip(probs, vs)],
        "feature string, prob double, value double"), 4, skip=("prob",))


@query("quantile_table", f"WITH {V_WEIGHTED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 0.5::DOUBLE AS prob, {r(f'quantile_cont({c}, 0.5)', 'value')} "
    "FROM v_weighted WHERE y IS NULL" for c in ("ps", "price", "soil")))
def quantile_query(spark, sf):
    df = v_weighted(spark, sf).filter("y is null")
    return rounded(quantile_table(df, ["ps", "price", "soil"], [0.5]), skip=("prob",))


@query("below_quantile", f"""WITH {V_WEIGHTED} SELECT name, y FROM v_weighted WHERE price <
  (SELECT quantile_cont(price, 0.5) FROM v_weighted WHERE y IS NULL)""")
def below_quantile(spark, sf):
    df = v_weighted(spark, sf)
    median = exact_quantiles(df.filter("y is null"), ["price"], [0.5])["price"][0]
    return df.filter(F.col("price") < F.lit(median)).select("name", "y")


BINARY = ["use_m", "use_g", "tested", "alk", "herb"]


@query("mean_target_by_presence", f"WITH {V_PART} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {r(f'avg(y) FILTER ({c} = 1)', 'presence')},
    {r(f'avg(y) FILTER ({c} = 0)', 'absence')} FROM v_part""" for c in BINARY))
def mean_target_by_presence(spark, sf):
    return rounded(M.mean_target_by_presence(v_part(spark, sf), BINARY, "y"))


@query("trait_means_by_class", f"WITH {V_PART} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS trait, {r(f'avg({c}) FILTER (y = 1)', 'active')},
    {r(f'avg({c}) FILTER (y = 0)', 'inactive')} FROM v_part""" for c in [*BINARY, "price", "soil"]))
def trait_means_by_class(spark, sf):
    return rounded(M.trait_means_by_class(v_part(spark, sf), [*BINARY, "price", "soil"], "y"))


@query("class_counts", """SELECT 'Active' AS label, count(*) FILTER (o_orderstatus = 'F') AS n
  FROM orders UNION ALL SELECT 'Weak', count(*) FILTER (o_orderstatus = 'P') FROM orders
  UNION ALL SELECT 'Inactive', count(*) FILTER (o_orderstatus = 'O') FROM orders""")
def class_counts(spark, sf):
    status = F.col("o_orderstatus")
    df = table(spark, sf, "orders").select(
        F.when(status == "F", 2).when(status == "P", 1).when(status == "O", 0).alias("y"))
    return M.class_counts(df, "y")


def _means_sql(view: str, cols: list[str], scale: bool, corrected: bool) -> str:
    def s(e, c):
        return f"({e} - min({c})) / (max({c}) - min({c}))" if scale else e
    out = []
    for c in cols:
        w = (r(s(f"sum(weight * {c}) FILTER (y IS NOT NULL) / sum(weight) FILTER (y IS NOT NULL AND "
                 f"{c} IS NOT NULL)", c), "corrected") + ",") if corrected else ""
        out.append(f"""SELECT '{c}' AS feature, {r(s(f'avg({c}) FILTER (y IS NOT NULL)', c),
                   'labelled')}, {w} {r(s(f'avg({c})', c), 'population')} FROM {view}""")
    return " UNION ALL ".join(out)


@query("means_labelled_vs_all_scaled",
       f"WITH {V_PART} " + _means_sql("v_part", ["price", "soil"], True, False))
def means_labelled_vs_all_scaled(spark, sf):
    return rounded(M.compare_means(v_part(spark, sf), ["price", "soil"], "y", scale=True))


@query("means_labelled_vs_all", f"WITH {V_PART} " + _means_sql("v_part", BINARY, False, False))
def means_labelled_vs_all(spark, sf):
    return rounded(M.compare_means(v_part(spark, sf), BINARY, "y"))


@query("corrected_means_discrete",
       f"WITH {V_WEIGHTED} " + _means_sql("v_weighted", BINARY, False, True))
def corrected_means_discrete(spark, sf):
    return rounded(M.compare_means(v_weighted(spark, sf), BINARY, "y", "weight"))


@query("corrected_means_continuous",
       f"WITH {V_WEIGHTED} " + _means_sql("v_weighted", ["price", "soil"], True, True))
def corrected_means_continuous(spark, sf):
    return rounded(M.compare_means(v_weighted(spark, sf), ["price", "soil"], "y", "weight",
                                   scale=True))


@query("mean_propensity_by_class", f"""WITH {V_WEIGHTED} SELECT
  {r('avg(ps) FILTER (y = 1)', 'active')}, {r('avg(ps) FILTER (y = 0)', 'inactive')}
  FROM v_weighted""")
def mean_propensity_by_class(spark, sf):
    return rounded(M.mean_propensity_by_class(v_weighted(spark, sf), "y", "ps"))


_LIMITS = "(SELECT min({0}) AS lo, max({0}) AS hi FROM {1})"


@query("histogram_fixed_width", f"""WITH b AS (SELECT least(floor((l_extendedprice - lo) / 5000.0),
    ceil((hi - lo) / 5000.0) - 1)::BIGINT AS bin, lo
    FROM lineitem, {_LIMITS.format('l_extendedprice', 'lineitem')})
  SELECT bin, count(*) AS n, {r('any_value(lo) + bin * 5000.0', 'left_edge', 4)} FROM b GROUP BY bin""")
def histogram_fixed_width(spark, sf):
    return rounded(M.histogram(table(spark, sf, "lineitem"), "l_extendedprice", width=5000.0), 4)


@query("histogram_by_target", f"""WITH {V_PART}, b AS (SELECT y,
    least(floor((price - lo) / ((hi - lo) / 101)), 100)::BIGINT AS bin, lo, hi
    FROM v_part, {_LIMITS.format('price', 'v_part')} WHERE price IS NOT NULL)
  SELECT bin, y, count(*) AS n, {r('any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 101)',
                                   'left_edge', 4)} FROM b GROUP BY bin, y""")
def histogram_by_target(spark, sf):
    return rounded(M.histogram(v_part(spark, sf), "price", bins=101, by="y"), 4)


# A score table: mean discount per (return flag, month) stands for scores per (model, fold).
_SCORES = """scores AS (SELECT l_returnflag AS model, 'd' AS metric, year(l_shipdate) AS rep,
  month(l_shipdate) AS fold, avg(l_discount) AS value FROM lineitem GROUP BY ALL)"""


def _scores(spark, sf):
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_returnflag").alias("model"), F.lit("d").alias("metric"),
                     F.year("l_shipdate").alias("rep"), F.month("l_shipdate").alias("fold"))
            .agg(F.avg("l_discount").alias("value")))


@query("boxplot_stats", f"""WITH {_SCORES}, q AS (SELECT model, quantile_cont(value, 0.25) AS q25,
    quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM scores GROUP BY 1),
  f AS (SELECT s.model, q25, q50, q75, value, value BETWEEN q25 - 1.5 * (q75 - q25)
    AND q75 + 1.5 * (q75 - q25) AS inside FROM scores s JOIN q ON s.model = q.model)
  SELECT model, {r('q25', 'q25')}, {r('q50', 'q50')}, {r('q75', 'q75')},
    {r('min(value) FILTER (inside)', 'whisker_low')}, {r('max(value) FILTER (inside)', 'whisker_high')},
    count(*) FILTER (NOT inside) AS n_outliers FROM f GROUP BY model, q25, q50, q75""")
def boxplot_stats(spark, sf):
    return rounded(M.boxplot_stats(_scores(spark, sf), "model", "value"))


@query("fold_score_summary", f"""WITH {_SCORES} SELECT model, metric, count(*) AS count,
  {r('avg(value)', 'mean')}, {r('stddev_samp(value)', 'std')}, {r('min(value)', 'min')},
  {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.5)', 'q50')},
  {r('quantile_cont(value, 0.75)', 'q75')}, {r('max(value)', 'max')} FROM scores GROUP BY 1, 2""")
def fold_score_summary(spark, sf):
    return rounded(M.fold_score_summary(_scores(spark, sf)))


@query("fold_score_table", f"WITH {_SCORES} SELECT rep::INTEGER AS rep, fold::INTEGER AS fold, "
       + ", ".join(f"{r(f'''max(value) FILTER (model = '{m}')''', m)}" for m in "ANR")
       + " FROM scores GROUP BY 1, 2")
def fold_score_table(spark, sf):
    return rounded(M.fold_score_table(_scores(spark, sf), "d", ["A", "N", "R"]))


@query("surprise_report", f"""WITH {V_WEIGHTED}, p AS (SELECT price, use_g, y FROM v_weighted),
  rare AS (SELECT * FROM p WHERE price < (SELECT quantile_cont(price, 0.5) FROM p WHERE y IS NULL)),
  u AS (SELECT sum(use_g) AS num, avg(use_g) AS rate, count(*) AS len FROM rare WHERE y IS NULL),
  l AS (SELECT sum(y) AS num, avg(y) AS rate, count(*) AS len FROM rare WHERE y IS NOT NULL)
  SELECT 'unlabelled' AS "case", {r('num', 'num')}, {r('rate', 'rate')}, len FROM u
  UNION ALL SELECT 'upperlim', {r('num * 0.75', 'num')}, {r('rate * 0.75', 'rate')}, len FROM u
  UNION ALL SELECT 'lowerlim', {r('num * 0.5', 'num')}, {r('rate * 0.5', 'rate')}, len FROM u
  UNION ALL SELECT 'labelled', {r('num', 'num')}, {r('rate', 'rate')}, len FROM l""")
def surprise_report(spark, sf):
    df = v_weighted(spark, sf)
    return rounded(M.surprise_report(df.filter("y is null"), df.filter("y is not null"), "price",
                                     "use_g", "y", 0.5, 0.75))


# ---- quality ----------------------------------------------------------------------------------

@query("known_set_differences", f"""WITH {V_PART}, a AS (SELECT name FROM v_part WHERE use_m = 1),
  b AS (SELECT name FROM v_part WHERE truth = 1)
  SELECT name AS key, 'table only' AS side FROM (FROM a EXCEPT FROM b) UNION ALL
  SELECT name, 'source only' FROM (FROM b EXCEPT FROM a)""")
def known_set_differences(spark, sf):
    df = v_part(spark, sf)
    return Q.known_set_differences(df, "name", "use_m", df.filter("truth = 1"))


def _set_sql(a: str, b: str) -> str:
    return f"CAST(NOT EXISTS (({a} EXCEPT {b}) UNION ALL ({b} EXCEPT {a})) AS INTEGER)"


@query("same_members", "SELECT " + _set_sql("SELECT c_nationkey FROM customer",
                                            "SELECT n_nationkey FROM nation") + " AS same_keys, "
       + _set_sql("SELECT c_mktsegment FROM customer", "SELECT o_orderpriority FROM orders")
       + " AS same_segments")
def same_members(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation = table(spark, sf, "nation")
    same = Q.same_members(customer.select("c_nationkey"), nation.select("n_nationkey"))
    other = Q.same_members(customer.select("c_mktsegment"), orders.select("o_orderpriority"))
    return nation.agg(F.count(F.lit(1))).select(same.cast("int").alias("same_keys"),
                                  other.cast("int").alias("same_segments"))


@query("implication_violations", f"""WITH {V_PART} SELECT name FROM v_part WHERE alk IS NOT NULL
  AND NOT coalesce(tested = 1, false)""")
def implication_violations(spark, sf):
    return Q.implication_violations(v_part(spark, sf), F.col("alk").isNotNull(),
                                    F.col("tested") == 1).select("name")


@query("column_type_differences", """SELECT * FROM (VALUES
  ('n_name', 'string', NULL), ('n_nationkey', 'bigint', 'int'), ('n_regionkey', NULL, 'int'))
  t("column", expected, found) WHERE (SELECT count(*) FROM nation) > 0""")
def column_type_differences(spark, sf):
    df = table(spark, sf, "nation").drop("n_name")
    return Q.column_type_differences(df, {"n_name": "string", "n_nationkey": "bigint"})


@query("varying_groups", f"""WITH {V_TAXA}, g AS (SELECT Accepted_Species,
    count(DISTINCT target) + max(CAST(target IS NULL AS INTEGER)) AS n1,
    count(DISTINCT Family) + max(CAST(Family IS NULL AS INTEGER)) AS n2,
    count(DISTINCT Genus) + max(CAST(Genus IS NULL AS INTEGER)) AS n3
    FROM v_taxa WHERE Accepted_Species IS NOT NULL GROUP BY 1)
  SELECT Accepted_Species, 'target' AS "column" FROM g WHERE n1 > 1 UNION ALL
  SELECT Accepted_Species, 'Family' FROM g WHERE n2 > 1 UNION ALL
  SELECT Accepted_Species, 'Genus' FROM g WHERE n3 > 1""")
def varying_groups(spark, sf):
    return Q.varying_groups(v_taxa(spark, sf), "Accepted_Species", ["target", "Family", "Genus"])


@query("null_report", f"WITH {V_PART} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null FROM v_part"
    for c in [*BINARY, "price", "y"]))
def null_report(spark, sf):
    return Q.null_report(v_part(spark, sf), [*BINARY, "price", "y"])


@query("non_integral_cells", f"""WITH {V_PART} SELECT name, 'price' AS "column", price AS value
  FROM v_part WHERE price <> round(price) UNION ALL
  SELECT name, 'alk', alk FROM v_part WHERE alk <> round(alk)""")
def non_integral_cells(spark, sf):
    return Q.non_integral_cells(v_part(spark, sf), ["price", "alk"], ["name"])


@query("not_in_own_list", f"""WITH {V_RANGE}, s AS (SELECT part_id,
    'NATION_' || (part_id % 25) AS home FROM v_part)
  SELECT s.part_id FROM s WHERE NOT EXISTS (SELECT 1 FROM v_pairs p WHERE p.part_id = s.part_id
    AND p.region_code = s.home)""")
def not_in_own_list(spark, sf):
    df = v_range(spark, sf).select("part_id", "codes", F.concat(
        F.lit("NATION_"), (F.col("part_id") % 25).cast("string")).alias("home"))
    return Q.not_in_own_list(df, "home", "codes").select("part_id")


@query("bounds_report", """SELECT 'l_discount' AS "column", min(l_discount) + 0.0 AS low,
  max(l_discount) AS high, CAST(min(l_discount) >= 0 AND max(l_discount) <= 1 AS INTEGER) AS ok
  FROM lineitem UNION ALL SELECT 'l_quantity', min(l_quantity) + 0.0, max(l_quantity),
  CAST(min(l_quantity) >= 0 AND max(l_quantity) <= 10 AS INTEGER) FROM lineitem""")
def bounds_report(spark, sf):
    return Q.bounds_report(table(spark, sf, "lineitem"), {
        "l_discount": (0, 1), "l_quantity": (0, 10)}).withColumn("low", F.col("low") + 0.0)


@query("unexpected_cells", f"""WITH {V_PART} SELECT v.name, 'use_m' AS variable, '1.0' AS expected
  FROM v_part v WHERE v.truth = 1 AND v.use_m <> 1""")
def unexpected_cells(spark, sf):
    df = v_part(spark, sf)
    expected = df.filter("truth = 1").select("name", F.lit("use_m").alias("variable"),
                                             F.lit("1.0").alias("expected"))
    return Q.unexpected_cells(df, "name", expected).drop("found")


@query("partition_counts", f"""WITH {V_PART} SELECT count(*) AS n_whole, count(*) AS n_parts, 1 AS ok
  FROM v_part""")
def partition_counts(spark, sf):
    df = v_part(spark, sf)
    return Q.partition_counts(df, df.filter("y is null"), df.filter("y is not null"))


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem
  GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return Q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("empty_rows", f"""WITH {V_PART} SELECT name FROM v_part WHERE alk IS NULL AND herb IS NULL
  AND price IS NULL""")
def empty_rows(spark, sf):
    return Q.empty_rows(v_part(spark, sf), ["alk", "herb", "price"]).select("name")


@query("domain_violations", f"""WITH {V_TAXA} SELECT Accepted_Rank, count(*) AS n FROM v_taxa
  WHERE Accepted_Rank <> 'Species' GROUP BY 1""")
def domain_violations(spark, sf):
    return Q.domain_violations(v_taxa(spark, sf), "Accepted_Rank", ["Species"])


def _suite(spark, sf):
    from counterpoise.operators import constraints as C
    df = v_part(spark, sf)
    source = df.filter("use_g = 1").select("name")
    return df, [C.implies("alkaloid tests", F.col("alk").isNotNull(), F.col("tested") == 1), C.not_null("price known", "price"),
                C.integral("whole price", "price"), C.within("soil range", "soil", 0, 10),
                C.in_domain("known families", "family", ["MFGR#1", "MFGR#2"]), C.not_empty("some value", ["alk", "herb", "price"]),
                C.one_part("labelled or not", [F.col("y").isNull(), F.col("y").isNotNull()]),
                C.Unique("one row per name", ("name",)), C.Unique("one genus and x", ("genus", "x")),
                C.Constant("one family per genus", ("genus",), "family"), C.Constant("one soil per genus", ("genus",), "soil"),
                C.SameSet("medicinal is used", "name", "use_m", source)]


@query("constraint_suite", f"""WITH {V_PART}, one AS (SELECT
    count(*) FILTER (alk IS NOT NULL AND NOT coalesce(tested = 1, false)) AS a, count(*) FILTER (price IS NULL) AS b,
    count(*) FILTER (price <> round(price)) AS c, count(*) FILTER (soil < 0 OR soil > 10) AS d,
    count(*) FILTER (NOT coalesce(family IN ('MFGR#1', 'MFGR#2'), false)) AS e,
    count(*) FILTER (alk IS NULL AND herb IS NULL AND price IS NULL) AS f FROM v_part),
  genus AS (SELECT genus, count(DISTINCT family) + max((family IS NULL)::INTEGER) AS families,
    count(DISTINCT soil) + max((soil IS NULL)::INTEGER) AS soils FROM v_part WHERE genus IS NOT NULL GROUP BY genus)
  SELECT 'alkaloid tests' AS rule, a AS violations FROM one UNION ALL SELECT 'price known', b FROM one
  UNION ALL SELECT 'whole price', c FROM one UNION ALL SELECT 'soil range', d FROM one
  UNION ALL SELECT 'known families', e FROM one UNION ALL SELECT 'some value', f FROM one
  UNION ALL SELECT 'labelled or not', 0
  UNION ALL SELECT 'one row per name', count(*) FROM (SELECT 1 FROM v_part GROUP BY name HAVING count(*) > 1)
  UNION ALL SELECT 'one genus and x', count(*) FROM (SELECT 1 FROM v_part GROUP BY genus, x HAVING count(*) > 1)
  UNION ALL SELECT 'one family per genus', count(*) FILTER (families > 1) FROM genus
  UNION ALL SELECT 'one soil per genus', count(*) FILTER (soils > 1) FROM genus
  UNION ALL SELECT 'medicinal is used', count(*) FROM (SELECT name FROM v_part WHERE name IS NOT NULL GROUP BY name
    HAVING bool_or(coalesce(use_m = 1, false)) <> bool_or(coalesce(use_g = 1, false)))""")
def constraint_suite(spark, sf):
    """Twelve checks from one scan and one shuffle."""
    from counterpoise.operators import constraints as C
    return C.check_all(*_suite(spark, sf))


@query("constraint_suite_rows", f"""WITH {V_PART} SELECT name, array_to_string(list_filter([
    CASE WHEN alk IS NOT NULL AND NOT coalesce(tested = 1, false) THEN 'alkaloid tests' END,
    CASE WHEN price IS NULL THEN 'price known' END, CASE WHEN price <> round(price) THEN 'whole price' END,
    CASE WHEN soil < 0 OR soil > 10 THEN 'soil range' END,
    CASE WHEN NOT coalesce(family IN ('MFGR#1', 'MFGR#2'), false) THEN 'known families' END,
    CASE WHEN alk IS NULL AND herb IS NULL AND price IS NULL THEN 'some value' END], lambda r: r IS NOT NULL), ',') AS broken FROM v_part WHERE broken <> ''""")
def constraint_suite_rows(spark, sf):
    from counterpoise.operators import constraints as C
    return C.broken_rows(*_suite(spark, sf)).select("name", F.array_join("broken", ",").alias("broken"))
