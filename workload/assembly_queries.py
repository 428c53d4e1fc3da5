"""Sources, projections, filters, null handling, enrichment and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.functions import scalars as S
from counterpoise.operators import cleaning as C, enrich as E, hierarchy as H
from counterpoise.operators.regions import multilabel_onehot
from workload.registry import query
from workload.views import (PART_CATALOGUE, TAXA_CATALOGUE, V_HABIT, V_PART, V_SETS, V_TAXA,
                            V_VALUES, table, v_habit, v_part, v_set, v_taxa, v_values)

FLAG_COLUMNS = ["Accepted_Name", "Accepted_ID"]


def _flags(sql_value: str, name: str) -> str:
    return f"""WITH {V_SETS} SELECT Accepted_Name, Accepted_ID, {sql_value} AS {name} FROM v_taxa"""


_IN = {(lev, s): f"{col} IN (SELECT {src} FROM {s} WHERE {src} IS NOT NULL)"
       for s in ("v_hit", "v_abs")
       for lev, col, src in (("name", "Accepted_Name", "Accepted_Name"),
                             ("sp_name", "Accepted_Species", "Accepted_Name"),
                             ("sp", "Accepted_Species", "Accepted_Species"),
                             ("genus", "Genus", "Genus"))}


def _any(s: str, *levels: str) -> str:
    return "(" + " OR ".join(f"coalesce({_IN[lev, s]}, false)" for lev in levels) + ")"


@query("flag_hits_precise", _flags(
    f"CASE WHEN {_any('v_hit', 'name')} THEN 1.0::DOUBLE END", "seen"))
def flag_hits_precise(spark, sf):
    out = E.flag_hits(v_taxa(spark, sf), "seen", v_set(spark, sf, "R"), "precise",
                      cat=TAXA_CATALOGUE)
    return out.select(*FLAG_COLUMNS, "seen")


@query("flag_hits_species", _flags(
    f"CASE WHEN {_any('v_hit', 'name', 'sp_name', 'sp')} THEN 1.0::DOUBLE END", "seen"))
def flag_hits_species(spark, sf):
    out = E.flag_hits(v_taxa(spark, sf), "seen", v_set(spark, sf, "R"), "species",
                      cat=TAXA_CATALOGUE)
    return out.select(*FLAG_COLUMNS, "seen")


@query("update_hits_genus", _flags(
    f"""CASE WHEN Accepted_ID % 50 = 0 THEN 5.0::DOUBLE
        WHEN {_any('v_hit', 'name', 'sp_name', 'sp', 'genus')} THEN 1.0::DOUBLE END""", "Spines"))
def update_hits_genus(spark, sf):
    taxa = v_taxa(spark, sf).withColumn("Spines", F.when(F.col("Accepted_ID") % 50 == 0, 5.0))
    return E.update_hits(taxa, "Spines", v_set(spark, sf, "R"), cat=TAXA_CATALOGUE).select(
        *FLAG_COLUMNS, "Spines")


def _precedence(first: str, v1: str, second: str, v2: str, *levels: tuple[str, ...]) -> str:
    steps = "".join(f" WHEN {_any(first, *lev)} THEN {v1}::DOUBLE WHEN {_any(second, *lev)} "
                    f"THEN {v2}::DOUBLE" for lev in levels)
    return f"CASE{steps} END"


_LEVELS = (("name",), ("sp_name", "sp"), ("genus",))


@query("flag_hits_absences_hits_first",
       _flags(_precedence("v_hit", "1.0", "v_abs", "0.0", *_LEVELS), "Spines"))
def flag_hits_absences_hits_first(spark, sf):
    return E.flag_hits_absences(v_taxa(spark, sf), "Spines", v_set(spark, sf, "R"),
                                v_set(spark, sf, "A"), "genera", 1, TAXA_CATALOGUE).select(
        *FLAG_COLUMNS, "Spines")


@query("flag_hits_absences_absences_first",
       _flags(_precedence("v_abs", "0.0", "v_hit", "1.0", *_LEVELS), "Spines"))
def flag_hits_absences_absences_first(spark, sf):
    return E.flag_hits_absences(v_taxa(spark, sf), "Spines", v_set(spark, sf, "R"),
                                v_set(spark, sf, "A"), "genera", 0, TAXA_CATALOGUE).select(
        *FLAG_COLUMNS, "Spines")


_VALUES = f"{V_TAXA}, {V_VALUES}"


def _value_sql(variables: list[str], level: str) -> str:
    joins, columns = "", []
    for v in variables:
        parts = [f"n_{v}.{v}"]
        joins += f" LEFT JOIN v_values n_{v} ON t.Accepted_Name = n_{v}.Accepted_Name"
        if level != "precise":
            joins += (f" LEFT JOIN (SELECT Accepted_Species, arg_min({v}, row_no) AS {v} FROM v_values"
                      f" WHERE {v} IS NOT NULL GROUP BY 1) s_{v}"
                      f" ON t.Accepted_Species = s_{v}.Accepted_Species")
            parts.append(f"s_{v}.{v}")
        if level == "genera":
            joins += (f" LEFT JOIN (SELECT Genus, arg_min({v}, row_no) AS {v} FROM v_values"
                      f" WHERE {v} IS NOT NULL GROUP BY 1) g_{v} ON t.Genus = g_{v}.Genus")
            parts.append(f"g_{v}.{v}")
        columns.append(f"coalesce({', '.join(parts)}) AS {v}")
    return (f"WITH {_VALUES} SELECT t.Accepted_Name, t.Accepted_ID, {', '.join(columns)} "
            f"FROM v_taxa t {joins}")


@query("lookup_value_precise", _value_sql(["vq"], "precise"))
def lookup_value_precise(spark, sf):
    return E.lookup_values(v_taxa(spark, sf), ["vq"], v_values(spark, sf), "precise",
                           order="row_no", cat=TAXA_CATALOGUE).select(*FLAG_COLUMNS, "vq")


@query("lookup_value_species", _value_sql(["vd"], "species"))
def lookup_value_species(spark, sf):
    return E.lookup_values(v_taxa(spark, sf), ["vd"], v_values(spark, sf), "species",
                           order="row_no", cat=TAXA_CATALOGUE).select(*FLAG_COLUMNS, "vd")


@query("lookup_value_genus", _value_sql(["vd"], "genera"))
def lookup_value_genus(spark, sf):
    return E.lookup_values(v_taxa(spark, sf), ["vd"], v_values(spark, sf), "genera",
                           order="row_no", cat=TAXA_CATALOGUE).select(*FLAG_COLUMNS, "vd")


@query("lookup_values_many", _value_sql(["vq", "vd"], "genera"))
def lookup_values_many(spark, sf):
    return E.lookup_values(v_taxa(spark, sf), ["vq", "vd"], v_values(spark, sf), "genera",
                           order="row_no", cat=TAXA_CATALOGUE).select(*FLAG_COLUMNS, "vq", "vd")


def _mixed_sql() -> str:
    """A genus-level variable and a species-level one from one dataset, without a level of the rule."""
    return f"""WITH {_VALUES}, sp AS (SELECT Accepted_Species, arg_min(vq, row_no) FILTER (vq IS NOT NULL) AS vq,
        arg_min(vd, row_no) FILTER (vd IS NOT NULL) AS vd FROM v_values GROUP BY 1),
      ge AS (SELECT Genus, arg_min(vd, row_no) AS vd FROM v_values WHERE vd IS NOT NULL GROUP BY 1)
      SELECT t.Accepted_Name, t.Accepted_ID, coalesce(n.vq, sp.vq) AS vq,
        coalesce(n.vd, sp.vd, ge.vd) AS Spines
      FROM v_taxa t LEFT JOIN v_values n ON t.Accepted_Name = n.Accepted_Name
      LEFT JOIN sp ON t.Accepted_Species = sp.Accepted_Species LEFT JOIN ge ON t.Genus = ge.Genus"""


@query("lookup_values_mixed_levels", _mixed_sql())
def lookup_values_mixed_levels(spark, sf):
    data = v_values(spark, sf).withColumnRenamed("vd", "Spines")
    return E.lookup_values(v_taxa(spark, sf), ["vq", "Spines"], data, order="row_no",
                           cat=TAXA_CATALOGUE).select(*FLAG_COLUMNS, "vq", "Spines")


@query("lookup_values_keeps_present", f"""WITH {_VALUES} SELECT t.Accepted_Name, t.Accepted_ID,
    coalesce(CASE WHEN t.Accepted_ID % 5 = 0 THEN t.totalprice END, n.vd, n.vq) AS v
  FROM v_taxa t LEFT JOIN v_values n ON t.Accepted_Name = n.Accepted_Name""")
def lookup_values_keeps_present(spark, sf):
    taxa = v_taxa(spark, sf).withColumn("v", F.when(F.col("Accepted_ID") % 5 == 0, F.col("totalprice")))
    rules = [E.ValueRule(["v"], v_values(spark, sf).drop(*{"vq", "vd"} - {v}).withColumnRenamed(v, "v"),
                         "precise", order="row_no") for v in ("vd", "vq")]
    return E.enrich(taxa, rules, TAXA_CATALOGUE).select(*FLAG_COLUMNS, "v")


_DUPLICATED = """v_dup AS (
  SELECT 'T' || o_orderkey AS Accepted_Name, 'T' || (o_orderkey + k) AS original,
    o_totalprice + k AS v FROM orders, (SELECT unnest([0, 1]) AS k)
  WHERE k = 0 OR o_orderkey % 3 = 0)"""


def _duplicated(spark, sf):
    orders = table(spark, sf, "orders")
    twice = orders.withColumn("k", F.explode(F.when(F.col("o_orderkey") % 3 == 0,
                                                    F.array(F.lit(0), F.lit(1)))
                                             .otherwise(F.array(F.lit(0)))))
    return twice.select(
        F.concat(F.lit("T"), F.col("o_orderkey").cast("string")).alias("Accepted_Name"),
        F.concat(F.lit("T"), (F.col("o_orderkey") + F.col("k")).cast("string")).alias("original"),
        (F.col("o_totalprice") + F.col("k")).alias("v"))


@query("resolve_duplicate_keys", f"""WITH {_DUPLICATED}
  SELECT Accepted_Name, original, v FROM v_dup d WHERE Accepted_Name = original OR
    (SELECT count(*) FROM v_dup e WHERE e.Accepted_Name = d.Accepted_Name) = 1""")
def resolve_duplicate_keys(spark, sf):
    return E.resolve_duplicate_keys(_duplicated(spark, sf), TAXA_CATALOGUE, "original")


_CHECKLIST = """checklist AS (
  SELECT r_name AS family, n_name AS genus, 'sp' || c_custkey AS species, c_custkey AS kew_id,
    n_name || ' sp' || c_custkey AS taxon_name,
    CASE WHEN c_custkey % 4 = 0 THEN 'Variety' ELSE 'Species' END AS rank,
    CASE WHEN c_custkey % 4 = 0 THEN n_name || ' sp' || c_custkey END AS parent_name,
    c_custkey + 1000000 AS parent_kew_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
given AS (
  SELECT DISTINCT 'U' || user_id AS Accepted_Name, user_id AS Accepted_ID, 'given' AS Family,
    event_type AS Genus, 'Species' AS Accepted_Rank, 'U' || user_id AS Accepted_Species,
    user_id AS Accepted_Species_ID, 'U' || user_id AS Name, value AS extra
  FROM events)"""


def _checklist(spark, sf):
    key = F.col("c_custkey")
    sub = key % 4 == 0
    own = F.concat("n_name", F.lit(" sp"), key.cast("string"))
    return (table(spark, sf, "customer")
            .join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("family"), F.col("n_name").alias("genus"),
                    F.concat(F.lit("sp"), key.cast("string")).alias("species"),
                    key.alias("kew_id"), own.alias("taxon_name"),
                    F.when(sub, "Variety").otherwise("Species").alias("rank"),
                    F.when(sub, own).alias("parent_name"),
                    (key + 1000000).alias("parent_kew_id")))


def _given(spark, sf):
    name = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return table(spark, sf, "events").select(
        name.alias("Accepted_Name"), F.col("user_id").alias("Accepted_ID"),
        F.lit("given").alias("Family"), F.col("event_type").alias("Genus"),
        F.lit("Species").alias("Accepted_Rank"), name.alias("Accepted_Species"),
        F.col("user_id").alias("Accepted_Species_ID"), name.alias("Name"),
        F.col("value").alias("extra")).distinct()


@query("append_missing_taxa", f"""WITH {_CHECKLIST} SELECT * FROM given UNION ALL
  SELECT taxon_name, kew_id, family, genus, rank, genus || ' ' || species,
    CASE WHEN parent_name = genus || ' ' || species THEN parent_kew_id
         WHEN rank = 'Species' THEN kew_id END, taxon_name, NULL
  FROM checklist WHERE NOT EXISTS (SELECT 1 FROM given g
    WHERE g.Accepted_ID IS NOT DISTINCT FROM kew_id)""")
def append_missing_taxa(spark, sf):
    return E.append_missing_taxa(_given(spark, sf), _checklist(spark, sf))


@query("missing_taxa_null_key", f"""WITH {_CHECKLIST},
  holes AS (SELECT CASE WHEN kew_id % 20 = 0 THEN NULL ELSE kew_id END AS kew_id, genus
            FROM checklist)
  SELECT h.kew_id, h.genus FROM holes h WHERE NOT EXISTS (
    SELECT 1 FROM (SELECT Accepted_ID FROM given UNION SELECT NULL) g
    WHERE g.Accepted_ID IS NOT DISTINCT FROM h.kew_id)""")
def missing_taxa_null_key(spark, sf):
    holes = _checklist(spark, sf).select(
        F.when(F.col("kew_id") % 20 != 0, F.col("kew_id")).alias("kew_id"), "genus")
    given = _given(spark, sf).select("Accepted_ID")
    with_null = given.unionByName(given.agg(
        F.max(F.lit(None).cast("bigint")).alias("Accepted_ID")))
    return E.missing_taxa(with_null, holes)


@query("derive_names", f"""WITH {_CHECKLIST} SELECT taxon_name AS Accepted_Name, taxon_name AS Name,
  genus || ' ' || CASE WHEN kew_id % 6 <> 0 THEN species END AS Accepted_Species FROM checklist""")
def derive_names(spark, sf):
    df = _checklist(spark, sf).withColumn("species",
                                          F.when(F.col("kew_id") % 6 != 0, F.col("species")))
    renamed = C.rename_columns(df, {"genus": "Genus", "species": "Species",
                                    "taxon_name": "Accepted_Name"})
    return C.derive_names(renamed).select("Accepted_Name", "Name", "Accepted_Species")


@query("derive_species_id", f"""WITH {_CHECKLIST} SELECT kew_id AS Accepted_ID,
  CASE WHEN parent_name = genus || ' ' || species THEN parent_kew_id
       WHEN rank = 'Species' THEN kew_id END AS Accepted_Species_ID FROM checklist""")
def derive_species_id(spark, sf):
    df = C.rename_columns(_checklist(spark, sf), {
        "genus": "Genus", "species": "Species", "taxon_name": "Accepted_Name",
        "kew_id": "Accepted_ID", "rank": "Accepted_Rank"})
    return C.derive_species_id(C.derive_names(df)).select("Accepted_ID", "Accepted_Species_ID")


@query("align_schema", """SELECT s_suppkey::BIGINT AS c_custkey, NULL::VARCHAR AS c_mktsegment,
  s_acctbal AS c_acctbal FROM supplier""")
def align_schema(spark, sf):
    like = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    have = C.rename_columns(table(spark, sf, "supplier"),
                            {"s_suppkey": "c_custkey", "s_acctbal": "c_acctbal"})
    return C.align_schema(have, like)


@query("reset_dtypes", """SELECT p_partkey AS part_id,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size::DOUBLE END AS use_g,
  p_retailprice AS price, p_brand AS genus FROM part""")
def reset_dtypes(spark, sf):
    size = F.col("p_size")
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.when(size % 20 == 0, F.lit("none")).when(size % 10 == 0, F.lit("NaN"))
        .otherwise(size.cast("string")).alias("use_g"),
        F.col("p_retailprice").cast("string").alias("price"), F.col("p_brand").alias("genus"))
    import warnings
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return C.reset_dtypes(raw, PART_CATALOGUE)


@query("standard_layout", f"""WITH {V_PART} SELECT name, family, genus, part_id, x, truth, use_m,
  use_g, alk, herb, price, soil, y FROM v_part""")
def standard_layout(spark, sf):
    return C.standard_layout(v_part(spark, sf), PART_CATALOGUE)


@query("drop_columns", f"WITH {V_PART} SELECT name, y, x FROM v_part")
def drop_columns(spark, sf):
    return C.drop_columns(v_part(spark, sf).select("name", "y", "x", "genus", "price"),
                          ["genus", "price"])


@query("rename_columns", "SELECT n_nationkey AS id, n_name AS region_name FROM nation")
def rename_columns(spark, sf):
    return C.rename_columns(table(spark, sf, "nation").select("n_nationkey", "n_name"),
                            {"n_nationkey": "id", "n_name": "region_name"})


@query("select_features_drop_columns", f"WITH {V_PART} SELECT name, use_m, use_g, truth FROM v_part")
def select_features_drop_columns(spark, sf):
    return C.select_features(v_part(spark, sf), ["use_m", "alk", "use_g", "price", "absent"],
                             "truth", keep=["name"], drop_null_columns=True)


@query("select_features_drop_rows", f"""WITH {V_PART} SELECT name, use_m, alk, price, y FROM v_part
  WHERE use_m IS NOT NULL AND alk IS NOT NULL AND price IS NOT NULL""")
def select_features_drop_rows(spark, sf):
    return C.select_features(v_part(spark, sf), ["use_m", "alk", "price"], "y", keep=["name"],
                             drop_null_rows=True)


@query("require_key", f"""WITH {V_TAXA} SELECT Accepted_ID, Accepted_Species AS Accepted_Name
  FROM v_taxa WHERE Accepted_Species IS NOT NULL""")
def require_key(spark, sf):
    return C.require_key(v_taxa(spark, sf).select(
        "Accepted_ID", F.col("Accepted_Species").alias("Accepted_Name")), TAXA_CATALOGUE)


_SPARSE = f"""{V_PART}, sparse AS (SELECT name, family, genus, alk, herb, price, soil, y FROM v_part)"""


def _sparse(spark, sf):
    return v_part(spark, sf).select("name", "family", "genus", "alk", "herb", "price", "soil", "y")


@query("drop_empty_samples", f"""WITH {_SPARSE} SELECT name, y FROM sparse
  WHERE coalesce(alk, herb, price, soil, y) IS NOT NULL""")
def drop_empty_samples(spark, sf):
    return C.drop_empty_samples(_sparse(spark, sf), PART_CATALOGUE).select("name", "y")


@query("count_empty_samples", f"""WITH {_SPARSE} SELECT
  count(*) FILTER (coalesce(alk, herb, price, soil, y) IS NULL) AS n_removed,
  count(*) AS n_rows FROM sparse""")
def count_empty_samples(spark, sf):
    return C.count_empty_samples(_sparse(spark, sf), PART_CATALOGUE)


@query("split_labelled", f"""WITH {V_PART} SELECT name, 1 AS part FROM v_part WHERE y IS NOT NULL
  UNION ALL SELECT name, 0 FROM v_part WHERE y IS NULL""")
def split_labelled(spark, sf):
    labelled, unlabelled = C.split_labelled(v_part(spark, sf).select("name", "y"), "y")
    return C.stack_samples(labelled, unlabelled, "part").select("name", "part")


@query("family_filter", f"WITH {V_PART} SELECT name, y FROM v_part WHERE family = 'ECONOMY'")
def family_filter(spark, sf):
    return C.family_filter(v_part(spark, sf), "ECONOMY", PART_CATALOGUE).select("name", "y")


@query("rank_filter", f"WITH {V_TAXA} SELECT Accepted_Name FROM v_taxa "
                      "WHERE Accepted_Rank = 'Species'")
def rank_filter(spark, sf):
    return C.rank_filter(v_taxa(spark, sf), TAXA_CATALOGUE).select("Accepted_Name")


@query("label_value_filter", f"WITH {V_PART} SELECT name, price FROM v_part WHERE y = 1")
def label_value_filter(spark, sf):
    return C.label_value_filter(v_part(spark, sf), "y", 1.0).select("name", "price")


@query("zero_fill", f"""WITH {V_PART} SELECT name, coalesce(alk, 0) AS tested, alk, price
  FROM v_part""")
def zero_fill(spark, sf):
    df = v_part(spark, sf).select("name", F.col("alk").alias("tested"), "alk", "price")
    return C.zero_fill(df, PART_CATALOGUE)


@query("conditional_zero", f"""WITH {V_PART} SELECT name, CASE WHEN alk IS NULL AND
  family = 'PROMO' THEN 0.0::DOUBLE ELSE alk END AS alk FROM v_part""")
def conditional_zero(spark, sf):
    return C.conditional_zero(v_part(spark, sf), "alk", "PROMO", PART_CATALOGUE).select("name", "alk")


@query("report_and_fill_nulls", f"""WITH {V_PART} SELECT name, coalesce(alk, 0) AS alk,
  coalesce(soil, 0) AS soil, use_m FROM v_part""")
def report_and_fill_nulls(spark, sf):
    df = v_part(spark, sf).select("name", "alk", "soil", "use_m")
    filled, bad = C.report_and_fill_nulls(df, ["alk", "soil", "use_m"])
    assert "use_m" not in bad
    return filled


@query("require_no_nulls", f"""WITH {V_PART} SELECT name, use_m, use_g FROM v_part""")
def require_no_nulls(spark, sf):
    df = v_part(spark, sf).select("name", "use_m", "use_g")
    C.require_no_nulls(df, ["use_m", "use_g"])
    return df


@query("semi_supervised_union", f"""WITH {V_PART} SELECT use_m, use_g, coalesce(y, -1) AS y
  FROM v_part""")
def semi_supervised_union(spark, sf):
    labelled, unlabelled = C.split_labelled(v_part(spark, sf), "y")
    return C.semi_supervised_union(labelled, unlabelled, ["use_m", "use_g"], "y")


@query("mark_selected", f"""WITH {V_PART} SELECT name, CAST(y IS NOT NULL AS INTEGER) AS selected
  FROM v_part""")
def mark_selected(spark, sf):
    return C.mark_selected(v_part(spark, sf), "y").select("name", "selected")


@query("resolve_to_species", f"""WITH {V_TAXA} SELECT t.Accepted_Name, CASE WHEN
  t.Accepted_Species IS NULL THEN t.target ELSE m.best END AS target
  FROM v_taxa t LEFT JOIN (SELECT Accepted_Species, max(target) AS best FROM v_taxa GROUP BY 1) m
  ON t.Accepted_Species = m.Accepted_Species WHERE t.Accepted_Rank = 'Species'""")
def resolve_to_species(spark, sf):
    return H.resolve_to_species(v_taxa(spark, sf), TAXA_CATALOGUE).select("Accepted_Name", "target")


_GENUS_VARS = """v_gv AS (SELECT Accepted_Name, Genus,
    CASE WHEN Accepted_ID % 401 = 0 THEN 1.0::DOUBLE WHEN Accepted_ID % 211 = 0 THEN 0.0::DOUBLE
         WHEN Accepted_ID % 103 = 0 THEN 2.0::DOUBLE END AS Spines,
    CASE WHEN Accepted_ID % 307 = 0 THEN 0.0::DOUBLE END AS Hairs FROM v_taxa),
  v_ge AS (SELECT Genus, max(Spines = 1) AS s1, max(Spines = 0) AS s0, max(Hairs = 1) AS h1,
    max(Hairs = 0) AS h0 FROM v_gv WHERE Genus IS NOT NULL GROUP BY 1),
  v_gf AS (SELECT v.Accepted_Name, v.Spines AS old_spines, v.Hairs AS old_hairs,
    coalesce(v.Spines, CASE WHEN s1 THEN 1.0::DOUBLE WHEN s0 THEN 0.0::DOUBLE END) AS Spines,
    coalesce(v.Hairs, CASE WHEN h1 THEN 1.0::DOUBLE WHEN h0 THEN 0.0::DOUBLE END) AS Hairs
    FROM v_gv v LEFT JOIN v_ge e ON v.Genus = e.Genus)"""


def _genus_vars(spark, sf):
    key = F.col("Accepted_ID")
    return v_taxa(spark, sf).select(
        "Accepted_Name", "Genus",
        F.when(key % 401 == 0, 1.0).when(key % 211 == 0, 0.0).when(key % 103 == 0, 2.0)
        .alias("Spines"), F.when(key % 307 == 0, 0.0).alias("Hairs"))


@query("fill_from_genus", f"WITH {V_TAXA}, {_GENUS_VARS} SELECT Accepted_Name, Spines, Hairs FROM v_gf")
def fill_from_genus(spark, sf):
    return H.fill_from_genus(_genus_vars(spark, sf), TAXA_CATALOGUE).select(
        "Accepted_Name", "Spines", "Hairs")


@query("change_report", f"""WITH {V_TAXA}, {_GENUS_VARS}
  SELECT Accepted_Name, 'Spines' AS variable, old_spines AS before, Spines AS after FROM v_gf
  WHERE old_spines IS DISTINCT FROM Spines UNION ALL
  SELECT Accepted_Name, 'Hairs', old_hairs, Hairs FROM v_gf WHERE old_hairs IS DISTINCT FROM Hairs""")
def change_report(spark, sf):
    filled = H.fill_from_genus(_genus_vars(spark, sf), TAXA_CATALOGUE, keep_before=True)
    return H.change_report(filled, ["Spines", "Hairs"], ["Accepted_Name"])


@query("keep_first_per_key", f"""WITH {V_TAXA} SELECT Accepted_Species, Accepted_Name, Genus FROM
  (SELECT *, row_number() OVER (PARTITION BY Accepted_Species ORDER BY Accepted_ID) AS rn FROM v_taxa)
  WHERE rn = 1""")
def keep_first_per_key(spark, sf):
    df = v_taxa(spark, sf).select("Accepted_Species", "Accepted_Name", "Genus", "Accepted_ID")
    return H.keep_first_per_key(df, ["Accepted_Species"], ["Accepted_ID"]).drop("Accepted_ID")


_FEATURES = ["family", "x", "alk", "herb", "use_m"]
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in [*_FEATURES, "soil"])


@query("duplicated_rows", f"""WITH {V_PART} SELECT name FROM v_part a WHERE (SELECT count(*) FROM
  v_part b WHERE {_SAME}) > 1""")
def duplicated_rows(spark, sf):
    return H.duplicated_rows(v_part(spark, sf), [*_FEATURES, "soil"]).select("name")


@query("later_duplicates", f"""WITH {V_PART} SELECT name FROM v_part a WHERE EXISTS (SELECT 1 FROM
  v_part b WHERE {_SAME} AND b.part_id < a.part_id)""")
def later_duplicates(spark, sf):
    return H.later_duplicates(v_part(spark, sf), [*_FEATURES, "soil"], "part_id").select("name")


@query("attach_group_size", f"""WITH {V_PART} SELECT name, count(*) OVER (PARTITION BY
  {', '.join(_FEATURES)}) AS size FROM v_part""")
def attach_group_size(spark, sf):
    return H.attach_group_size(v_part(spark, sf), _FEATURES).select("name", "size")


@query("combination_frequency", f"""WITH {V_PART} SELECT name, round(count(*) OVER (PARTITION BY
  {', '.join(_FEATURES)}) / (SELECT count(*) FROM v_part)::DOUBLE, 9) AS p_x FROM v_part""")
def combination_frequency(spark, sf):
    return H.combination_frequency(v_part(spark, sf), _FEATURES, "p_x").select(
        "name", F.round("p_x", 9).alias("p_x"))


@query("rowwise_max", f"""WITH {V_PART} SELECT name, greatest(alk, herb) AS m1,
  greatest(use_m, alk, herb) AS m2 FROM v_part""")
def rowwise_max(spark, sf):
    nan = F.when(F.col("alk").isNull(), F.lit(float("nan"))).otherwise(F.col("alk"))
    return v_part(spark, sf).select("name", S.row_max(nan, "herb").alias("m1"),
                                    S.row_max("use_m", nan, "herb").alias("m2"))


@query("known_indicator", f"""WITH {V_PART} SELECT name,
  greatest(tested, CAST(alk IS NOT NULL AS INTEGER)::DOUBLE) AS tested FROM v_part""")
def known_indicator(spark, sf):
    return v_part(spark, sf).select(
        "name", S.row_max(S.known_indicator("alk"), "tested").alias("tested"))


_WORDS = ["small", "red", "large"]


@query("multilabel_onehot", f"WITH {V_HABIT} SELECT part_id, " + ", ".join(
    f"CASE WHEN habit <> '?' THEN CAST(list_contains(string_split(habit, '/'), '{w}') AS INTEGER)"
    f"::DOUBLE END AS {w}" for w in _WORDS)
    + ", CASE WHEN habit <> '?' THEN CAST(list_contains(string_split(habit, '/'), 'ring') AS INTEGER)"
      "::DOUBLE ELSE 0.0::DOUBLE END AS ring FROM v_habit")
def multilabel_onehot_query(spark, sf):
    return multilabel_onehot(v_habit(spark, sf), "habit", _WORDS).select("part_id", *_WORDS, "ring")


@query("parse_list_literal", """SELECT p_partkey AS part_id,
  list_contains(string_split(p_name, ' '), 'ring')::INTEGER AS has_ring,
  len(string_split(p_name, ' '))::INTEGER AS n FROM part""")
def parse_list_literal(spark, sf):
    text = F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']"))
    parsed = S.parse_list(text)
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.array_contains(parsed, "ring").cast("int").alias("has_ring"), F.size(parsed).alias("n"))


@query("genus_of_name", "SELECT p_partkey AS part_id, string_split(p_name, ' ')[1] AS genus FROM part")
def genus_of_name(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"),
                                           S.genus_of_name("p_name").alias("genus"))


_ANSWER = """CASE WHEN p_size % 4 = 0 THEN ' Yes' WHEN p_size % 4 = 1 THEN 'NO ' WHEN p_size % 4 = 2
  THEN 'Not Detected' END"""


@query("yes_no_to_flag", f"""SELECT p_partkey AS part_id, {_ANSWER} AS answer,
  CASE WHEN lower(trim({_ANSWER})) = 'yes' THEN 1.0::DOUBLE WHEN lower(trim({_ANSWER})) = 'no'
  THEN 0.0::DOUBLE END AS flag FROM part""")
def yes_no_to_flag(spark, sf):
    k = F.col("p_size") % 4
    answer = F.when(k == 0, " Yes").when(k == 1, "NO ").when(k == 2, "Not Detected")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"),
                                           answer.alias("answer"), S.yes_no_flag(answer).alias("flag"))


@query("tidy_names", """SELECT n_nationkey AS "n nationkey", replace(n_name, '_', ' ') AS "n name"
  FROM nation""")
def tidy_names(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", S.tidy_text("n_name").alias("n_name"))
    return S.tidy_names(df)


_UNITS = "((p_size % 7) / 40.0::DOUBLE * 1152921504606846976::DOUBLE)::HUGEINT"


@query("round_half_even", f"""WITH u AS (SELECT p_partkey AS part_id, {_UNITS} AS m FROM part),
  v AS (SELECT part_id, (m * 100) // 1152921504606846976::HUGEINT AS low,
    (m * 100) % 1152921504606846976::HUGEINT AS rest FROM u)
  SELECT part_id, (low + CASE WHEN rest * 2 > 1152921504606846976::HUGEINT OR
    (rest * 2 = 1152921504606846976::HUGEINT AND low % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE
    AS value FROM v""")
def round_half_even(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"),
        S.round_half_even_2((F.col("p_size") % 7) / F.lit(40.0)).alias("value"))


@query("equality_flag", f"""WITH {V_PART} SELECT name, CASE WHEN herb = alk THEN 1 ELSE 0 END AS same
  FROM v_part""")
def equality_flag(spark, sf):
    return v_part(spark, sf).select("name", S.equality_flag("herb", "alk").alias("same"))


@query("text_keeps_null", f"""WITH {V_TAXA} SELECT Accepted_Name, Genus AS genus_text
  FROM v_taxa""")
def text_keeps_null(spark, sf):
    return v_taxa(spark, sf).select("Accepted_Name", F.col("Genus").cast("string").alias("genus_text"))
