"""Stand-ins for trait data, built from the given tables; each as a DataFrame and as a SQL CTE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from counterpoise.catalogue import Catalogue


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once, as each look takes a job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _num(cond: Column) -> Column:
    return cond.cast("double")


# One row per part.  Selection depends on the size band x and on p_partkey % 3 only, which tells
# nothing about the truth given x; the target is known for selected rows only.
V_PART = """v_part AS (
  SELECT 'P' || p_partkey AS name, p_partkey AS part_id, p_type AS family, p_brand AS genus,
    CAST(floor((p_size - 1) / 10.0) AS INTEGER) AS x,
    CASE WHEN p_size + p_partkey % 20 >= 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS truth,
    CASE WHEN p_size > 30 OR p_partkey % 3 = 0 THEN
      CASE WHEN p_size + p_partkey % 20 >= 35 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS y,
    CAST(p_size >= 40 AS INTEGER)::DOUBLE AS use_m,
    CAST(p_size >= 25 AS INTEGER)::DOUBLE AS use_g,
    CAST(p_partkey % 4 = 0 AS INTEGER)::DOUBLE AS tested,
    CASE WHEN p_partkey % 7 < 3 THEN (p_size % 2)::DOUBLE END AS alk,
    CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_partkey % 3 = 1 AS INTEGER)::DOUBLE END AS herb,
    CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS price,
    CASE WHEN p_partkey % 5 <> 0 THEN p_size + p_partkey % 13 + 0.5::DOUBLE END AS soil
  FROM part)"""


def v_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size, key = table(spark, sf_dir, "part"), F.col("p_size"), F.col("p_partkey")
    truth = _num(size + key % 20 >= 35)
    return p.select(
        F.concat(F.lit("P"), key.cast("string")).alias("name"), key.alias("part_id"),
        F.col("p_type").alias("family"), F.col("p_brand").alias("genus"),
        F.floor((size - 1) / 10.0).cast("int").alias("x"), truth.alias("truth"),
        F.when((size > 30) | (key % 3 == 0), truth).alias("y"),
        _num(size >= 40).alias("use_m"), _num(size >= 25).alias("use_g"),
        _num(key % 4 == 0).alias("tested"),
        F.when(key % 7 < 3, (size % 2).cast("double")).alias("alk"),
        F.when(key % 9 != 0, _num(key % 3 == 1)).alias("herb"),
        F.when(key % 11 != 0, F.col("p_retailprice")).alias("price"),
        F.when(key % 5 != 0, (size + key % 13 + 0.5).cast("double")).alias("soil"))


PART_CATALOGUE = Catalogue(
    names=["name", "family", "genus"], name="name", species="name", genus="genus", family="family",
    target="y", flags=["use_m", "use_g", "tested"], habits=["herb"], compounds=["alk"],
    genus_level=["herb"], continuous=["price", "soil"], text=["genus", "family"],
    encoded=["genus", "family"], discarded=["part_id"], dropped_after_use=["tested"],
    not_predictors=["tested"])

# Weights of v_part in closed form: rows of a (family, x) cell over labelled rows of the cell.
V_WEIGHTED = V_PART + """, v_cell AS (
  SELECT family, x, count(y)::DOUBLE / count(*) AS ps FROM v_part GROUP BY family, x),
v_weighted AS (
  SELECT p.*, c.ps, CASE WHEN c.ps > 0 THEN 1 / c.ps END AS weight
  FROM v_part p JOIN v_cell c ON p.family = c.family AND p.x = c.x)"""


# One row per order: a taxon; its customer is the species, (nation, segment) the genus.
V_TAXA = """v_taxa AS (
  SELECT 'T' || o_orderkey AS Accepted_Name, o_orderkey AS Accepted_ID, r_name AS Family,
    CASE WHEN o_orderkey % 89 <> 0 THEN n_name || '_' || c_mktsegment END AS Genus,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Subspecies' ELSE 'Species' END AS Accepted_Rank,
    CASE WHEN o_orderkey % 97 <> 0 THEN 'S' || o_custkey END AS Accepted_Species,
    o_custkey AS Accepted_Species_ID,
    CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS target,
    o_totalprice AS totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def v_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in
                                        ("orders", "customer", "nation", "region"))
    key = F.col("o_orderkey")
    return (orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
        F.concat(F.lit("T"), key.cast("string")).alias("Accepted_Name"),
        key.alias("Accepted_ID"), F.col("r_name").alias("Family"),
        F.when(key % 89 != 0, F.concat("n_name", F.lit("_"), "c_mktsegment")).alias("Genus"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Subspecies").otherwise("Species")
        .alias("Accepted_Rank"),
        F.when(key % 97 != 0, F.concat(F.lit("S"), F.col("o_custkey").cast("string")))
        .alias("Accepted_Species"),
        F.col("o_custkey").alias("Accepted_Species_ID"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0)
        .alias("target"), F.col("o_totalprice").alias("totalprice")))


TAXA_CATALOGUE = Catalogue(
    target="target", flags=["seen", "used"], habits=[], compounds=["alk"],
    genus_level=["Spines", "Hairs"], continuous=["vq", "vd"], text=["Genus", "Family"],
    encoded=["Genus", "Family"], discarded=[], dropped_after_use=["Spines", "Hairs"])


# Presence (R) and absence (A) sets: the taxa of all lines with that flag.
def _sets(name: str, flag: str) -> str:
    return f"""{name} AS (
  SELECT DISTINCT CASE WHEN l_linenumber % 3 = 0 THEN t.Accepted_Species ELSE t.Accepted_Name END
    AS Accepted_Name, t.Accepted_Species, t.Genus
  FROM lineitem JOIN v_taxa t ON l_orderkey = t.Accepted_ID
  WHERE l_returnflag = '{flag}')"""


V_SETS = V_TAXA + ", " + _sets("v_hit", "R") + ", " + _sets("v_abs", "A")


def v_set(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag)
    taxa = v_taxa(spark, sf_dir).select("Accepted_ID", "Accepted_Name", "Accepted_Species", "Genus")
    return (lines.join(taxa, F.col("l_orderkey") == F.col("Accepted_ID"))
            .select(F.when(F.col("l_linenumber") % 3 == 0, F.col("Accepted_Species"))
                    .otherwise(F.col("Accepted_Name")).alias("Accepted_Name"),
                    "Accepted_Species", "Genus").distinct())


# Values of orders from all their lines: one row per name, in the order of the order key; each is unknown
# for some names, vd for whole species, so that each level of the fallback adds rows.
V_VALUES = """v_values AS (
  SELECT t.Accepted_Name, t.Accepted_Species, t.Genus, t.Accepted_ID AS row_no,
    max(CASE WHEN t.Accepted_ID % 3 <> 0 THEN l_quantity END) AS vq,
    max(CASE WHEN t.Accepted_ID % 4 <> 0 AND t.Accepted_Species_ID % 3 <> 0 THEN l_extendedprice END) AS vd
  FROM lineitem JOIN v_taxa t ON l_orderkey = t.Accepted_ID
  GROUP BY t.Accepted_Name, t.Accepted_Species, t.Genus, t.Accepted_ID)"""


def v_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey").agg(F.max("l_quantity").alias("vq"),
                                        F.max("l_extendedprice").alias("vd")))
    taxa = v_taxa(spark, sf_dir).select("Accepted_ID", "Accepted_Name", "Accepted_Species", "Genus",
                                        "Accepted_Species_ID")
    return lines.join(taxa, F.col("l_orderkey") == F.col("Accepted_ID")).select(
        "Accepted_Name", "Accepted_Species", "Genus", F.col("Accepted_ID").alias("row_no"),
        F.when(F.col("Accepted_ID") % 3 != 0, F.col("vq")).alias("vq"),
        F.when((F.col("Accepted_ID") % 4 != 0) & (F.col("Accepted_Species_ID") % 3 != 0), F.col("vd"))
        .alias("vd"))


# One row per document; the quality label is known for some.
V_DOC = """v_doc AS (
  SELECT d.doc_id, d.lang AS family, d.source AS genus, l.quality::DOUBLE AS y,
    d.n_chars::DOUBLE AS n_chars,
    CASE WHEN d.doc_id % 6 <> 0 THEN len(string_split(d.text, ' '))::DOUBLE END AS n_words,
    CASE WHEN d.doc_id % 8 <> 0 THEN len(string_split(d.text, chr(10)))::DOUBLE END AS n_lines,
    CAST(contains(d.text, 'the') AS INTEGER)::DOUBLE AS has_the,
    CAST(contains(d.text, chr(10)) AS INTEGER)::DOUBLE AS has_break,
    CAST(contains(d.text, '@') AS INTEGER)::DOUBLE AS has_at,
    CASE WHEN d.doc_id % 5 <> 0 THEN CAST(contains(d.text, '1') AS INTEGER)::DOUBLE END AS has_one
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def v_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text, key = F.col("text"), F.col("doc_id")
    return docs.join(labels.select("doc_id", "quality"), on="doc_id", how="left").select(
        "doc_id", F.col("lang").alias("family"), F.col("source").alias("genus"),
        F.col("quality").cast("double").alias("y"), F.col("n_chars").cast("double").alias("n_chars"),
        F.when(key % 6 != 0, F.size(F.split(text, " ")).cast("double")).alias("n_words"),
        F.when(key % 8 != 0, F.size(F.split(text, "\n")).cast("double")).alias("n_lines"),
        _num(text.contains("the")).alias("has_the"), _num(text.contains("\n")).alias("has_break"),
        _num(text.contains("@")).alias("has_at"),
        F.when(key % 5 != 0, _num(text.contains("1"))).alias("has_one"))


DOC_CONTINUOUS = ["n_chars", "n_words", "n_lines"]
DOC_BINARY = ["has_the", "has_break", "has_at", "has_one"]

# Two-word part names as labels; one word means unknown.
V_HABIT = """v_habit AS (
  SELECT p_partkey AS part_id,
    CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN '?'
         ELSE replace(p_name, ' ', '/') END AS habit FROM part)"""


def v_habit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("part_id"), F.when(key % 10 == 0, None).when(key % 10 == 1, "?")
        .otherwise(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("habit"))


# Supplier nations per part; unknown where the part is never ordered.
V_RANGE = V_PART + """, v_pairs AS (
  SELECT DISTINCT l_partkey AS part_id, n_name AS region_code
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def v_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = (table(spark, sf_dir, "lineitem")
             .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
             .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
             .groupBy("l_partkey").agg(F.collect_set("n_name").alias("codes")))
    return v_part(spark, sf_dir).join(pairs, F.col("part_id") == F.col("l_partkey"),
                                      "left").drop("l_partkey")


EMB_DIMS = 8

# First components of the embeddings, with cells blanked by rule.
V_EMB = "v_emb AS (SELECT vec_id, label, " + ", ".join(
    f"CASE WHEN (vec_id + {i}) % 11 <> 0 THEN embedding[{i + 1}]::DOUBLE END AS e{i}"
    for i in range(EMB_DIMS)) + " FROM embeddings)"


def v_emb(spark: SparkSession, sf_dir: str, blank: bool = True) -> DataFrame:
    cols = []
    for i in range(EMB_DIMS):
        v = F.col("embedding")[i].cast("double")
        cols.append((F.when((F.col("vec_id") + i) % 11 != 0, v) if blank else v).alias(f"e{i}"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *cols)
