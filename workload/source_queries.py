"""Reading and writing; files go to the folder all executors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from counterpoise.operators.quality import null_report
from counterpoise.session import scratch_path
from counterpoise.sources import readers as R, writers as W
from workload.registry import query
from workload.views import PART_CATALOGUE, V_PART, table, v_part


@query("read_tables", """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance,
  c_mktsegment AS segment, 0 AS source FROM customer UNION ALL
  SELECT s_suppkey, s_name, s_acctbal, NULL, 1 FROM supplier""")
def read_tables(spark, sf):
    paths = [scratch_path(spark, "customer"), scratch_path(spark, "supplier")]
    table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    ).write.parquet(paths[0])
    table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance")).write.parquet(paths[1])
    out = R.read_tables(spark, paths, "parquet")
    return out.select("key", "name", "balance", "segment", F.col("row_order.source").alias("source"))


@query("read_tables_csv", """SELECT p_partkey AS key, p_name AS name, p_retailprice AS price FROM part
  UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def read_tables_csv(spark, sf):
    paths = [scratch_path(spark, "part"), scratch_path(spark, "supplier")]
    W.write_table(table(spark, sf, "part").select(
        F.lit(0).alias("index"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price")), paths[0], "csv")
    W.write_table(table(spark, sf, "supplier").select(
        F.lit(0).alias("index"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")),
        paths[1], "csv", single_file=True)
    out = R.read_tables(spark, paths, "csv", drop_index=True)
    return out.select(F.col("key").cast("bigint"), "name", F.col("price").cast("double"))


@query("read_trait_table", f"WITH {V_PART} SELECT name, use_m, price, y FROM v_part")
def read_trait_table(spark, sf):
    path = scratch_path(spark, "traits")
    W.write_table(v_part(spark, sf), path)
    return R.read_trait_table(spark, path, ["use_m", "price", "y"], cat=PART_CATALOGUE)


@query("taxa_checklist", """SELECT p_partkey, p_type, p_brand FROM part
  WHERE p_type IN ('ECONOMY', 'PROMO') AND p_brand IN ('Brand#2', 'Brand#17')""")
def taxa_checklist(spark, sf):
    return R.taxa_checklist(spark, f"{sf}/part.parquet", ["ECONOMY", "PROMO"],
                            ["Brand#2", "Brand#17"], family="p_type", rank="p_brand").select(
        "p_partkey", "p_type", "p_brand")


@query("write_table", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def write_table(spark, sf):
    path = scratch_path(spark, "customers")
    W.write_table(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), path,
                  partition_by=["c_mktsegment"])
    return spark.read.parquet(path)


@query("variable_catalogue", f"""WITH {V_PART} """ + " UNION ALL ".join(
    f"""SELECT '{group}' AS variable_group, '{v}' AS variable, count(*) - count({v}) AS n_null FROM v_part"""
    for group, v in [("target_encoded", "genus"), ("target_encoded", "family"), ("compounds", "alk"),
                     ("continuous", "price"), ("continuous", "soil")]))
def variable_catalogue(spark, sf):
    path = scratch_path(spark, "catalogue")
    W.write_catalogue(spark, path, PART_CATALOGUE)
    stored = spark.read.parquet(path).filter(
        F.col("variable_group").isin("target_encoded", "compounds", "continuous"))
    traits = v_part(spark, sf)
    return stored.join(null_report(traits, traits.columns), F.col("variable") == F.col("column")).select(
        "variable_group", "variable", "n_null")


@query("publish_table", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def publish_table(spark, sf):
    """The second of two versions of a table."""
    from counterpoise.sources import publication as P
    path = scratch_path(spark, "published")
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    P.publish(rows, path)
    P.publish(rows.filter("c_acctbal > 0"), path)
    return P.read_published(spark, path, check=True)
