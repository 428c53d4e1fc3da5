"""Every registered query with SQL, against DuckDB; the plans of the core queries."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from tools.check import TABLES, canon

SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = entry_module.queries()[name](spark, sf_dir)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    rel = duck.execute(SQL[name])
    want = pd.DataFrame(rel.fetchall(), columns=[d[0] for d in rel.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry_has_rows(spark, sf_dir):
    out = entry_module.entry(spark)
    assert out.columns == ["family", "uncorrected", "corrected", "truth", "n_labelled",
                           "n_uncovered"]
    assert out.count() > 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "corrected_prevalence", "update_hits_genus", "lookup_values_many", "fill_from_genus",
    "conditional_cooccurrence", "contingency_table", "ks_and_mann_whitney_bucketed", "pr_curve",
    "stratified_folds", "region_counts"])
def test_no_pairwise_joins(spark, sf_dir, name):
    text = plan(entry_module.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(entry_module.queries()["taxa_checklist"](spark, sf_dir))
    assert "PushedFilters: [In(p_type" in text and "p_retailprice" not in text
    text = plan(entry_module.queries()["contingency_table"](spark, sf_dir))
    assert "source" not in text.split("ReadSchema")[1]
