"""The paths taken on large tables, forced on small ones, against plain computation."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from counterpoise.operators import prefix as P, skew as K
from counterpoise.operators.bootstrap import bootstrap_mean_ci
from counterpoise.operators import bootstrap
from counterpoise.operators.folds import stratified_folds
from counterpoise.operators import knn
from counterpoise.operators.knn import knn_impute
from counterpoise.operators.quantiles import exact_quantiles


def hot_table(spark, n=4000):
    """A third of the rows share one key, a tenth have none."""
    i = F.col("id")
    return spark.range(0, n, 1, 6).select(
        i, F.when(i % 10 == 9, None).when(i % 3 == 0, F.lit("hot"))
        .otherwise(F.concat(F.lit("k"), (i % 50).cast("string"))).alias("key"))


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("with_count", [False, True])
def test_hot_key_lookup_equals_plain_join(spark, null_safe, with_count):
    left = hot_table(spark)
    table = left.groupBy("key").agg(F.max("id").alias("v"), F.count(F.lit(1)).alias("_n"))
    got = K.lookup(left, table, ["key"], ["v"], count="_n" if with_count else None,
                   null_safe=null_safe, broadcast_rows=0, parts=8, floor=10)
    want = {r["key"]: r["v"] for r in table.collect()}
    rows = got.collect()
    assert len(rows) == 4000 and got.columns == ["id", "key", "v"]
    for r in rows:
        expect = None if r["key"] is None and not null_safe else want[r["key"]]
        assert r["v"] == expect


def test_hot_rows_are_spread_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        left = hot_table(spark, 60_000)
        table = left.groupBy("key").agg(F.max("id").alias("v"), F.count(F.lit(1)).alias("_n"))
        out = K.lookup(left, table, ["key"], ["v"], count="_n", broadcast_rows=0, parts=8, floor=10)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(
            F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # a plain join puts 18,000 hot rows, or 6,000 rows without key, into one of 8 tasks
    assert len(sizes) >= 6 and max(sizes) < 16_000


def test_unique_keys_lookup_with_null_keys(spark):
    left = spark.range(500).withColumn("key", F.when(F.col("id") % 3 != 0, F.col("id")))
    table = spark.range(0, 500, 2).select(F.col("id").alias("key"), (F.col("id") * 10).alias("v"))
    got = K.lookup(left, table, ["key"], ["v"], unique_left=True, broadcast_rows=0).collect()
    assert len(got) == 500
    assert all(r["v"] == (r["key"] * 10 if r["key"] is not None and r["key"] % 2 == 0 else None)
               for r in got)


def test_hot_keys_are_bounded(spark):
    counts = K.key_counts(hot_table(spark), ["key"])
    assert [r["key"] for r in K.hot_only(counts, parts=5, floor=10).collect()] == ["hot"]
    assert K.hot_only(counts, parts=40, floor=10).count() <= 40


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-5, 5).map(lambda x: round(x, 1))), min_size=1,
                max_size=80))
def test_narrowed_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    known = [v for v in values if v is not None]
    for small in (5, 1000):
        got = exact_quantiles(df, ["v"], probs, small=small)["v"]
        if not known:
            assert got == [None] * 5
        else:
            assert got == pytest.approx(list(np.quantile(known, probs)), abs=1e-12)


def test_prefix_sums_with_and_without_buckets(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(v), int(a)) for g, v, a in zip(
        rng.integers(0, 3, 3000), np.where(rng.random(3000) < 0.3, 7.0, rng.normal(size=3000).round(2)),
        rng.integers(0, 5, 3000))]
    df = spark.createDataFrame(rows, "g int, v double, a long")
    for descending in (False, True):
        want = {}
        for g in range(3):
            total = 0
            for v in sorted({r[1] for r in rows if r[0] == g}, reverse=descending):
                here = sum(r[2] for r in rows if r[0] == g and r[1] == v)
                want[g, v] = (here, total)
                total += here
        for buckets in (None, 2, 7):
            got = P.prefix_sums(df, ["g"], "v", ["a"], descending, buckets, buckets is not None)
            assert {(r["g"], r["v"]): (r["a"], r["a_before"]) for r in got.collect()} == want


def test_bucket_count_is_a_binary_search(spark):
    limits = [1.0, 2.0, 2.5, 9.0, 11.0]
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.2, 9.0, 10.0, 50.0)], "x double")
    got = df.select("x", P.count_at_most(P.double_array(P.padded(limits)), F.col("x"), 5)).collect()
    assert [r[1] for r in got] == [0, 1, 2, 4, 4, 5]


def test_folds_are_balanced_and_repeatable(spark):
    df = spark.range(1003).withColumn("y", (F.col("id") % 7 == 0).cast("int"))
    one = stratified_folds(df, "id", "y", 10, rep=1)
    sizes = one.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in sizes if r["y"] == y]
        assert len(n) == 10 and max(n) - min(n) <= 1
    again = stratified_folds(df.repartition(5), "id", "y", 10, rep=1)
    assert one.exceptAll(again).count() == 0
    assert one.exceptAll(stratified_folds(df, "id", "y", 10, rep=2)).count() > 0


def brute_knn(rows, donors, k):
    rows, donors = np.array(rows, float), np.array(donors, float)
    out = rows.copy()
    for i, row in enumerate(rows):
        for c in np.flatnonzero(np.isnan(row)):
            cands = []
            for d in donors:
                shared = ~np.isnan(row) & ~np.isnan(d)
                if np.isnan(d[c]) or not shared.any():
                    continue
                sq = ((row[shared] - d[shared]) ** 2).sum() * len(row) / shared.sum()
                cands.append((np.sqrt(sq), d[c]))
            cands.sort()
            out[i, c] = np.mean([x for _, x in cands[:k]]) if cands else np.nanmean(donors[:, c])
    return out


@pytest.mark.parametrize("anchors,pivots,block", [(0, None, 20_000), (0, 24, 9), (2, 9, 1000)])
def test_knn_against_brute_force(spark, anchors, pivots, block):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(90, 5)).round(3)
    data[30:60, :2] = data[0, :2]                     # a third of the rows in one place
    data[70:80] = data[3]                             # copies
    for i in range(90):
        for c in range(anchors, 5):
            if rng.random() < 0.3:
                data[i, c] = np.nan
    if not anchors:
        data[5] = np.nan                              # nothing to go by
    rows = [(i, *[None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"c{i} double" for i in range(5)))
    out = knn_impute(df, df, [f"c{i}" for i in range(5)], 5, block_rows=block, pivots=pivots)
    got = np.array([list(r)[1:] for r in sorted(out.collect())], float)
    assert np.allclose(got, brute_knn(data, data, 5), atol=1e-9)


def test_knn_passes_over_cells_where_every_column_has_gaps(spark, monkeypatch):
    """The same results as brute force, from a part of the pairs of rows and cells."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 5)) * 30
    data = (centres[rng.integers(0, 6, 500)] + rng.normal(size=(500, 5))).round(2)
    for i in range(500):
        data[i, rng.choice(5, rng.integers(0, 2), replace=False)] = np.nan
    assert np.isnan(data).any(0).all()
    rows = [(i, *[None if np.isnan(x) else float(x) for x in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"c{i} double" for i in range(5)))
    seen, cells = [], []
    search, cells_of = knn._search, knn._cells
    monkeypatch.setattr(knn, "_search", lambda q, d, k: seen.append(q.select("v", "cell").distinct().count()) or search(q, d, k))
    monkeypatch.setattr(knn, "_cells", lambda *a: cells.append(cells_of(*a)) or cells[0])
    out = knn_impute(df, df, [f"c{i}" for i in range(5)], 3, block_rows=1000, pivots=60)
    got = np.array([list(r)[1:] for r in sorted(out.collect())], float)
    assert np.allclose(got, brute_knn(data, data, 3), atol=1e-9)
    asked, all_cells = int(np.isnan(data).any(1).sum()), cells[0].offsets[-1] + 1
    assert all_cells > 30 and sum(seen) < 0.5 * asked * all_cells


def test_knn_compares_few_pairs_within_a_cell(monkeypatch):
    """Boxes around few donors pass over most pairs of one cell, and the result is that of all pairs."""
    rng = np.random.default_rng(7)
    data = rng.normal(size=(3000, 3)).round(2)
    data[rng.random(3000) < 0.2, 2] = np.nan
    pairs, distances = [], knn._block_distances
    monkeypatch.setattr(knn, "_block_distances", lambda a, b: pairs.append(len(a) * len(b)) or distances(a, b))
    gaps = np.flatnonzero(np.isnan(data[:, 2]))
    got = {}
    for row, col, d, x, n in knn._nearest(data[gaps], data, np.ones(3000, int), 5, np.full((len(gaps), 3), np.inf)):
        for i, value in zip(row, x):
            got.setdefault(int(i), []).append(value)
    assert sum(pairs) < 0.3 * len(gaps) * 3000
    assert np.allclose([np.mean(got[i]) for i in range(20)], brute_knn(data[gaps[:20]], data, 5)[:, 2], atol=1e-9)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_knn_measures_few_pairs_column_by_column(monkeypatch, shift):
    """Products of matrices rule out most pairs that boxes do not; what is left has the distances of all pairs, ties too."""
    rng = np.random.default_rng(9)
    data = rng.normal(size=(1200, 6)).round(1) + shift
    data[rng.random(data.shape) < 0.15] = np.nan
    data[:2] = np.nan
    gaps = np.flatnonzero(np.isnan(data).any(1))
    pairs, distances = [], knn._pair_distances
    monkeypatch.setattr(knn, "_pair_distances", lambda a, b: pairs.append(len(a)) or distances(a, b))
    whole = knn._block_distances(data[gaps], data)
    got = {}
    for row, col, d, x, n in knn._nearest(data[gaps], data, np.ones(1200, int), 5, np.full((len(gaps), 6), np.inf)):
        for i, c, *cand in zip(row, col, d, x):
            got.setdefault((int(i), int(c)), []).append(tuple(cand))
    for (i, c), cands in got.items():
        has = np.flatnonzero(~np.isnan(data[:, c]) & ~np.isnan(whole[i]))
        assert sorted(cands) == sorted(zip(whole[i, has], data[has, c]))[:5]
    assert len(got) == np.isnan(data[gaps]).sum() - 12
    assert sum(pairs) < 0.1 * len(gaps) * 1200


def test_knn_keeps_few_candidates_under_a_loose_limit(monkeypatch):
    """Where the first box leaves a wide limit, only the nearest of the other boxes and their ties are candidates."""
    rng = np.random.default_rng(10)
    data = rng.normal(size=(3000, 6))
    data[rng.random(data.shape) < 0.15] = np.nan
    gaps = np.flatnonzero(np.isnan(data).any(1))[:200]
    told, merged = [], knn._merged
    monkeypatch.setattr(knn, "_merged", lambda parts, k: told.append(len(parts[-1][0])) or merged(parts, k))
    whole = knn._block_distances(data[gaps], data)
    got = {}
    for row, col, d, x, n in knn._nearest(data[gaps], data, np.ones(3000, int), 5, np.full((200, 6), np.inf)):
        for i, c, *cand in zip(row, col, d, x):
            got.setdefault((int(i), int(c)), []).append(tuple(cand))
    for (i, c), cands in got.items():
        has = np.flatnonzero(~np.isnan(data[:, c]) & ~np.isnan(whole[i]))
        assert sorted(cands) == sorted(zip(whole[i, has], data[has, c]))[:5]
    assert sum(told) < 50 * len(got)


def test_rows_that_meet_small_encodings_are_not_written_again(spark, monkeypatch):
    from counterpoise.operators import features as X
    rows = [(f"r{i}", "abc"[i % 3], float(i % 7) if i % 5 else None, float(i % 4), float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, g string, u double, v double, y double")
    made = X.Preparation(["g", "u", "v"], "y", categorical=["g"], keep=["name"])
    want = {r["name"]: r for r in X.prepare(made, df).train.collect()}
    for limit, writes in ((X.BROADCAST_ROWS, 0), (2, 1)):
        monkeypatch.setattr(X, "SPREAD_ROWS", 100)
        monkeypatch.setattr(X, "BROADCAST_ROWS", limit)
        whole, cut = [], X.cut_lineage
        monkeypatch.setattr(X, "cut_lineage", lambda t: whole.append(t.columns) or cut(t))
        prepared = X.prepare(made, df)
        monkeypatch.setattr(X, "cut_lineage", cut)
        # dealt evenly, imputed, and in between only where a table of categories is too large to broadcast
        assert sum("name" in columns for columns in whole) == 2 + writes
        got = {r["name"]: r for r in prepared.train.collect()}
        assert got.keys() == want.keys()
        assert all(got[n][c] == pytest.approx(want[n][c], abs=1e-9) for n in want for c in ("g", "u", "v"))


def test_knn_cells_grow_with_the_donors(spark, monkeypatch):
    """A named number of pivots is a least number: cells stay at about block_rows, so blocks don't meet blocks."""
    rng = np.random.default_rng(8)
    rows = [(float(a), float(b), float(a + b) if i % 11 else None) for i, (a, b) in enumerate(rng.normal(size=(800, 2)))]
    df = spark.createDataFrame(rows, "c0 double, c1 double, c2 double")
    cells, cells_of = [], knn._cells
    monkeypatch.setattr(knn, "_cells", lambda *a: cells.append(cells_of(*a)) or cells[0])
    out = knn_impute(df, df, ["c0", "c1", "c2"], 5, block_rows=20, pivots=4)
    data = np.array([[np.nan if x is None else x for x in r] for r in rows])
    gaps = np.isnan(data[:, 2])
    got = np.array([list(r) for r in out.collect()])
    want = np.concatenate([data[~gaps], brute_knn(data[gaps], data, 5)])
    assert np.allclose(got[np.lexsort(got.T)], want[np.lexsort(want.T)], atol=1e-9)
    assert cells[0].offsets[-1] + 1 >= 800 / 20


def test_knn_searches_many_small_groups_in_few_tasks(spark, monkeypatch):
    """A task costs more than a small group, so groups share tasks."""
    rng = np.random.default_rng(10)
    rows = [(float(a), float(b), float(a + b) if i % 3 else None) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "c0 double, c1 double, c2 double")
    seen, search = [], knn._search

    def watched(queries, donors, k):
        keys = ["cell", "block", "part"]
        seen.append((queries.select(*keys).distinct().count(), queries.rdd.getNumPartitions()))
        return search(queries, donors, k)
    monkeypatch.setattr(knn, "_search", watched)
    out = knn_impute(df, df, ["c0", "c1", "c2"], 5, block_rows=20)
    data = np.array([[np.nan if x is None else x for x in r] for r in rows])
    gaps = np.isnan(data[:, 2])
    want = np.concatenate([data[~gaps], brute_knn(data[gaps], data, 5)])
    got = np.array([list(r) for r in out.collect()])
    assert np.allclose(got[np.lexsort(got.T)], want[np.lexsort(want.T)], atol=1e-9)
    assert all(groups >= 20 and tasks <= groups / 8 for groups, tasks in seen)


def test_bootstrap_paths_agree(spark, monkeypatch):
    x = np.random.default_rng(3).exponential(size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    one = bootstrap_mean_ci(df, "v", replicates=2000).first()
    monkeypatch.setattr(bootstrap, "SMALL", 10)
    two = bootstrap_mean_ci(df, "v", replicates=2000).first()
    se = x.std() / np.sqrt(len(x))
    for r in (one, two):
        assert r["low"] == pytest.approx(x.mean() - 1.96 * se, abs=0.25 * se)
        assert r["high"] == pytest.approx(x.mean() + 1.96 * se, abs=0.25 * se)


def test_preparation_deals_few_files_to_all_tasks(spark):
    """Rows of one small file are prepared by several tasks, and none is lost or changed."""
    from counterpoise.operators.features import Preparation, prepare
    columns = [f"c{i}" for i in range(8)]
    df = spark.range(60_000).coalesce(1).select("id", (F.col("id") % 2).alias("y"), *[
        F.rand(i).alias(c) for i, c in enumerate(columns)])
    out = prepare(Preparation(columns, "y", keep=["id"], scale=False, impute=False), df).train
    assert out.select(F.spark_partition_id()).distinct().count() >= 4
    assert out.exceptAll(df.select("id", "y", *columns)).isEmpty() and out.count() == 60_000
