"""Publication: whole versions or none."""

import os

import pytest
from pyspark.sql import functions as F

from counterpoise.sources import publication as P


def numbers(spark, n):
    return spark.range(n).select(F.col("id"), (F.col("id") * 2).alias("twice"))


def test_versions_follow_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, path)
    assert [P.publish(numbers(spark, n), path) for n in (3, 5, 0)] == [1, 2, 3]
    assert P.versions(spark, path) == [2, 3]
    assert P.read_published(spark, path, check=True).count() == 0 and P.read_published(spark, path, 2).count() == 5
    assert P.read_published(spark, path).columns == ["id", "twice"]
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, path, 1)
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 2


def test_a_failed_run_leaves_the_last_version(spark, tmp_path):
    path = str(tmp_path / "t")
    P.publish(numbers(spark, 4), path)
    broken = numbers(spark, 100).withColumn("id", F.when(F.col("id") < 90, F.col("id")).otherwise(
        F.raise_error(F.lit("stop")).cast("long")))
    with pytest.raises(Exception, match="stop"):
        P.publish(broken, path)
    assert P.versions(spark, path) == [1] and P.read_published(spark, path, check=True).count() == 4
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 1


def test_the_slower_writer_raises(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    P.publish(numbers(spark, 1), path)
    seen = P._Folder.versions
    monkeypatch.setattr(P._Folder, "versions", lambda self: [])      # as a writer that began before that
    with pytest.raises(FileExistsError):
        P.publish(numbers(spark, 9), path)
    monkeypatch.setattr(P._Folder, "versions", seen)
    assert P.read_published(spark, path).count() == 1


def test_lost_rows_are_noticed_and_order_is_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    P.publish(numbers(spark, 50).repartition(4).sortWithinPartitions("id"), path, order=True)
    first = P.read_published(spark, path).groupBy().agg(F.min_by("id", P.ORDER)).first()[0]
    assert first is not None and P.read_published(spark, path).select(P.ORDER).distinct().count() == 50
    data = next(n for n in os.listdir(path) if n.startswith("data-"))
    os.remove(next(os.path.join(path, data, n) for n in os.listdir(f"{path}/{data}") if n.endswith(".parquet")))
    with pytest.raises(ValueError, match="in place of 50"):
        P.read_published(spark, path, check=True)
