"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "counterpoise", master: str | None = None,
                  settings: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution on; ``settings`` override the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets one of its own; on a cluster a folder of one machine
    would lose rows without an error, so it must be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="counterpoise-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy.

    Used where one result is read by several later jobs and must be the same in each, also after
    an executor is lost.  A columnar copy keeps column pruning and tells Spark the table's size.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under a folder of this application, so that all of an
    application's intermediate tables can be removed at once when it has ended.
    """
    application = f"counterpoise-{spark.sparkContext.applicationId}"
    return f"{shared_dir(spark).rstrip('/')}/{application}/{name}-{uuid.uuid4().hex}"


def default_buckets(spark: SparkSession) -> int:
    """How many buckets a global ordering is cut into: follows the cluster's shuffle width."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
