"""Tables published whole: readers see a version or the one before, never a part.

A version's rows go to a folder of their own.  Only when they are all there, its manifest (one small file with the
folder, schema and number of rows) is written under another name and renamed, which file systems do at once.  Readers
take the newest manifest, so a run that fails midway leaves the last version in force.  Rows carry ``row_order``
where their order counts (which row is first of several), since files keep none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

ORDER = "row_order"


class _Folder:
    """The few file operations that publication needs, on whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        where = self.at("manifests")
        if not self.fs.exists(where):
            return []
        names = [status.getPath().getName() for status in self.fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def write(self, name: str, text: str) -> None:
        out = self.fs.create(self.at(name), False)
        out.write(bytearray(text.encode()))
        out.close()


def _name(version: int) -> str:
    return f"manifests/{version:012d}.json"


def _manifest(spark: SparkSession, folder: _Folder, version: int) -> dict:
    lines = spark.read.option("wholetext", True).text(str(folder.at(_name(version)).toString())).collect()
    return json.loads(lines[0][0])


def publish(df: DataFrame, path: str, keep: int = 2, order: bool = False) -> int:
    """Write ``df`` as the next version of the table at ``path`` and return its number.

    With ``order`` rows get ``row_order``, which sorts them as ``df`` gives them.  The last ``keep`` versions stay, for
    readers that have begun.  Raises if another writer published the same version first; what was in force then
    stays, and the rows written here are removed."""
    spark = df.sparkSession
    folder = _Folder(spark, path)
    before = folder.versions()
    version = (before[-1] if before else 0) + 1
    data = f"data-{version:012d}-{uuid.uuid4().hex}"
    rows = df.withColumn(ORDER, F.monotonically_increasing_id()) if order else df
    try:
        rows.write.parquet(f"{folder.root}/{data}")
        written = spark.read.schema(rows.schema).parquet(f"{folder.root}/{data}").count()
        waiting = f"manifests/.{uuid.uuid4().hex}"
        folder.write(waiting, json.dumps({"data": data, "rows": written, "schema": rows.schema.jsonValue()}))
        taken = folder.fs.exists(folder.at(_name(version)))
        if taken or not folder.fs.rename(folder.at(waiting), folder.at(_name(version))):
            folder.fs.delete(folder.at(waiting), False)
            raise FileExistsError(f"version {version} of {path} was published by another writer")
    except BaseException:
        folder.fs.delete(folder.at(data), True)
        raise
    for old in before[:-(keep - 1)] if keep > 1 else before:
        held = _manifest(spark, folder, old)["data"]
        folder.fs.delete(folder.at(_name(old)), False)
        folder.fs.delete(folder.at(held), True)
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions that can be read, oldest first."""
    return _Folder(spark, path).versions()


def read_published(spark: SparkSession, path: str, version: int | None = None, check: bool = False) -> DataFrame:
    """The newest (or named) version, with the schema it was published with.

    ``check`` counts the rows and raises if they are not as many as the manifest says."""
    folder = _Folder(spark, path)
    found = folder.versions()
    if version is None:
        if not found:
            raise FileNotFoundError(f"nothing is published at {path}")
        version = found[-1]
    elif version not in found:
        raise FileNotFoundError(f"version {version} is not published at {path}")
    manifest = _manifest(spark, folder, version)
    df = spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{folder.root}/{manifest['data']}")
    if check and (n := df.count()) != manifest["rows"]:
        raise ValueError(f"version {version} at {path} has {n} rows in place of {manifest['rows']}")
    return df
