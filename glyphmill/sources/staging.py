"""Folders for what a job writes on its way, and tables kept as a row of versions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder under the shared one of the cluster; a temporary one only where none is set on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="glyphmill-")
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def staged(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the finished versions under ``root``, oldest first."""
    fs, path = _files(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
    found = sorted(int(n[8:]) for n in names if n.startswith("version-") and n[8:].isdigit())
    return [n for n in found if fs.exists(_files(spark, f"{root}/version-{n:08d}/_SUCCESS")[1])]


def read_version(spark: SparkSession, root: str, schema: str | None = None, number: int | None = None) -> DataFrame | None:
    """The newest finished version, or the one asked for; an empty table if there is none and a schema is given."""
    have = versions(spark, root)
    if not have:
        return spark.createDataFrame([], schema) if schema else None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{root}/version-{number or have[-1]:08d}")


def write_version(df: DataFrame, root: str, keep: int = 3) -> int:
    """Write ``df`` as the next version; readers see it once it is whole, and a second writer of the same number fails.

    ``df`` may read the version before. All but the ``keep`` newest are deleted.
    """
    spark = df.sparkSession
    number = max(versions(spark, root), default=0) + 1
    df.write.mode("errorifexists").parquet(f"{root}/version-{number:08d}")
    for old in versions(spark, root)[:-keep]:
        fs, path = _files(spark, f"{root}/version-{old:08d}")
        fs.delete(path, True)
    return number
