"""Staged tables in the shared folder, chunks of documents, packed arrays and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _hashable(kind: DataType) -> bool:
    """Whether Spark can hash values of this type: no maps and no variants anywhere in it."""
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def named(column: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """``(row, hash, doc)`` of each row, staged: a number of its own, a hash of the columns that can be hashed, and all columns as one struct.

    Staged, as a second read may number rows anew. Columns are nested, so none can clash with those that a step adds; ``doc.*`` gives them back.
    """
    plain = [named(f.name) for f in docs.schema.fields if _hashable(f.dataType)]
    return stage(docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(*plain).alias("hash"), F.struct(*[named(c) for c in docs.columns]).alias("doc")), name)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    path, spark = getattr(df, "_staged_at", None), df.sparkSession
    if path:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def pieces(docs: DataFrame, piece_bytes: int = 4 << 20, text_col: str = "text") -> int:
    """Into how many chunks of about ``piece_bytes`` the texts go: what is exchanged between chunks follows the data, not the number of partitions."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return int(size // piece_bytes) + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counter(*columns: Column) -> Column:
    """A number of rows and a checksum in one value, to see whether an edge table has changed."""
    return F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("x"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(id, component_id)`` of every id in ``edges(src, dst)``; ``component_id`` is the smallest id reachable.

    Alternating large-star and small-star rounds. A minimum per node is aggregated before it is joined back, so a node with a third of
    all edges costs a skewed join, which AQE splits, and never a group in one task. Each round is written to the shared folder; the
    driver sees one count and one checksum a round. Self-loops and null ends are ignored, repeated edges count once.
    """
    edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    edges = edges.where("src is not null and dst is not null and src <> dst")
    now = stage(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        # Large star: every larger neighbour is tied to the smallest one around.
        large = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        small = large.groupBy("src").agg(F.min("dst").alias("m"))
        tied = large.join(small, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        after = stage(tied.unionByName(small.select("src", F.col("m").alias("dst"))).distinct(), "edges")
        drop_staged(now)
        now = after
        state = now.agg(counter(F.col("src"), F.col("dst")).alias("s")).first()["s"]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("src").alias("id"), F.col("dst").alias("component_id"))
    return leaves.unionByName(leaves.select(F.col("component_id").alias("id"), "component_id").distinct())


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs."""
    top = int(np.abs(values).max()) if values.size else 0
    return np.ascontiguousarray(values.astype(next(t for t, m in ((np.int8, 1 << 7), (np.int16, 1 << 15), (np.int32, 1 << 31), (np.int64, 1 << 64)) if top < m))).tobytes()


def widen(blob: bytes, rows: int, width: int) -> np.ndarray:
    """The matrix that ``narrow`` packed."""
    size = len(blob) // max(rows * width, 1)
    return np.frombuffer(blob, {0: np.int8, 1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[size]).astype(np.int64).reshape(rows, width)
