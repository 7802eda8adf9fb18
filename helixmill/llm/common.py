"""What the operators of this folder share: saved tables, batch sizes and plain lower case."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an Arrow batch, and bytes of a row group of a saved table. They bound memory and change no result.
BATCH_ROWS, GROUP_BYTES = 1000, 32 << 20
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a folder of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.helixmill.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="helixmill-")
        spark.conf.set("spark.helixmill.shared.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts the lineage, and survives lost executors.

    The table goes when the driver ends, or with the `scope` that it was made in.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixmill-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._helixmill_path = path
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)
    if _scopes:
        _scopes[-1].append(out)
    return out


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def forget(table: DataFrame) -> None:
    """Deletes a saved table that nothing reads any more."""
    path = getattr(table, "_helixmill_path", None)
    if path:
        fs, where = _folder(table.sparkSession, path)
        fs.delete(where, True)


@contextmanager
def scope() -> Iterator[None]:
    """Tables saved inside go at the end; for callers that have written their results by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            forget(table)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows from now on, unless the session says otherwise: 10,000 whole texts are too many for a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z and nothing else (F.lower changes other letters too)."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
