"""Results that several steps read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a new local folder only where it is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def keep(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder, in folders by the columns ``by``, and reads it back; and where it lies, for ``remove``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``keep`` for results on the way: lineage is cut, and a lost executor loses nothing.

    ``scratch`` removes what was written within it; outside of it files stay until the folder is cleared.
    """
    found, path = keep(df, name, *by)
    for written in _OPEN:
        written.append(path)
    return found


_OPEN: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """By the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all that ``stash`` wrote within it; write results before, or ``keep`` them."""
    written: list[str] = []
    _OPEN.append(written)
    try:
        yield
    finally:
        _OPEN.remove(written)
        for path in written:
            remove(spark, path)
