"""New versions as a stream: each (chapter, download id) is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "chapter_number string, section_ref string, download_id long, as_at_date date, arrived timestamp"


def incoming(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """The first row of each version; state of versions older than the watermark is dropped."""
    rows = spark.readStream.schema(SCHEMA).parquet(path)
    return rows.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["chapter_number", "section_ref", "download_id"])


def append(versions: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    return versions.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
