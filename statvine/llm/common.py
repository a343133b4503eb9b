"""What the operators of this subpackage share: input columns, the shared folder, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statvine.sources.shared import shared_dir, stash  # noqa: F401

#: ASCII white space, the separators of words ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on the same six.
WHITESPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bare(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` (long), ``keep`` and the whole text as UTF-8 bytes; a null text is empty.

    Other columns are left behind, so names that clash with an operator's own can't matter.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text)


def unused(docs: DataFrame, name: str) -> str:
    """``name``, with underscores at its end while a column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterable[tuple]], schema: str) -> DataFrame:
    """``mapInArrow`` with ``rows`` giving the output tuples of a batch."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield to_batch(list(rows(batch)), arrow)

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def fold_remainder(column: str, modulus: int):
    """``crc32`` of an id written as text, modulo ``modulus``; a null id counts as the text ``''``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
