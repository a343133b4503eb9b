"""Documents to packed training batches, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs: quality rules and toxicity drop documents, near-duplicates (five words, similarity 0.8) leave one
of each group, personal data is redacted in place, and packing gives each document its batch beside all its columns.

Null and empty texts fail the quality rules and go there. Rows equal in id and text become one, as copies do; different
texts under one id, or without an id, stay documents of their own. Empty tables give empty results; without labels no text is
toxic enough to go. Extra columns are carried along; a packing column whose name is taken gets underscores at its end.

The stages with Python workers hand them ``ROWS`` rows at once, unless the session says how many: rows carry whole texts, of
which the worker and the executor's memory outside the heap hold several copies. Results don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statvine.llm import near_dedup, packing, pii_spans, quality_rules, toxicity_knn
from statvine.llm.common import table
from statvine.sources.shared import keep, remove, scratch

ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _few_rows(spark: SparkSession) -> None:
    """Spark reads the setting when a plan runs, so it stays on the session after a stage; ``run`` takes it back."""
    if spark.conf.get(_ROWS, None) is None:
        spark.conf.set(_ROWS, ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_rows(spark)
    return quality_rules.keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_rows(spark)
    return toxicity_knn.keep_civil(docs, toxicity_knn.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _few_rows(spark)
    return near_dedup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_spans.redact(docs, pii_spans.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]

#: SQL can't express the toxicity model or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    What a stage writes on its way goes when its result is written, and a result goes when the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    rows = spark.conf.get(_ROWS, None)
    try:
        for name, stage in STAGES:
            with scratch(spark):
                docs, path = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
            if before is not None:
                remove(spark, before)
            before = path
    finally:
        if rows is None:
            spark.conf.unset(_ROWS)
    return docs
