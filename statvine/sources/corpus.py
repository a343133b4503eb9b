"""The legal corpus seen through the driver's tables, as views for the plans.

Chapters are parts, dated provision versions are line items, text chunks are documents (with embeddings of the same
id), cases are orders, and a case cites the chapters of its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as chapter_id", "concat(p_partkey div 100 + 1, ':', lpad(p_partkey % 100, 2, '0')) as chapter_number", "p_name as title", "p_brand", "p_type", "p_size")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_partkey as chapter_id", "cast(l_linenumber as string) as section_ref", "cast(l_shipdate as date) as as_at_date", "l_orderkey as download_id", "l_returnflag as version_label", "l_suppkey", "l_extendedprice")
    return lines.join(chapters(spark, sf_dir).select("chapter_id", "chapter_number", "title"), "chapter_id").drop("chapter_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id as chunk_id", "source as chapter_number", "cast(doc_id % 50 as string) as section_ref", "text as chunk_text", "date_add(date '2000-01-01', cast(doc_id % 5000 as int)) as as_at_date", "doc_id as download_id", "lang as version_label")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey as o_custkey", "c_name")
    return table(spark, sf_dir, "orders").join(customers, "o_custkey").selectExpr("concat('o', o_orderkey) as id", "concat(o_orderpriority, ' ', c_name) as title", "o_orderstatus as court", "year(o_orderdate) as year")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_partkey as chapter_id").distinct()
    return lines.join(chapters(spark, sf_dir).select("chapter_id", "chapter_number"), "chapter_id").select(F.concat(F.lit("o"), "l_orderkey").alias("case_id"), "chapter_number")


#: The same views for DuckDB.
SQL = """
WITH chapters AS (SELECT p_partkey AS chapter_id, (p_partkey // 100 + 1)::VARCHAR || ':' || lpad((p_partkey % 100)::VARCHAR, 2, '0') AS chapter_number,
    p_name AS title, p_brand, p_type, p_size FROM part),
versions AS (SELECT chapter_number, title, l_linenumber::VARCHAR AS section_ref, CAST(l_shipdate AS DATE) AS as_at_date, l_orderkey AS download_id,
    l_returnflag AS version_label, l_suppkey, l_extendedprice FROM lineitem JOIN chapters ON l_partkey = chapter_id),
chunks AS (SELECT doc_id AS chunk_id, source AS chapter_number, (doc_id % 50)::VARCHAR AS section_ref, text AS chunk_text,
    DATE '2000-01-01' + (doc_id % 5000)::INTEGER AS as_at_date, doc_id AS download_id, lang AS version_label FROM documents),
cases AS (SELECT 'o' || o_orderkey AS id, o_orderpriority || ' ' || c_name AS title, o_orderstatus AS court, year(o_orderdate)::INTEGER AS year
    FROM orders JOIN customer ON o_custkey = c_custkey),
citations AS (SELECT DISTINCT 'o' || l_orderkey AS case_id, chapter_number FROM lineitem JOIN chapters ON l_partkey = chapter_id)
"""
