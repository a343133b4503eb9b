"""Searches and walks for many queries at once."""

from pyspark.sql import functions as F

from statvine.functions.vectors import norm
from statvine.operators import walks
from statvine.operators.vectorsearch import Cells
from statvine.plans.graphs import GRAPH
from statvine.plans.registry import query
from statvine.plans.walks import _law_graph
from statvine.sources.corpus import table
from statvine.sources.shared import stash

_CELLS: dict[tuple, Cells] = {}


def _cells(spark, d):
    """Cells are stored once for all queries of an application over the same tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CELLS:
        _CELLS[key] = Cells.build(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    return _CELLS[key]


def _queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "embedding")


UNIT = """WITH unit AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
sims AS (SELECT q.id AS query, x.id, round(list_inner_product(q.v, x.v), 9) AS score FROM unit q, unit x WHERE q.id % 20 = 0)
"""


@query(UNIT + "SELECT query, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sims QUALIFY rank <= 10")
def search_vector_batch(spark, d):
    """The ten nearest of every twentieth vector, by cells whose bounds leave none out that matters."""
    found, _ = _cells(spark, d).search(_queries(spark, d), 10)
    return found.select("query", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


#: A query lies between a vector and the next one; its target is the first.
BETWEEN = UNIT + """, aims AS (SELECT a.id AS query, a.id AS target, list_transform(list_zip(a.v, b.v), lambda z: z[1] + 1.5 * z[2]) AS w FROM unit a JOIN unit b ON b.id = a.id + 1 WHERE a.id % 20 = 0),
directed AS (SELECT query, target, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS v FROM aims),
scored AS (SELECT query, target, x.id, round(list_inner_product(d.v, x.v), 9) AS score FROM directed d, unit x),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scored)
"""


def _ranks(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    one = rows.withColumn("length", norm(F.col("v"))).where("length > 0").select("vec_id", F.transform("v", lambda x: x / F.col("length")).alias("v"))
    after = one.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    pairs = one.where("vec_id % 20 = 0").join(after, "vec_id")
    aims = pairs.select(F.col("vec_id").alias("query"), F.zip_with("v", "w", lambda a, b: a + 1.5 * b).alias("embedding"), F.col("vec_id").alias("target"))
    return _cells(spark, d).ranks(aims)


@query(BETWEEN + "SELECT query, target, rank FROM ranked WHERE id = target")
def target_ranks(spark, d):
    """At which place a search finds what it should."""
    return _ranks(spark, d)


@query(BETWEEN + "SELECT count(*) AS evaluated, count(*) FILTER (rank <= 20) AS hits, round(count(*) FILTER (rank <= 20) / count(*), 4) AS recall FROM ranked WHERE id = target")
def recall_at_20(spark, d):
    """How many targets are among the first twenty of their search."""
    hits = F.count_if(F.col("rank") <= 20)
    return _ranks(spark, d).agg(F.count("*").alias("evaluated"), hits.alias("hits"), F.round(hits / F.count("*"), 4).alias("recall"))


#: Hundreds of walks, each from a case and the next one.
STARTS = GRAPH + """, near AS (SELECT source, target, min(source_ || ' ' || target_) AS ordinal FROM (SELECT source, target, source AS source_, target AS target_ FROM edges UNION ALL SELECT target, source, source, target FROM edges) GROUP BY ALL),
s AS (SELECT o_orderkey AS query, 'case:o' || (o_orderkey + unnest([0, 1])) AS id, unnest([0, 1]) AS place FROM orders WHERE o_orderkey % 50 = 0),
seeds AS (SELECT query, id, min(place) AS place FROM s GROUP BY ALL)
"""
BULK_BFS = STARTS + """, l1 AS (SELECT query, target AS id, 2 + row_number() OVER (PARTITION BY query ORDER BY min((place, ordinal))) - 1 AS place FROM near JOIN seeds ON source = id WHERE (query, target) NOT IN (SELECT (query, id) FROM seeds) GROUP BY query, target),
l2 AS (SELECT query, target AS id, 1 + (SELECT max(place) FROM l1 m WHERE m.query = x.query) + row_number() OVER (PARTITION BY query ORDER BY min((place, ordinal))) - 1 AS place FROM near JOIN l1 x ON source = id WHERE (query, target) NOT IN (SELECT (query, id) FROM seeds UNION ALL SELECT (query, id) FROM l1) GROUP BY query, target)
SELECT query, id, place::BIGINT AS place FROM (SELECT query, id, place FROM seeds UNION ALL SELECT query, id, place FROM l1 UNION ALL SELECT query, id, place FROM l2) WHERE place < 12"""


def _starts(spark, d):
    rows = table(spark, d, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("query"), F.posexplode(F.array(F.col("o_orderkey"), F.col("o_orderkey") + 1)).alias("place", "o"))
    return rows.select("query", "place", F.concat(F.lit("case:o"), "o").alias("id"))


@query(BULK_BFS)
def graph_bfs_batch(spark, d):
    """Twelve nodes around each pair of cases, breadth first, all walks at once; two steps hold more than the budget."""
    nodes, edges = _law_graph(spark, d)
    return walks.breadth_first_each(nodes, edges, _starts(spark, d), 12).withColumn("place", F.col("place").cast("long"))


@query()
def graph_dfs_batch(spark, d):
    """The same depth first: walks in order, which SQL doesn't say."""
    nodes, edges = _law_graph(spark, d)
    return walks.depth_first_each(nodes, edges, _starts(spark, d), 2, 12)


@query()
def graph_retrieve_batch(spark, d):
    """Seeds of every twentieth vector by search, walks over semantic edges and their context, all queries at once."""
    from statvine.plans.searching import semantic_topk_edges

    nodes = table(spark, d, "embeddings").select(F.concat(F.lit("idea:"), "vec_id").alias("id"), F.lit("idea").alias("type"), F.concat(F.lit("label "), "label").alias("label"), F.col("vec_id").alias("doc_id"))
    nodes = nodes.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "left").drop("doc_id")
    edges = semantic_topk_edges(spark, d).select(F.concat(F.lit("idea:"), "source").alias("source"), F.concat(F.lit("idea:"), "target").alias("target"), F.struct("source", "target").alias("ordinal"))
    found, _ = _cells(spark, d).search(_queries(spark, d), 10)
    seeds = found.select("query", F.col("rank").alias("place"), F.concat(F.lit("idea:"), "id").alias("id"))
    return walks.context_each(nodes, walks.breadth_first_each(nodes, stash(edges, "semantic"), seeds))
