"""Search and vector queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from statvine.operators import search, similarity
from statvine.operators.textindex import TextIndex
from statvine.plans.graphs import GRAPH, _prose
from statvine.plans.registry import query
from statvine.sources.corpus import SQL, chapters, chunks, table

WORDS = "that with"
FTS = SQL + """, terms AS (SELECT chunk_id, list_filter(string_split_regex(lower(chunk_text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM chunks),
tf AS (SELECT chunk_id, len(t) AS size, term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM terms) WHERE term IN ('that', 'with') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
fts AS (SELECT chunk_id, round(sum(tf * ln(1 + (SELECT count(*) FROM chunks) / df) / (1 + ln(size))), 6) AS score FROM tf JOIN df USING (term) GROUP BY chunk_id HAVING count(*) = 2),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], q) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_inner_product(q, q)), 6) AS score FROM embeddings, q)
"""


def _embedded(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]]


@query(FTS + "SELECT * FROM fts")
def search_fts(spark, d):
    return search.fts(chunks(spark, d), WORDS)


@query(SQL + "SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(list_filter(string_split_regex(lower(chunk_text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM chunks) GROUP BY term")
def postings(spark, d):
    return search.postings(chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"))


@query(FTS + "SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM vec ORDER BY rank LIMIT 20")
def search_vector(spark, d):
    return search.ranked(search.vector(_embedded(spark, d), _query_vector(spark, d)), 20).withColumn("rank", F.col("rank").cast("long"))


@query(FTS + """, a AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM fts QUALIFY r <= 100), b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM vec QUALIFY r <= 100)
SELECT chunk_id, round(coalesce(1 / (60 + a.r), 0) + coalesce(1 / (60 + b.r), 0), 9) AS score FROM a FULL JOIN b USING (chunk_id)""")
def search_hybrid(spark, d):
    return search.fuse(search.fts(chunks(spark, d), WORDS), search.vector(_embedded(spark, d), _query_vector(spark, d)))


URL = "CASE WHEN download_id = 0 THEN '' ELSE '/api/pdf/' || download_id END"
GROUPED = FTS + f""", hits AS (SELECT * FROM chunks JOIN fts USING (chunk_id) WHERE as_at_date <= DATE '2010-01-01'),
top AS (SELECT chapter_number, section_ref, chunk_id AS matched_chunk, as_at_date AS matched_date, chunk_text AS matched_text, version_label AS matched_label, {URL} AS matched_url, score FROM hits QUALIFY row_number() OVER (PARTITION BY chapter_number, section_ref ORDER BY score DESC, as_at_date DESC, chunk_id) = 1),
by_key AS (SELECT chapter_number, section_ref, max(as_at_date) AS latest_date, arg_max({URL}, (as_at_date, download_id)) AS latest_url, string_agg(download_id || ' ' || as_at_date || ' ' || version_label || ' ' || {URL}, ',' ORDER BY as_at_date DESC, download_id DESC) AS versions FROM chunks WHERE as_at_date <= DATE '2010-01-01' GROUP BY ALL),
grouped AS (SELECT chapter_number || '::' || section_ref AS key, * FROM top JOIN by_key USING (chapter_number, section_ref))
"""


def _grouped(spark, d):
    rows = chunks(spark, d)
    return search.grouped(rows, search.fts(rows, WORDS), "2010-01-01", chapters(spark, d))


@query(GROUPED + "SELECT key, '' AS title, matched_chunk, matched_date, matched_text, matched_label, matched_url, score, latest_date, latest_url, versions FROM grouped")
def search_grouped(spark, d):
    listed = F.array_join(F.transform("versions", lambda x: F.concat_ws(" ", x["download_id"], x["as_at_date"], x["version_label"], x["pdf_url"])), ",")
    of = lambda c, name: F.col(f"matched_version.{c}").alias(f"matched_{name}")
    return _grouped(spark, d).select("key", "title", of("chunk_id", "chunk"), of("as_at_date", "date"), of("chunk_text", "text"), of("version_label", "label"), of("pdf_url", "url"), "score", F.col("latest_available.as_at_date").alias("latest_date"), F.col("latest_available.pdf_url").alias("latest_url"), listed.alias("versions"))


_INDEXES: dict[tuple, TextIndex] = {}


def _index(spark, d, english=False):
    """An index is stored once for all queries of an application over the same tables."""
    key = (spark.sparkContext.applicationId, d, english)
    if key not in _INDEXES:
        _INDEXES[key] = TextIndex.build(_prose(spark, d) if english else chunks(spark, d), english)
    return _INDEXES[key]


@query(FTS + "SELECT * FROM fts")
def search_fts_indexed(spark, d):
    """The same from the stored index, of which a query reads the row groups of its words."""
    return _index(spark, d).fts(WORDS)


PHRASE = "of the"


@query(SQL + f"""SELECT chunk_id, hits FROM (SELECT chunk_id, len(list_filter(generate_series(1, len(t) - 1), lambda i: t[i] = '{PHRASE.split()[0]}' AND t[i + 1] = '{PHRASE.split()[1]}')) AS hits
FROM (SELECT chunk_id, list_filter(string_split_regex(lower(chunk_text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM chunks)) WHERE hits > 0""")
def search_phrase(spark, d):
    """How often two words follow each other, by positions."""
    return _index(spark, d).phrase(PHRASE)


#: Words of the query's stems.
STEMMED = GRAPH + """, cut AS (SELECT chunk_id, list_filter(string_split_regex(lower(chunk_text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM prose),
tf AS (SELECT chunk_id, len(t) AS size, CASE WHEN term IN ('debtor', 'debtors') THEN 'debtor' ELSE term END AS stem, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM cut) WHERE term IN ('widget', 'debtor', 'debtors', 'pay') GROUP BY ALL),
df AS (SELECT stem, count(*) AS df FROM tf GROUP BY stem)
"""


@query(STEMMED + "SELECT chunk_id, round(sum(tf * ln(1 + (SELECT count(*) FROM chunks) / df) / (1 + ln(size))), 6) AS score FROM tf JOIN df USING (stem) GROUP BY chunk_id HAVING count(*) = 3")
def search_fts_english(spark, d):
    """Stems in place of words, and no stop words; ``debtor`` finds ``Debtors``."""
    return search.fts_english(_prose(spark, d), "the Widgets of a Debtor's paying")


@query(STEMMED + "SELECT chunk_id, round(sum(tf * ln(1 + (SELECT count(*) FROM chunks) / df) / (1 + ln(size))), 6) AS score FROM tf JOIN df USING (stem) GROUP BY chunk_id HAVING count(*) = 3")
def search_english_indexed(spark, d):
    return _index(spark, d, english=True).fts("the Widgets of a Debtor's paying")


@query(GROUPED + "SELECT key, score, place, (SELECT count(*) FROM grouped) > 30 AS has_more FROM (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) - 20 AS place FROM grouped) WHERE place BETWEEN 1 AND 10")
def paged_search(spark, d):
    page = search.page(_grouped(spark, d).select("key", "score"), [F.desc("score"), F.col("key")], 10, 20)
    return page.select("key", "score", F.col("place").cast("long").alias("place"), "has_more")


@query("SELECT label, pos, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 5) AS x FROM (SELECT label, pos, avg(v) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL)")
def vector_mean_pool(spark, d):
    pooled = similarity.pooled(table(spark, d, "embeddings").select("label", "embedding"), "label")
    return pooled.select(F.col("id").alias("label"), F.posexplode("embedding").alias("at", "x")).select("label", (F.col("at") + 1).cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query("""WITH s AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM s)
SELECT i AS source, j AS target, round(sim, 3) AS weight FROM t WHERE r <= 6 AND j > i AND sim >= 0.3""")
def semantic_topk_edges(spark, d, top: int = 6, least: float = 0.3):
    """The six nearest of each vector by cosine, kept where the target's id is larger."""
    near = similarity.nearest(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), top, least)
    return near.select("source", "target", F.round("weight", 3).alias("weight"))


@query("""WITH hit AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars, doc_id) AS r FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT count(DISTINCT item_id) FILTER (r <= 20) AS found, (SELECT count(*) FROM benchmark) AS items FROM hit""")
def recall_at_k(spark, d):
    """Of the benchmark's passages, how many some document holds among its first 20 hits.

    Passages and documents meet on a window of the passage, so only likely pairs are compared.
    """
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "text")
    pairs = search.holding(docs, items)
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("n_chars", "doc_id"))
    found = pairs.withColumn("r", nth).where("r <= 20").agg(F.count_distinct("item_id").alias("found"))
    return found.join(items.agg(F.count("*").alias("items")))
