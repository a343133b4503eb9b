"""Case citations by name, the text graph, walks over graphs with a budget, components and communities."""

from pyspark.sql import functions as F

from statvine.functions.vectors import cosine, dot
from statvine.operators import casework, communities as parts, graph, search, similarity, walks
from statvine.plans.graphs import GRAPH, _edges, _ideas, _prose
from statvine.plans.registry import query
from statvine.plans.searching import _embedded, _query_vector, semantic_topk_edges
from statvine.sources.corpus import SQL, cases, chapters, chunks, table, versions
from statvine.sources.shared import stash

#: A case's text names the title of every one of its lines, changed in two of three.
NAMED = "'By section 4 of the ' || CASE (o + line) % 3 WHEN 0 THEN title WHEN 1 THEN 'Old ' || title ELSE split_part(title, ' ', 2) END || ' Act, and Cap. ' || ((o + line) % 25 + 1) || ':0' || (o % 10)"
CASE_SQL = SQL + f""", texts AS (SELECT 'o' || o AS case_id, string_agg({NAMED}, '. ' ORDER BY line, title) AS text FROM (SELECT l_orderkey AS o, l_linenumber AS line, p_name AS title FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY o)
"""


def _texts(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("p_partkey"))
    named = lines.join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title")), "p_partkey").select("o", F.struct("line", "title", F.expr(NAMED).alias("said")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["said"]), ". ")
    return named.groupBy("o").agg(text.alias("text")).select(F.concat(F.lit("o"), "o").alias("case_id"), "text")


@query(CASE_SQL + r"""SELECT case_id, 'chapter:' || chapter AS target, 'medium' AS confidence, 'Ch. ' || chapter AS detail FROM (SELECT case_id, unnest(regexp_extract_all(text, '(?i)\b(?:Cap(?:ition)?\.|Ch(?:ap)?\.|Chapter)\s*([0-9]{1,2}:[0-9]{1,2})\b', 1)) AS chapter FROM texts)
WHERE chapter IN (SELECT chapter_number FROM chapters)""")
def cites_chapter_regex(spark, d):
    return casework.chapter_citations(_texts(spark, d), chapters(spark, d))


TITLES = CASE_SQL + r""", names AS (SELECT case_id, trim(z[1]) AS name, z[2] AS kind, regexp_replace(lower(z[1]), '[^a-z0-9]', '', 'g') AS norm FROM (SELECT case_id, unnest(list_zip(regexp_extract_all(text, '(?i)\bthe\s+([A-Z][A-Za-z\- ]{3,60}?)\s+(Act|Ordinance|Regulations?)\b', 1), regexp_extract_all(text, '(?i)\bthe\s+([A-Z][A-Za-z\- ]{3,60}?)\s+(Act|Ordinance|Regulations?)\b', 2))) AS z FROM texts)),
listed AS (SELECT DISTINCT regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title, chapter_number FROM chapters),
titles AS (SELECT title, min(chapter_number) AS first FROM listed GROUP BY title),
norms AS (SELECT DISTINCT norm FROM names),
pairs AS (SELECT norm, title, first FROM norms JOIN titles ON title = norm OR (norm NOT IN (SELECT title FROM titles) AND (contains(norm, title) OR contains(title, norm)))),
hits AS (SELECT norm, chapter_number, row_number() OVER (PARTITION BY norm ORDER BY first, title, chapter_number) AS nth, count(*) OVER (PARTITION BY norm) AS hits FROM pairs JOIN listed USING (title))
"""


@query(TITLES + """SELECT case_id, 'chapter:' || chapter_number AS target, CASE WHEN hits = 1 THEN 'high' ELSE 'low' END AS confidence, 'the ' || name || ' ' || kind AS detail FROM names JOIN hits USING (norm) WHERE nth <= 3""")
def cites_title_fuzzy(spark, d):
    return casework.title_citations(_texts(spark, d), chapters(spark, d))


CASE_EDGES = TITLES + r""", found AS (SELECT case_id, chapter, 0 AS place, 'REGEX' AS method, 'medium' AS confidence, 'Ch. ' || chapter AS detail FROM (SELECT case_id, unnest(regexp_extract_all(text, '(?i)\b(?:Cap(?:ition)?\.|Ch(?:ap)?\.|Chapter)\s*([0-9]{1,2}:[0-9]{1,2})\b', 1)) AS chapter FROM texts)
UNION ALL SELECT case_id, chapter, 1, 'REGEX', CASE WHEN regexp_matches(text, '(?i)\b(?:Cap(?:ition)?\.|Ch(?:ap)?\.|Chapter)\s*([0-9]{1,2}:[0-9]{1,2})\b') THEN 'high' ELSE 'medium' END, chapter FROM (SELECT case_id, text, unnest(regexp_extract_all(text, '(?is)(?:^|[^\p{L}\p{N}_])(?:act|ordinance|chapter|cap|ch)(?:[^\p{L}\p{N}_].{0,30}?)??\b([0-9]{1,2}:[0-9]{1,2})\b', 1)) AS chapter FROM texts)
UNION ALL SELECT case_id, chapter_number, 2, 'TITLE_MATCH', CASE WHEN hits = 1 THEN 'high' ELSE 'low' END, 'the ' || name || ' ' || kind FROM names JOIN hits USING (norm) WHERE nth <= 3),
cedges AS (SELECT 'case:' || case_id AS source, 'chapter:' || chapter AS target, 'CITES_STATUTE' AS type, 'EXTRACTED' AS evidence, method, arg_min(confidence, (place, detail)) AS confidence, arg_min(detail, (place, detail)) AS detail FROM found WHERE chapter IN (SELECT chapter_number FROM chapters) GROUP BY case_id, chapter, method)
"""


@query(CASE_EDGES + "SELECT * FROM cedges")
def case_edges(spark, d):
    return casework.case_edges(_texts(spark, d), chapters(spark, d))


@query(CASE_EDGES + """SELECT 'cases_loaded' AS what, '' AS name, count(*) AS n FROM texts UNION ALL SELECT 'case_nodes', '', count(DISTINCT source) FROM cedges UNION ALL SELECT 'edges', '', count(*) FROM cedges
UNION ALL SELECT 'confidence', confidence, count(*) FROM cedges GROUP BY ALL UNION ALL SELECT 'method', method, count(*) FROM cedges GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'target', target, count(*) AS n FROM cedges GROUP BY target ORDER BY n DESC, target LIMIT 15)""")
def case_report(spark, d):
    texts = _texts(spark, d)
    return casework.report(texts, stash(casework.case_edges(texts, chapters(spark, d)), "case-edges"))


LEAST = 0.3
#: The graph of the text: laws and sources as chapters, their sections as ideas, defined terms as concepts, pooled vectors.
TEXT_GRAPH = GRAPH + f""", pools AS (SELECT id, list(x ORDER BY pos) AS v FROM (SELECT 'idea:' || chapter_number || '|' || section_ref AS id, pos, avg(x) AS x FROM (SELECT chapter_number, section_ref, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM chunks JOIN embeddings ON chunk_id = vec_id) GROUP BY ALL) GROUP BY id),
sims AS (SELECT a.id AS source, b.id AS target, list_cosine_similarity(a.v, b.v) AS sim FROM pools a JOIN pools b ON a.id <> b.id),
gnodes AS (SELECT 'chapter:' || chapter_number AS id, 'chapter' AS type, title AS label, NULL::BIGINT AS n_ideas FROM chapters
UNION ALL SELECT DISTINCT 'chapter:' || chapter_number, 'chapter', chapter_number, NULL FROM ideas
UNION ALL SELECT id, 'idea', chapter_number || ' ' || section_ref, NULL FROM ideas
UNION ALL SELECT id, 'concept', term, n_ideas FROM concepts),
gedges AS (SELECT *, type || ' ' || source || ' ' || target || ' ' || detail AS ordinal FROM (
SELECT 'chapter:' || chapter_number AS source, id AS target, 'PART_OF' AS type, 'EXTRACTED' AS evidence, NULL::DOUBLE AS weight, 'statute' AS detail FROM ideas
UNION ALL SELECT source, target, 'SEMANTIC', 'INFERRED', round(sim, 4), 'embedding cosine' FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS r FROM sims) WHERE r <= 6 AND target > source AND sim >= {LEAST}
UNION ALL SELECT id, 'chapter:' || chapter, 'CROSS_REF', 'EXTRACTED', NULL, detail FROM refs WHERE chapter IN (SELECT chapter_number FROM chapters)
UNION ALL SELECT id, 'idea:' || chapter_number || '|' || other, 'CROSS_REF', 'EXTRACTED', NULL, 'section ' || other FROM named WHERE other <> section_ref AND 'idea:' || chapter_number || '|' || other IN (SELECT id FROM ideas)
UNION ALL SELECT ideas.id, concepts.id, 'MENTIONS', 'EXTRACTED', NULL, term FROM ideas JOIN concepts ON regexp_matches(ideas.text, '[“" ]' || term || '[”" ,.;:]'))),
drawn AS (SELECT g.*, coalesce(degree, 0) AS degree FROM gnodes g LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM gedges UNION ALL SELECT target FROM gedges) GROUP BY id) USING (id)
ORDER BY g.id IN (SELECT id FROM gnodes WHERE type = 'concept' ORDER BY n_ideas DESC, id LIMIT 30) DESC, degree DESC, id LIMIT 400),
drawn_edges AS (SELECT * FROM gedges WHERE type <> 'PART_OF' AND source IN (SELECT id FROM drawn) AND target IN (SELECT id FROM drawn) ORDER BY ordinal LIMIT 2500)
"""


def _text_graph(spark, d):
    """Nodes (id, type, label, text, n_ideas) and edges (source, target, type, evidence, weight, detail, ordinal) of the texts."""
    ideas = stash(graph.ideas(_prose(spark, d)), "ideas")
    concepts = stash(graph.concepts(ideas), "concepts")
    laws = chapters(spark, d)
    nodes = laws.select(F.concat(F.lit("chapter:"), "chapter_number").alias("id"), F.lit("chapter").alias("type"), F.col("title").alias("label"), F.col("title").alias("text"))
    sources = ideas.select(F.concat(F.lit("chapter:"), "chapter_number").alias("id"), F.lit("chapter").alias("type"), F.col("chapter_number").alias("label"), F.col("chapter_number").alias("text")).distinct()
    nodes = nodes.unionByName(sources).unionByName(ideas.select("id", F.lit("idea").alias("type"), "label", F.col("chunk_text").alias("text")))
    nodes = nodes.unionByName(concepts.select("id", F.lit("concept").alias("type"), F.col("term").alias("label"), "text", "n_ideas"), allowMissingColumns=True)
    near = similarity.nearest(_pooled(spark, d), 6, LEAST)
    edges = graph.part_of(ideas).unionByName(graph.semantic(near)).unionByName(graph.chapter_references(ideas, laws)).unionByName(graph.section_references(ideas)).unionByName(graph.mentions(ideas, concepts))
    return nodes, edges.withColumn("ordinal", F.concat_ws(" ", "type", "source", "target", "detail"))


def _pooled(spark, d):
    """id, embedding of every idea that has vectors: their mean over all versions."""
    rows = chunks(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    return similarity.pooled(rows.select(graph.idea_id().alias("id"), "embedding"), "id")


@query(TEXT_GRAPH + "SELECT * FROM gnodes")
def graph_nodes(spark, d):
    return _text_graph(spark, d)[0].select("id", "type", "label", "n_ideas")


@query(TEXT_GRAPH + "SELECT source, target, type, evidence, weight, detail FROM gedges")
def graph_edges(spark, d):
    return _text_graph(spark, d)[1].drop("ordinal")


@query(TEXT_GRAPH + "SELECT 'node' AS what, type, count(*) AS n FROM gnodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM gedges GROUP BY type UNION ALL SELECT 'evidence', evidence, count(*) FROM gedges GROUP BY evidence")
def graph_audit_counts(spark, d):
    return graph.audit(*_text_graph(spark, d))


@query(TEXT_GRAPH + r""", made AS (SELECT * FROM gnodes WHERE type IN ('chapter', 'concept') UNION ALL SELECT * FROM (SELECT * FROM gnodes WHERE type = 'idea' ORDER BY id LIMIT (SELECT greatest(0, 2000 - count(*)) FROM gnodes WHERE type = 'chapter')))
SELECT 'node' AS kind, 'CREATE (n:`' || upper(type) || '` {id:"' || id || '", label:"' || substring(replace(replace(label, '\', ' '), '"', ''''), 1, 80) || '"});' AS statement FROM made
UNION ALL SELECT 'edge', 'MATCH (a {id:"' || source || '"}),(b {id:"' || target || '"}) CREATE (a)-[:' || type || ' {evidence:"' || evidence || '"}]->(b);' FROM gedges WHERE source IN (SELECT id FROM made) AND target IN (SELECT id FROM made)""")
def export_cypher(spark, d):
    return graph.cypher(*_text_graph(spark, d))


@query(TEXT_GRAPH + "SELECT id, n_ideas FROM gnodes WHERE type = 'concept' ORDER BY n_ideas DESC, id LIMIT 30")
def top_concepts(spark, d):
    return graph.concepts(_ideas(spark, d)).select("id", "n_ideas").orderBy(F.desc("n_ideas"), "id").limit(30)


@query(TEXT_GRAPH + "SELECT id, type, degree FROM drawn")
def viz_subgraph(spark, d):
    return walks.drawn_nodes(*_text_graph(spark, d)).select("id", "type", "degree")


@query(TEXT_GRAPH + """SELECT 'node' AS kind, '{"id":"' || id || '","type":"' || type || '","degree":' || degree || '}' AS json FROM drawn
UNION ALL SELECT 'link', '{"source":"' || source || '","target":"' || target || '","type":"' || type || '"}' FROM drawn_edges""")
def export_viz_json(spark, d):
    """What a force-directed drawing reads, one JSON object a row."""
    nodes, edges = _text_graph(spark, d)
    chosen = walks.drawn_nodes(nodes, edges)
    links = walks.drawn_edges(edges, chosen)
    return chosen.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "type", "degree")).alias("json")).unionByName(links.select(F.lit("link").alias("kind"), F.to_json(F.struct("source", "target", "type")).alias("json")))


def _law_graph(spark, d):
    """Cases and the chapters they cite."""
    nodes = cases(spark, d).select(F.concat(F.lit("case:"), "id").alias("id"), F.lit("case").alias("type"), F.col("title").alias("label"), F.col("title").alias("text"))
    nodes = nodes.unionByName(chapters(spark, d).select(F.concat(F.lit("chapter:"), "chapter_number").alias("id"), F.lit("chapter").alias("type"), F.col("title").alias("label"), F.col("title").alias("text")))
    return nodes, _edges(spark, d).withColumn("ordinal", F.concat_ws(" ", "source", "target"))


SEEDS = ["case:o1", "case:o2", "case:o3"]
BFS = GRAPH + """, near AS (SELECT source, target, source || ' ' || target AS ordinal FROM edges UNION ALL SELECT target, source, source || ' ' || target FROM edges),
s AS (SELECT unnest(['case:o1', 'case:o2', 'case:o3']) AS id, unnest([0, 1, 2]) AS place),
l1 AS (SELECT target AS id, 3 + row_number() OVER (ORDER BY min((place, ordinal))) - 1 AS place FROM near JOIN s ON source = id WHERE target NOT IN (SELECT id FROM s) GROUP BY target),
l2 AS (SELECT target AS id, (SELECT max(place) FROM l1) + row_number() OVER (ORDER BY min((place, ordinal))) AS place FROM near JOIN l1 ON source = id WHERE target NOT IN (SELECT id FROM s UNION ALL SELECT id FROM l1) GROUP BY target),
walk AS (SELECT id, place::BIGINT AS place FROM (SELECT * FROM s UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2) WHERE place < 40)
"""


@query(BFS + "SELECT * FROM walk")
def graph_bfs(spark, d):
    """Forty nodes around three cases, breadth first; two steps hold more than the budget."""
    nodes, edges = _law_graph(spark, d)
    return walks.context(nodes, walks.breadth_first(nodes, edges, SEEDS)).select("id", "place")


@query(BFS + "SELECT place, walk.id, CASE WHEN walk.id LIKE 'case:%' THEN 'case' ELSE 'chapter' END AS type, coalesce(cases.title, chapters.title) AS label, substring(coalesce(cases.title, chapters.title), 1, 900) AS text FROM walk LEFT JOIN cases ON walk.id = 'case:' || cases.id LEFT JOIN chapters ON walk.id = 'chapter:' || chapter_number")
def graph_context(spark, d):
    nodes, edges = _law_graph(spark, d)
    return walks.context(nodes, walks.breadth_first(nodes, edges, SEEDS))


@query()
def graph_dfs(spark, d):
    """The same cases depth first, two steps deep: a walk in order, which SQL doesn't say."""
    nodes, edges = _law_graph(spark, d)
    return walks.context(nodes, walks.depth_first(nodes, edges, SEEDS)).select("id", "place")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS chunk_id, round(list_inner_product(embedding::DOUBLE[], q) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10""")
def vector_seed(spark, d):
    """Ten seeds by dot product of the query with vectors of length one."""
    q = F.array(*(F.lit(x) for x in _query_vector(spark, d)))
    score = F.round(F.try_divide(dot(F.col("embedding"), q), F.sqrt(dot(F.col("embedding"), F.col("embedding")))), 6)
    return _embedded(spark, d).select("chunk_id", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "chunk_id").limit(10)


@query()
def graph_retrieve(spark, d):
    """Seeds by vector, a walk over semantic edges, and the context: a walk of unknown length, which SQL doesn't say."""
    nodes = table(spark, d, "embeddings").select(F.concat(F.lit("idea:"), "vec_id").alias("id"), F.lit("idea").alias("type"), F.concat(F.lit("label "), "label").alias("label"), F.col("vec_id").alias("doc_id"))
    nodes = nodes.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "left").drop("doc_id")
    edges = semantic_topk_edges(spark, d).select(F.concat(F.lit("idea:"), "source").alias("source"), F.concat(F.lit("idea:"), "target").alias("target"), F.struct("source", "target").alias("ordinal"))
    seeds = [f"idea:{r['chunk_id']}" for r in vector_seed(spark, d).collect()]  # ten rows
    return walks.context(nodes, walks.breadth_first(nodes, parts.stash(edges, "semantic"), seeds))


NEAR = """WITH RECURSIVE sims AS (SELECT a.vec_id AS i, b.vec_id AS j, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
near AS (SELECT i AS source, j AS target FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM sims) WHERE r <= 6 AND j > i AND sim >= 0.3),
sides AS (SELECT source, target FROM near UNION ALL SELECT target, source FROM near),
reach AS (SELECT source AS id, source AS other FROM sides UNION SELECT id, target FROM reach JOIN sides ON other = source)
"""


@query(NEAR + "SELECT id, min(other) AS component FROM reach GROUP BY id")
def connected_components(spark, d):
    return parts.connected_components(stash(semantic_topk_edges(spark, d), "semantic"))  # read twice


def _clusters(spark, d):
    """cluster, size, chapter_number, section_ref, heading, label of every idea."""
    nodes, edges = _text_graph(spark, d)
    ideas = stash(graph.ideas(_prose(spark, d)), "ideas").select("id", "chapter_number", "section_ref", "heading", "label")
    found = parts.communities(ideas, stash(parts.idea_edges(edges), "idea-edges"))
    return parts.numbered(found).join(ideas, "id")


@query()
def communities(spark, d):
    """Every idea in its cluster, the largest first; SEMANTIC and CROSS_REF edges tie ideas, and those without any stand alone.

    SQL doesn't say how many unions it takes.
    """
    return _clusters(spark, d)


@query(GRAPH + "SELECT chapter_number, count(*) AS members, count(DISTINCT id) AS ideas FROM ideas GROUP BY chapter_number")
def community_members(spark, d):
    """How many ideas of each chapter some cluster holds: all of them, once."""
    return _clusters(spark, d).groupBy("chapter_number").agg(F.count("*").alias("members"), F.count_distinct("id").alias("ideas"))


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS similarity FROM embeddings""")
def cosine_similarity(spark, d):
    q = F.array(*(F.lit(x) for x in _query_vector(spark, d)))
    return table(spark, d, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), q), 5).alias("similarity"))


@query(SQL + "SELECT chapter_number, section_ref, string_agg(url, ',' ORDER BY as_at_date DESC, download_id DESC) AS urls, arg_max(url, (as_at_date, download_id)) AS latest_url FROM (SELECT *, CASE WHEN download_id = 0 THEN '' ELSE '/api/pdf/' || download_id END AS url FROM versions) GROUP BY ALL")
def nested_pdf_url(spark, d):
    """The list of a provision's versions, each with its address."""
    from statvine.functions.text import pdf_url

    rows = versions(spark, d).groupBy("chapter_number", "section_ref").agg(F.reverse(F.array_sort(F.collect_list(F.struct("as_at_date", "download_id")))).alias("versions"))
    rows = rows.withColumn("versions", F.transform("versions", lambda x: x.withField("pdf_url", pdf_url(x["download_id"]))))
    return rows.select("chapter_number", "section_ref", F.array_join(F.transform("versions", lambda x: x["pdf_url"]), ",").alias("urls"), F.col("versions")[0]["pdf_url"].alias("latest_url"))


@query(SQL + "SELECT download_id, l_suppkey, section_ref, chapter_number, 'lookup:' || download_id || ':' || (row_number() OVER (PARTITION BY download_id ORDER BY section_ref::INT, chapter_number, l_suppkey, l_extendedprice) - 1) AS source_id, coalesce(as_at_date::VARCHAR, '') AS date, CASE WHEN download_id = 0 THEN '' ELSE '/api/pdf/' || download_id END AS pdf_url FROM versions")
def source_struct(spark, d):
    """The record of where a shown text is from, as one struct, taken apart here."""
    from pyspark.sql import Window

    from statvine.functions.text import pdf_url

    nth = F.row_number().over(Window.partitionBy("download_id").orderBy(F.col("section_ref").cast("int"), "chapter_number", "l_suppkey", "l_extendedprice")) - 1
    record = F.struct(F.concat_ws(":", F.lit("lookup"), "download_id", nth).alias("source_id"), F.coalesce(F.col("as_at_date").cast("string"), F.lit("")).alias("date"), pdf_url(F.col("download_id")).alias("pdf_url"))
    return versions(spark, d).select("download_id", "l_suppkey", "section_ref", "chapter_number", record.alias("source")).select("download_id", "l_suppkey", "section_ref", "chapter_number", "source.*")


@query("""SELECT conv_id, turn, CASE WHEN turn >= 8 THEN 'error' WHEN role = 'system' THEN 'ok' WHEN conv_id % 4 = 1 THEN 'refused' WHEN conv_id % 4 = 2 THEN 'refused' ELSE 'ok' END AS status FROM conversations""")
def agent_decision(spark, d):
    """What becomes of a reply, by the turns spent, the sources collected and those it names: conversations as scripted turns."""
    from statvine.functions.replies import decide

    rows = table(spark, d, "conversations")
    ids = F.array(F.concat(F.lit("chunk:"), "turn"))
    collected = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(ids)
    good = F.to_json(F.struct(F.lit("x").alias("answer"), ids.alias("source_ids")))
    reply = F.when(F.col("conv_id") % 4 == 1, "no json").when(F.col("conv_id") % 4 == 2, '{"answer":"x","source_ids":["chunk:none"]}').otherwise(F.concat(F.lit("So: "), good))
    return rows.select("conv_id", "turn", decide(reply, collected, F.col("turn")).alias("status"))
