"""Laws by structure, files written and read back, SQL table functions, records and states of the tools."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from statvine.functions.text import pdf_url
from statvine.operators import graph, sqltools, structure, tools
from statvine.plans.asking import WRITTEN, _library
from statvine.plans.registry import ORACLES, query
from statvine.plans.walks import CASE_EDGES, TEXT_GRAPH, _text_graph, _texts
from statvine.sources import files
from statvine.sources.corpus import SQL, cases, chapters, chunks, table
from statvine.sources.shared import shared_dir

#: Each document as a law of two parts and two schedules, the same for both engines; its own lines stand in the second section.
LAW = r"""'# Law ' || doc_id || chr(10) || 'PART I' || chr(10) || '## 1. Short title' || chr(10) || 'This is law ' || doc_id || '.' || chr(10) || '2A. Text' || chr(10) || coalesce(text, '') || chr(10) || 'PART II — Penalties' || chr(10) || '12. Fines' || chr(10) || '(1) A fine.' || chr(10) || 'FIRST SCHEDULE' || chr(10) || '1. Fees' || chr(10) || lang || chr(10) || 'SECOND SCHEDULE' || chr(10) || 'Repealed'"""
STRUCTURE = rf"""WITH law AS (SELECT doc_id, string_split({LAW}, chr(10)) AS lines FROM documents),
one AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth FROM law),
kinds AS (SELECT *, nullif(regexp_extract(line, '^[#* ]*PART +([IVXLC]+|[0-9]+[A-Z]?)\b[ *.:—-]*([^*\r]*?)[* \r]*$', 1), '') AS a_part, nullif(trim(regexp_extract(line, '^[#* ]*PART +([IVXLC]+|[0-9]+[A-Z]?)\b[ *.:—-]*([^*\r]*?)[* \r]*$', 2)), '') AS part_heading,
    coalesce(nullif(regexp_extract(line, '^[#* ]*((?:[A-Z]+ )?SCHEDULE(?: [IVXLC]+| [0-9]+)?)[* \r]*$', 1), ''), nullif(upper(regexp_extract(line, '(?i)^#+ *((?:[a-z]+ )?schedule(?: [ivxlc]+| [0-9]+)?)[* \r]*$', 1)), '')) AS a_schedule FROM one),
outers AS (SELECT *, last_value(CASE WHEN a_part IS NOT NULL THEN struct_pack(part := a_part, heading := part_heading, schedule := NULL::VARCHAR) WHEN a_schedule IS NOT NULL THEN struct_pack(part := NULL::VARCHAR, heading := NULL::VARCHAR, schedule := a_schedule) END IGNORE NULLS) OVER w AS o, a_part IS NOT NULL OR a_schedule IS NOT NULL AS turn FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING)),
sections AS (SELECT *, CASE WHEN NOT turn AND o.schedule IS NULL THEN nullif(regexp_extract(line, '^[#* ]*([0-9]+[A-Z]?)\.(?:[* ]+([^*\r]*?))?[* \r]*$', 1), '') END AS a_section, nullif(trim(regexp_extract(line, '^[#* ]*([0-9]+[A-Z]?)\.(?:[* ]+([^*\r]*?))?[* \r]*$', 2)), '') AS section_heading FROM outers),
inners AS (SELECT *, last_value(CASE WHEN turn THEN struct_pack(section := NULL::VARCHAR, heading := NULL::VARCHAR) WHEN a_section IS NOT NULL THEN struct_pack(section := a_section, heading := section_heading) END IGNORE NULLS) OVER w AS i, count(*) FILTER (turn OR a_section IS NOT NULL) OVER w AS chunk FROM sections WINDOW w AS (PARTITION BY doc_id ORDER BY nth ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT doc_id, chunk, any_value(o.part) AS part, any_value(o.schedule) AS schedule, coalesce(any_value(i.section), any_value(o.schedule), '') AS section_ref, coalesce(CASE WHEN any_value(i.section) IS NOT NULL THEN any_value(i.heading) ELSE any_value(o.heading) END, '') AS heading, string_agg(line, chr(10) ORDER BY nth) AS text, count(*) AS n FROM inners WHERE chunk > 0 GROUP BY doc_id, chunk)
"""


@query(STRUCTURE + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS chunk_index, part, schedule, section_ref, heading, length(text) AS chars, md5(text) AS digest FROM whole WHERE section_ref <> '' OR n > 1")
def law_structure(spark, d):
    """Sections and schedules of laws, by what their lines announce."""
    laws = table(spark, d, "documents").select("doc_id", F.expr(LAW.replace("chr(10)", "'\\n'")).alias("text"))
    rows = structure.chunked(laws, "doc_id")
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "part", "schedule", "section_ref", "heading", F.length("chunk_text").cast("long").alias("chars"), F.md5("chunk_text").alias("digest"))


def _folder(spark, name):
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query(TEXT_GRAPH + """SELECT (SELECT count(*) FROM gnodes) AS nodes, (SELECT count(*) FROM gedges) AS edges, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM gnodes GROUP BY type)) AS node_types,
(SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM gedges GROUP BY type)) AS edge_types, (SELECT string_agg(evidence || '=' || n, ',' ORDER BY evidence) FROM (SELECT evidence, count(*) AS n FROM gedges GROUP BY evidence)) AS evidence""")
def graph_meta(spark, d):
    """The graph's files written, and what their ``meta`` says."""
    nodes, edges = _text_graph(spark, d)
    path = _folder(spark, "graph")
    files.write_graph(nodes, edges, path)
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias(c)
    return files.read_meta(spark, path).select("nodes", "edges", told("node_types"), told("edge_types"), told("evidence"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN '' || o_orderkey ELSE 'r' || o_orderkey END AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS title, 'text ' || o_orderstatus AS body FROM orders WHERE o_orderkey % 7 <> 0")
def read_case_files(spark, d):
    """Case records of two dialects written as JSON lines into a folder, with broken lines between, and read from it."""
    k = F.col("o_orderkey")
    one = F.struct(F.when(k % 2 == 0, k.cast("string")).alias("id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("title"), F.concat(F.lit("text "), "o_orderstatus").alias("body"))
    other = F.struct(F.concat(F.lit("r"), k).alias("record_id"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("title"), F.concat(F.lit("text "), "o_orderstatus").alias("text"))
    line = F.when(k % 7 == 0, F.lit("{broken")).when(k % 2 == 0, F.to_json(one)).otherwise(F.to_json(other))
    path = _folder(spark, "cases")
    table(spark, d, "orders").select(line.alias("value")).write.format("text").save(f"{path}/as-text")
    return files.read_cases(spark, f"{path}/as-text", "*.txt")


CASE_NODES = CASE_EDGES + """, known AS (SELECT 'case:' || id AS id, 'case' AS type, title AS label FROM cases WHERE (substring(id, 2)::BIGINT) % 3 <> 0)
"""


@query(CASE_NODES + "SELECT id, type, label FROM known UNION ALL SELECT source, 'case', source FROM cedges WHERE source NOT IN (SELECT id FROM known) GROUP BY source")
def case_nodes(spark, d):
    """Cases that only citations name become nodes; here every third has no record."""
    from statvine.operators import casework

    known = cases(spark, d).where("cast(substring(id, 2) as bigint) % 3 <> 0").select(F.concat(F.lit("case:"), "id").alias("id"), F.lit("case").alias("type"), F.col("title").alias("label"), F.col("title").alias("text"))
    edges = casework.case_edges(_texts(spark, d), chapters(spark, d))
    return graph.with_case_nodes(known, edges).select("id", "type", "label")


@query(CASE_EDGES + """SELECT id, title, year, confidence, row_number() OVER (ORDER BY CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, year DESC, id) AS place FROM
(SELECT source, min_by(confidence, CASE confidence WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) AS confidence FROM cedges WHERE target = 'chapter:1:05' GROUP BY source) JOIN cases ON source = 'case:' || id ORDER BY place LIMIT 20""")
def citing_cases_ranked(spark, d):
    """The cases that cite a chapter: the surest first, then the newest."""
    from statvine.operators import casework

    edges = casework.case_edges(_texts(spark, d), chapters(spark, d)).where("target = 'chapter:1:05'")
    found = casework.by_confidence(edges, cases(spark, d)).limit(20)
    order = [F.col("sure"), F.desc("year"), F.col("id")]
    return found.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).select("id", "title", "year", "confidence", "place")  # over 20 rows


@query(SQL + "SELECT 'chunk:' || chunk_id AS source_id, 'statute' AS kind, coalesce(title, '') AS title, c.chapter_number AS chapter, section_ref AS section, coalesce(as_at_date::VARCHAR, '') AS date, CASE WHEN coalesce(download_id, 0) <> 0 THEN '/api/pdf/' || download_id ELSE '' END AS pdf_url FROM chunks c LEFT JOIN chapters USING (chapter_number)")
def source_record(spark, d):
    """The record of where a shown text is from, all seven fields."""
    rows = chunks(spark, d).join(chapters(spark, d).select("chapter_number", "title"), "chapter_number", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    record = F.struct(F.concat(F.lit("chunk:"), "chunk_id").alias("source_id"), F.lit("statute").alias("kind"), text("title").alias("title"), text("chapter_number").alias("chapter"), text("section_ref").alias("section"), text("as_at_date").alias("date"), pdf_url(F.col("download_id")).alias("pdf_url"))
    return rows.select(record.alias("source")).select("source.*")


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'unconfigured' WHEN conv_id % 5 = 1 AND turn > 0 THEN 'error' WHEN turn >= 8 THEN 'error' WHEN role = 'system' THEN 'ok' WHEN conv_id % 4 = 1 THEN 'refused' WHEN conv_id % 4 = 2 THEN 'refused' ELSE 'ok' END AS status FROM conversations""")
def agent_states(spark, d):
    """All that can become of a reply: no key, a model that fails, too many rounds, no or unknown sources, grounded."""
    from statvine.functions.replies import decide

    rows = table(spark, d, "conversations")
    ids = F.array(F.concat(F.lit("chunk:"), "turn"))
    collected = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(ids)
    good = F.to_json(F.struct(F.lit("x").alias("answer"), ids.alias("source_ids")))
    reply = F.when(F.col("conv_id") % 4 == 1, "no json").when(F.col("conv_id") % 4 == 2, '{"answer":"x","source_ids":["chunk:none"]}').otherwise(F.concat(F.lit("So: "), good))
    kind = F.col("conv_id") % 5
    return rows.select("conv_id", "turn", decide(reply, collected, F.col("turn"), kind != 0, (kind == 1) & (F.col("turn") > 0)).alias("status"))


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN mode IS NULL OR NOT regexp_full_match(mode, 'fts|hybrid|vector') THEN 'mode' END, CASE WHEN chat IS NULL OR NOT regexp_full_match(chat, 'research|precedent') THEN 'chat_mode' END,
CASE WHEN status IS NULL OR NOT regexp_full_match(status, 'ok|refused|error|unconfigured') THEN 'status' END, CASE WHEN lim IS NULL OR lim < 1 OR lim > 100 THEN 'limit' END, CASE WHEN off IS NULL OR off < 0 THEN 'offset' END], lambda x: x IS NOT NULL), ',') AS wrong
FROM (SELECT page_id, ['fts', 'hybrid', 'vector', 'FTS', 'ftsx'][page_id % 5 + 1] AS mode, ['research', 'precedent', '', NULL][page_id % 4 + 1] AS chat, ['ok', 'refused', 'error', 'unconfigured', 'okay', 'unknown'][page_id % 6 + 1] AS status, page_id % 120 AS lim, page_id % 7 - 1 AS off FROM pages)""")
def validate_requests(spark, d):
    """Which parameters of a request break a rule."""
    from statvine.functions.replies import broken_rules

    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % len(values)).cast("int"))
    rows = table(spark, d, "pages").select("page_id", pick(["fts", "hybrid", "vector", "FTS", "ftsx"]).alias("mode"), pick(["research", "precedent", "", None]).alias("chat_mode"), pick(["ok", "refused", "error", "unconfigured", "okay", "unknown"]).alias("status"), (F.col("page_id") % 120).alias("limit"), (F.col("page_id") % 7 - 1).alias("offset"))
    return rows.select("page_id", F.array_join(broken_rules(), ",").alias("wrong"))


def _by_sql(spark, d, call: str, lib=None):
    sqltools.register(spark, lib or _library(spark, d))
    return spark.sql(f"SELECT cast(place AS BIGINT) AS place, source_id, chapter, url, line FROM {call}")


@query(ORACLES["tool_lookup_section"])
def sql_lookup_section(spark, d):
    return _by_sql(spark, d, "lookup_section('src0', '10')")


@query(ORACLES["tool_citing_cases"])
def sql_citing_cases(spark, d):
    return _by_sql(spark, d, "citing_cases('Chap. 1:5')")


@query(ORACLES["tool_expand_case"])
def sql_expand_case(spark, d):
    return _by_sql(spark, d, "expand_case('case:o1')")


@query(ORACLES["tool_list_chapters"])
def sql_list_chapters(spark, d):
    return _by_sql(spark, d, "list_chapters('bolt')")


@query(ORACLES["tool_search_cases"])
def sql_search_cases(spark, d):
    return _by_sql(spark, d, "search_cases('urgent')")


@query(ORACLES["tool_resolve_citation"])
def sql_resolve_citation(spark, d):
    lib = _library(spark, d)
    written = lib.chunks.withColumn("chapter_number", F.expr(WRITTEN))
    return _by_sql(spark, d, "resolve_citation('Chap. 90:0', 's. 77')", tools.Library(lib.chapters, written, lib.cases, lib.citations))


@query(ORACLES["tool_search_provisions"])
def sql_search_provisions(spark, d):
    return _by_sql(spark, d, "search_provisions('that with', '', '2008-01-01')")
