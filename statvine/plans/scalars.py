"""Scalar functions applied to whole columns."""

from pyspark.sql import functions as F

from statvine.functions import citations as C
from statvine.functions import text as T
from statvine.functions.vectors import norm
from statvine.plans.registry import query
from statvine.sources.corpus import SQL, cases, chapters, chunks, table, versions

RAW_CHAPTER = "CASE chapter_id % 6 WHEN 0 THEN 'Chap. ' || chapter_number WHEN 1 THEN 'chapter ' || replace(chapter_number, ':', '-') WHEN 2 THEN replace(chapter_number, ':', ' ') WHEN 3 THEN 'chapter eight' WHEN 4 THEN chapter_number || ':' ELSE chapter_number END"
RAW_SECTION = "CASE chapter_id % 6 WHEN 0 THEN 'section ' || chapter_id || ' (3) (A)' WHEN 1 THEN 's. ' || chapter_id || 'a' WHEN 2 THEN 'ss ' || chapter_id || '(1)(B)(iv)' WHEN 3 THEN 'section twelve' WHEN 4 THEN chapter_id || '(' ELSE '' || chapter_id END"


_CHAPTER = r"^([0-9]{1,3})\s*[:/.\s-]\s*([0-9]{1,3})$"


@query(SQL + rf"""SELECT chapter_id, raw, CASE WHEN second <> '' THEN regexp_extract(bare, '{_CHAPTER}', 1)::INT::VARCHAR || ':' || CASE WHEN length(second) < 2 THEN lpad(second, 2, '0') ELSE second END END AS chapter
FROM (SELECT *, regexp_extract(bare, '{_CHAPTER}', 2) AS second FROM (SELECT chapter_id, raw, trim(regexp_replace(raw, '(?i)^\s*chap(ter)?\.?\s*', '')) AS bare FROM (SELECT *, {RAW_CHAPTER} AS raw FROM chapters)))""")
def normalize_chapter(spark, d):
    raw = chapters(spark, d).withColumn("raw", F.expr(RAW_CHAPTER))
    return raw.select("chapter_id", "raw", C.normalize_chapter(F.col("raw")).alias("chapter"))


_SECTION = r"^([0-9]+)([A-Za-z]?)((?:\([0-9A-Za-z]+\))*)$"


@query(SQL + rf"""SELECT chapter_id, raw, CASE WHEN regexp_extract(bare, '{_SECTION}', 1) <> '' THEN regexp_extract(bare, '{_SECTION}', 1)::BIGINT::VARCHAR || upper(regexp_extract(bare, '{_SECTION}', 2)) ||
array_to_string(list_transform(regexp_extract_all(regexp_extract(bare, '{_SECTION}', 3), '\([0-9A-Za-z]+\)'), lambda g: CASE WHEN regexp_matches(g, '^\([A-Za-z]+\)$') THEN lower(g) ELSE g END), '') END AS section
FROM (SELECT chapter_id, raw, regexp_replace(regexp_replace(raw, '(?i)^\s*(?:sections?|ss?)\.?\s*', ''), '\s+', '', 'g') AS bare FROM (SELECT *, {RAW_SECTION} AS raw FROM chapters))""")
def normalize_section(spark, d):
    raw = chapters(spark, d).withColumn("raw", F.expr(RAW_SECTION))
    return raw.select("chapter_id", "raw", C.normalize_section(F.col("raw")).alias("section"))


TITLE = "CASE WHEN chapter_id % 4 = 0 THEN '' WHEN chapter_id % 4 = 1 THEN title || '  Rules ' ELSE '  ' || title END"
_TITLE_SQL = r"CASE WHEN bare = '' THEN 'Title unavailable' WHEN regexp_matches(bare, '(?i)\b(Act|Code|Constitution|Ordinance|Order|Regulations|Rules)\s*$') THEN bare ELSE bare || ' Act' END"


@query(SQL + rf"SELECT chapter_id, {_TITLE_SQL} AS citation_title FROM (SELECT chapter_id, trim(regexp_replace({TITLE}, '\s+', ' ', 'g')) AS bare FROM chapters)")
def citation_title(spark, d):
    return chapters(spark, d).select("chapter_id", C.citation_title(F.expr(TITLE)).alias("citation_title"))


@query(SQL + rf"""SELECT download_id, l_suppkey, section_ref, chapter_number, title_ || ', ' || short || dated AS long_form, short AS short_form FROM (SELECT *, {_TITLE_SQL} AS title_,
'Chap. ' || chapter_number || ', s. ' || section_ref AS short, CASE WHEN download_id % 2 = 0 THEN ' (version available as at ' || strftime(as_at_date, '%-d %B %Y') || ')' ELSE '' END AS dated FROM (SELECT *, title AS bare FROM versions))""")
def format_citation(spark, d):
    long, short = C.format_citation(F.col("title"), F.col("chapter_number"), F.col("section_ref"), F.when(F.col("download_id") % 2 == 0, F.col("as_at_date")))
    return versions(spark, d).select("download_id", "l_suppkey", "section_ref", "chapter_number", long.alias("long_form"), short.alias("short_form"))


@query(SQL + r"SELECT chunk_id, CASE WHEN length(line) > 400 THEN line[1:400] || '…' ELSE line END AS snippet FROM (SELECT chunk_id, trim(regexp_replace(chunk_text, '\s+', ' ', 'g')) AS line FROM chunks)")
def snippet(spark, d):
    return chunks(spark, d).select("chunk_id", T.snippet(F.col("chunk_text")).alias("snippet"))


@query(SQL + r"""SELECT id, array_to_string(list_transform(list_filter(list_zip(terms, range(len(terms))), lambda x: list_position(terms, x[1]) = x[2] + 1), lambda x: x[1]), ' ') AS terms
FROM (SELECT id, list_filter(string_split_regex(lower(trim(title || ' ' || title)), '\s+'), lambda x: length(x) > 2) AS terms FROM cases)""")
def query_terms(spark, d):
    return cases(spark, d).select("id", F.array_join(T.query_terms(F.concat_ws(" ", "title", "title")), " ").alias("terms"))


@query(SQL + r"""SELECT chunk_id, CASE WHEN length(v) <= 620 THEN v ELSE (CASE WHEN s > 0 THEN '…' ELSE '' END) || trim(substring(v, s + 1, l - s)) || (CASE WHEN l < length(v) THEN '…' ELSE '' END) END AS excerpt FROM (
SELECT *, CASE WHEN e < length(v) AND back > 0 AND e + 1 - back > s THEN e + 1 - back ELSE e END AS l FROM (
SELECT *, CASE WHEN b > 0 AND blank > 0 AND b + blank - 1 < e THEN b + blank ELSE b END AS s, strpos(reverse(substring(v, 1, e + 1)), ' ') AS back FROM (
SELECT *, least(length(v), b + 620) AS e, strpos(substring(v, b + 1), ' ') AS blank FROM (
SELECT chunk_id, v, greatest(0, coalesce(list_min(list_filter([strpos(lower(v), 'threat') - 1, strpos(lower(v), 'password') - 1, strpos(lower(v), 'licen') - 1], lambda p: p >= 0)), 0) - 155) AS b FROM (SELECT chunk_id, trim(chunk_text) AS v FROM chunks)))))""")
def excerpt_around_query(spark, d):
    return chunks(spark, d).select("chunk_id", T.excerpt_around_query(F.col("chunk_text"), F.lit("threat of Password licen")).alias("excerpt"))


@query(SQL + r"""SELECT chunk_id, len(parts) AS n, len(list_filter(parts, lambda x: lower(x) IN ('the', 'and'))) AS matches, array_to_string(parts[1:5], '|') AS head
FROM (SELECT chunk_id, list_filter(string_split(regexp_replace(chunk_text, '(?i)(the|and)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts FROM chunks)""")
def highlight_segments(spark, d):
    parts = T.highlight_segments(F.col("chunk_text"), ["the", "and"])
    rows = chunks(spark, d).select("chunk_id", parts.alias("parts"))
    return rows.select("chunk_id", F.size("parts").cast("long").alias("n"), F.size(F.filter("parts", lambda x: x["match"])).cast("long").alias("matches"), F.array_join(F.transform(F.slice("parts", 1, 5), lambda x: x["text"]), "|").alias("head"))


@query(SQL + "SELECT chunk_id, coalesce(strftime(nullif(as_at_date, DATE '2000-01-01'), '%-d %b %Y'), 'Date unavailable') AS short, coalesce(strftime(nullif(as_at_date, DATE '2000-01-01'), '%-d %B %Y'), 'Date unavailable') AS long FROM chunks")
def format_date(spark, d):
    day = F.nullif(F.col("as_at_date"), F.lit("2000-01-01").cast("date"))
    return chunks(spark, d).select("chunk_id", T.format_date(day, "Date unavailable").alias("short"), T.format_date(day, "Date unavailable", long=True).alias("long"))


RAW_URL = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '' WHEN 2 THEN '/api/pdf/undefined' WHEN 3 THEN '#' ELSE '/api/pdf/' || page_id END"


@query(f"SELECT page_id, CASE WHEN u IS NULL OR u IN ('', '#') OR contains(u, '/undefined') OR contains(u, '/null') THEN NULL WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://example.org' || u END AS resolved FROM (SELECT page_id, {RAW_URL} AS u FROM pages)")
def resolve_url(spark, d):
    return table(spark, d, "pages").select("page_id", T.resolve_url(F.expr(RAW_URL), "https://example.org").alias("resolved"))


RAW_DATE = "CASE page_id % 4 WHEN 0 THEN '2016-12-31' WHEN 1 THEN '2016-13-01' WHEN 2 THEN '31 Dec 2016' ELSE '20' || lpad('' || page_id % 60, 2, '0') || '-02-' || (page_id % 9 + 20) END"


@query(f"SELECT page_id, CASE WHEN regexp_matches(r, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN try_cast(r AS DATE) END AS day FROM (SELECT page_id, {RAW_DATE} AS r FROM pages)")
def parse_iso_date(spark, d):
    return table(spark, d, "pages").select("page_id", C.parse_iso_date(F.expr(RAW_DATE)).alias("day"))


@query(SQL + "SELECT id, CASE WHEN trim(coalesce(title, '')) <> '' THEN title || ' (' || id || ')' ELSE id END AS label, coalesce(nullif(CASE WHEN year % 2 = 0 THEN '' ELSE 'https://court.example/' || id END, ''), '/api/cases/' || id) AS url, coalesce(year::VARCHAR, '') AS year FROM cases")
def case_summary(spark, d):
    source = F.when(F.col("year") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("https://court.example/"), "id"))
    label = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.concat(F.col("title"), F.lit(" ("), F.col("id"), F.lit(")"))).otherwise(F.col("id"))
    return cases(spark, d).select("id", label.alias("label"), F.coalesce(F.nullif(source, F.lit("")), F.concat(F.lit("/api/cases/"), "id")).alias("url"), F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("norm"))


REPLY = "CASE conv_id % 4 WHEN 0 THEN 'Sure: ' || body || ' end' WHEN 1 THEN 'no json' WHEN 2 THEN '{\"source_ids\":[\"x\"]}' ELSE body END"


@query("""SELECT conv_id, turn, json_extract_string(j, '$.answer') AS answer, len(coalesce(json_extract(j, '$.source_ids')::VARCHAR[], [])) AS n_sources, coalesce(len(json_extract(j, '$.source_ids')::VARCHAR[]) > 0 AND len(list_filter(json_extract(j, '$.source_ids')::VARCHAR[], lambda x: NOT list_contains(['chunk:0', 'chunk:1', 'chunk:2'], x))) = 0, false) AS grounded
FROM (SELECT conv_id, turn, nullif(regexp_extract(reply, '(?s)\\{.*\\}', 0), '') AS j FROM (SELECT conv_id, turn, %s AS reply FROM (SELECT *, '{"answer":"turn ' || turn || '","source_ids":["chunk:' || turn || '"]}' AS body FROM conversations)))""" % REPLY)
def parse_structured_reply(spark, d):
    body = F.concat(F.lit('{"answer":"turn '), F.col("turn"), F.lit('","source_ids":["chunk:'), F.col("turn"), F.lit('"]}'))
    rows = table(spark, d, "conversations").withColumn("body", body).withColumn("reply", F.expr(REPLY))
    parsed = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "answer string, source_ids array<string>")
    ids = F.coalesce(F.col("p.source_ids"), F.array().cast("array<string>"))
    grounded = (F.size(ids) > 0) & (F.size(F.array_except(ids, F.array(*map(F.lit, ("chunk:0", "chunk:1", "chunk:2"))))) == 0)
    return rows.select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", F.col("p.answer").alias("answer"), F.size(ids).cast("long").alias("n_sources"), grounded.alias("grounded"))


@query("SELECT role IN ('user', 'assistant') AND length(text) >= 1 AS valid, count(*) AS n FROM conversations GROUP BY ALL")
def validate_chat_rows(spark, d):
    return table(spark, d, "conversations").groupBy((F.col("role").isin("user", "assistant") & (F.length("text") >= 1)).alias("valid")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, substring(text, 1, 6000) AS text FROM documents")
def tool_text_cut(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tool_text(F.col("text")).alias("text"))
