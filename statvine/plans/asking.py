"""The tools an assistant calls, and expectations about looked-up texts."""

from pyspark.sql import functions as F

from statvine.operators import golden, temporal, tools
from statvine.plans.registry import query
from statvine.plans.searching import FTS, URL, WORDS
from statvine.sources.corpus import SQL, cases, chapters, chunks, citations


def _library(spark, d):
    return tools.Library(chapters(spark, d), chunks(spark, d), cases(spark, d), citations(spark, d))


def _lines(df):
    return df.select(F.col("place").cast("long").alias("place"), "source_id", "chapter", "url", "line")


CASE = "title || ' (' || id || ')'"
SNIP = r"trim(regexp_replace(chunk_text, '\s+', ' ', 'g'))"


@query(SQL + """SELECT row_number() OVER (ORDER BY chapter_number) - 1 AS place, 'chapter:' || chapter_number AS source_id, chapter_number AS chapter, '' AS url, 'Chap. ' || chapter_number || ' — ' || title AS line
FROM chapters WHERE title ILIKE '%bolt%' OR chapter_number ILIKE '%bolt%' ORDER BY place LIMIT 20""")
def tool_list_chapters(spark, d):
    return _lines(tools.list_chapters(_library(spark, d), "bolt"))


@query(SQL + f"""SELECT row_number() OVER (ORDER BY year DESC, id) - 1 AS place, id AS source_id, chapter_number AS chapter, '/api/cases/' || id AS url, {CASE} || ' cites Chap. ' || chapter_number AS line
FROM cases JOIN citations ON id = case_id WHERE chapter_number = '1:05' ORDER BY place LIMIT 20""")
def tool_citing_cases(spark, d):
    return _lines(tools.citing_cases(_library(spark, d), "Chap. 1:5"))


@query(SQL + f"""SELECT row_number() OVER (ORDER BY title, id) - 1 AS place, id AS source_id, '' AS chapter, '/api/cases/' || id AS url, {CASE} || ' (' || year || ')' AS line
FROM cases WHERE title ILIKE '%urgent%' ORDER BY place LIMIT 20""")
def tool_search_cases(spark, d):
    return _lines(tools.search_cases(_library(spark, d), "urgent"))


@query(SQL + f"""SELECT row_number() OVER (ORDER BY year DESC, id, chapter_number) - 1 AS place, id AS source_id, chapter_number AS chapter, '/api/cases/' || id AS url, {CASE} || ' cites Chap. ' || chapter_number AS line
FROM cases JOIN citations ON id = case_id WHERE case_id <> 'o1' AND chapter_number IN (SELECT chapter_number FROM citations WHERE case_id = 'o1') ORDER BY place LIMIT 20""")
def tool_expand_case(spark, d):
    return _lines(tools.expand_case(_library(spark, d), "case:o1"))


@query(SQL + f"""SELECT place, 'lookup:' || download_id || ':' || place AS source_id, chapter_number AS chapter, CASE WHEN download_id = 0 THEN '' ELSE '/api/pdf/' || download_id END AS url,
'Chap. ' || chapter_number || ', s. ' || section_ref || ' — ' || coalesce(nullif(version_label, ''), 'version') || ', available as at ' || as_at_date || chr(10) || '  ' || CASE WHEN length(t) > 400 THEN t[1:400] || '…' ELSE t END AS line
FROM (SELECT *, {SNIP} AS t, row_number() OVER (ORDER BY as_at_date DESC, download_id DESC, chunk_id) - 1 AS place FROM chunks WHERE chapter_number = 'src0' AND section_ref = '10') ORDER BY place""")
def tool_lookup_section(spark, d):
    return _lines(tools.lookup_section(_library(spark, d), "src0", "10"))


@query(SQL + """, newest AS (SELECT chapter_number || '|' || section_ref AS id, chunk_text AS text FROM chunks WHERE as_at_date <= DATE '2005-06-30' QUALIFY row_number() OVER (PARTITION BY chapter_number, section_ref ORDER BY as_at_date DESC, download_id DESC, chunk_id DESC) = 1),
keys AS (SELECT chapter_number || '|' || section_ref AS id, chapter_number || '|1' AS other FROM chunks GROUP BY ALL)
SELECT k.id, array_to_string(list_filter([CASE WHEN n.text IS NULL THEN 'should_exist' END, CASE WHEN NOT contains(coalesce(n.text, ''), ' ') THEN 'must_contain' END, CASE WHEN contains(coalesce(n.text, ''), 'password') THEN 'must_not_contain' END,
CASE WHEN length(coalesce(n.text, '')) < 200 THEN 'min_chars' END, CASE WHEN n.text IS NOT DISTINCT FROM o.text THEN 'differs_from' END], lambda x: x IS NOT NULL), ',') AS failed
FROM keys k LEFT JOIN newest n ON n.id = k.id LEFT JOIN newest o ON o.id = k.other""")
def golden_checks(spark, d):
    """Every provision on a day: there, with a blank, without a password, 200 characters, and not its chapter's first section."""
    rows = chunks(spark, d)
    key = F.concat_ws("|", "chapter_number", "section_ref")
    texts = temporal.as_of(rows.withColumn("chunk_index", F.col("chunk_id")), "2005-06-30").select(key.alias("id"), F.col("chunk_text").alias("text"))
    expected = rows.select(key.alias("id"), F.array(F.concat_ws("|", "chapter_number", F.lit("1"))).alias("differs_from")).distinct()
    none = F.lit(None).cast("array<string>")
    expected = expected.select("id", F.array(F.lit(" ")).alias("must_contain"), F.array(F.lit("password")).alias("must_not_contain"), F.lit(200).alias("min_chars"), F.lit(True).alias("should_exist"), "differs_from", none.alias("same_as"))
    return golden.check(expected, texts).select("id", F.array_join("failed", ",").alias("failed"))


VERSION = f"coalesce(nullif(version_label, ''), 'version') || ', available as at ' || as_at_date || chr(10) || '  ' || CASE WHEN length({SNIP}) > 400 THEN {SNIP}[1:400] || '…' ELSE {SNIP} END"


@query(FTS + f"""SELECT row_number() OVER (ORDER BY score DESC, key) - 1 AS place, 'chunk:' || chunk_id AS source_id, chapter_number AS chapter, {URL} AS url, 'Chap. ' || chapter_number || ', s. ' || section_ref || ' — ' || {VERSION} AS line
FROM (SELECT *, chapter_number || '::' || section_ref AS key FROM chunks JOIN fts USING (chunk_id) WHERE as_at_date <= DATE '2008-01-01' QUALIFY row_number() OVER (PARTITION BY chapter_number, section_ref ORDER BY score DESC, as_at_date DESC, chunk_id) = 1) ORDER BY place LIMIT 5""")
def tool_search_provisions(spark, d):
    return _lines(tools.search_provisions(_library(spark, d), WORDS, date="2008-01-01"))


#: Sources as chapters 90:00 on, so that citations can be written.
WRITTEN = "'90:' || lpad(substring(chapter_number, 4), 2, '0')"


@query(SQL + f"""SELECT row_number() OVER (ORDER BY abs(section_ref::INT - 77), section_ref, chunk_id) AS place, 'chunk:' || chunk_id AS source_id, ch AS chapter, {URL} AS url, 'near: Chap. ' || ch || ', s. ' || section_ref AS line
FROM (SELECT *, {WRITTEN} AS ch FROM chunks WHERE {WRITTEN} = '90:00' QUALIFY row_number() OVER (PARTITION BY section_ref ORDER BY as_at_date DESC, download_id DESC) = 1) ORDER BY place LIMIT 5""" .replace("SELECT row_number", "SELECT 0 AS place, '' AS source_id, '' AS chapter, '' AS url, 'Citation status: not_found for Chap. 90:00, s. 77.' AS line UNION ALL SELECT * FROM (SELECT row_number", 1) + ")")
def tool_resolve_citation(spark, d):
    """A section that isn't there, with its status and the nearest ones."""
    lib = _library(spark, d)
    written = lib.chunks.withColumn("chapter_number", F.expr(WRITTEN))
    return _lines(tools.resolve_citation(tools.Library(lib.chapters, written, lib.cases, lib.citations), "Chap. 90:0", "s. 77"))
