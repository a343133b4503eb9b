"""Listing, dated lookup, resolution, statistics and checks."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statvine.functions.text import authority_label, pdf_url, version_label
from statvine.operators import temporal
from statvine.plans.registry import query
from statvine.sources.corpus import SQL, chapters, chunks, citations, table, versions

DATE = "1998-06-30"
ORDER = "as_at_date DESC NULLS LAST, download_id DESC, l_suppkey DESC, l_extendedprice DESC"
AS_OF = f"SELECT * FROM versions WHERE as_at_date <= DATE '{DATE}' QUALIFY row_number() OVER (PARTITION BY chapter_number, section_ref ORDER BY {ORDER}) = 1"
URL = "CASE WHEN coalesce(download_id, 0) <> 0 THEN '/api/pdf/' || download_id ELSE '' END"


@query(SQL + "SELECT chapter_number, title, p_size FROM chapters")
def scan_chapters(spark, d):
    return chapters(spark, d).select("chapter_number", "title", "p_size")


@query(SQL + "SELECT 'chapter:' || title AS id, max(chapter_number) AS chapter_number, count(*) AS n FROM chapters GROUP BY title")
def scan_chapter_nodes(spark, d):
    return chapters(spark, d).groupBy(F.concat(F.lit("chapter:"), "title").alias("id")).agg(F.max("chapter_number").alias("chapter_number"), F.count("*").alias("n"))


@query(SQL + "SELECT chapter_number, title FROM chapters WHERE chapter_number ILIKE '%1:0%' OR title ILIKE '%bolt%' ORDER BY chapter_number LIMIT 200")
def list_chapters(spark, d):
    found = chapters(spark, d).where(F.col("chapter_number").ilike("%1:0%") | F.col("title").ilike("%bolt%"))
    return found.select("chapter_number", "title").orderBy("chapter_number").limit(200)


@query(SQL + "SELECT chapter_number, title, row_number() OVER (ORDER BY split_part(chapter_number, ':', 1)::INT, split_part(chapter_number, ':', 2)::INT) AS place FROM chapters ORDER BY place LIMIT 200")
def list_chapters_natural(spark, d):
    from pyspark.sql import Window

    parts = F.split("chapter_number", ":")
    order = [parts[0].cast("int"), parts[1].cast("int")]
    top = chapters(spark, d).select("chapter_number", "title").orderBy(*order).limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query(SQL + "SELECT chapter_number, title FROM chapters WHERE contains(lower(title), 'wid') OR contains(lower(chapter_number), 'wid')")
def browse_chapters(spark, d):
    return chapters(spark, d).where(F.lower("title").contains("wid") | F.lower("chapter_number").contains("wid")).select("chapter_number", "title")


@query(SQL + "SELECT version_label, count(DISTINCT nullif(chapter_number, '')) AS n FROM chunks GROUP BY version_label")
def distinct_chapters(spark, d):
    return chunks(spark, d).groupBy("version_label").agg(F.count_distinct(F.nullif(F.col("chapter_number"), F.lit(""))).alias("n"))


@query(SQL + f"SELECT chapter_number, section_ref, count(*) AS n FROM versions WHERE as_at_date <= DATE '{DATE}' GROUP BY ALL")
def temporal_filter(spark, d):
    return temporal.cutoff(versions(spark, d), DATE).groupBy("chapter_number", "section_ref").agg(F.count("*").alias("n"))


@query(SQL + f"SELECT chapter_number, section_ref, as_at_date, download_id, version_label, {URL} AS pdf_url FROM ({AS_OF})")
def lookup_section_asof(spark, d):
    return temporal.as_of(versions(spark, d), DATE).select("chapter_number", "section_ref", "as_at_date", "download_id", "version_label", pdf_url(F.col("download_id")).alias("pdf_url"))


@query(SQL + f"""SELECT chapter_number, section_ref, as_at_date, download_id, row_number() OVER (PARTITION BY chapter_number, section_ref ORDER BY {ORDER}) - 1 AS position FROM versions""")
def lookup_section_history(spark, d):
    return temporal.history(versions(spark, d)).select("chapter_number", "section_ref", "as_at_date", "download_id", F.col("position").cast("long").alias("position"))


@query(SQL + "SELECT download_id, chapter_number, section_ref, row_number() OVER (PARTITION BY download_id ORDER BY section_ref::INT, chapter_number, l_extendedprice) AS chunk_index, title FROM versions")
def lookup_section_download(spark, d):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("download_id").orderBy(F.col("section_ref").cast("int"), "chapter_number", "l_extendedprice"))
    return versions(spark, d).select("download_id", "chapter_number", "section_ref", nth.cast("long").alias("chunk_index"), "title")


@query(SQL + f""", dated AS ({AS_OF.replace(DATE, '1996-01-31')}), newest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY chapter_number, section_ref ORDER BY {ORDER}) = 1)
SELECT chapter_number, section_ref, as_at_date, download_id, false AS fell_back FROM dated
UNION ALL SELECT chapter_number, section_ref, as_at_date, download_id, true FROM newest n WHERE NOT EXISTS (SELECT 1 FROM dated d WHERE d.chapter_number = n.chapter_number AND d.section_ref = n.section_ref)""")
def lookup_section_fallback(spark, d):
    return temporal.with_fallback(versions(spark, d), "1996-01-31").select("chapter_number", "section_ref", "as_at_date", "download_id", "fell_back")


@query(SQL + "SELECT download_id, string_agg(section_ref || ' ' || title, chr(10) || chr(10) ORDER BY section_ref::INT, title, chapter_number) AS text FROM versions GROUP BY download_id")
def version_text(spark, d):
    parts = F.array_sort(F.collect_list(F.struct(F.col("section_ref").cast("int").alias("i"), "title", "chapter_number", F.concat_ws(" ", "section_ref", "title").alias("part"))))
    return versions(spark, d).groupBy("download_id").agg(F.concat_ws("\n\n", F.transform(parts, lambda x: x["part"])).alias("text"))


@query(SQL + f""", dated AS (SELECT * FROM versions WHERE as_at_date <= DATE '{DATE}'),
at_date AS (SELECT * FROM dated QUALIFY as_at_date = max(as_at_date) OVER (PARTITION BY chapter_number, section_ref)),
texts AS (SELECT chapter_number, section_ref, count(DISTINCT l_extendedprice) AS texts FROM at_date GROUP BY ALL),
wanted AS (SELECT DISTINCT chapter_number, section_ref FROM versions)
SELECT w.chapter_number, w.section_ref, CASE WHEN t.texts IS NULL THEN 'not_found' WHEN t.texts > 1 THEN 'ambiguous' ELSE 'found' END AS status, a.as_at_date, a.download_id
FROM wanted w LEFT JOIN texts t USING (chapter_number, section_ref) LEFT JOIN ({AS_OF}) a ON a.chapter_number = w.chapter_number AND a.section_ref = w.section_ref""")
def resolve_citation(spark, d):
    rows = versions(spark, d)
    return temporal.resolve(rows, rows, DATE, "l_extendedprice")


@query(SQL + """, keys AS (SELECT DISTINCT chapter_number, section_ref FROM versions)
SELECT a.chapter_number, a.section_ref, b.section_ref AS other, row_number() OVER (PARTITION BY a.chapter_number, a.section_ref ORDER BY abs(b.section_ref::INT - a.section_ref::INT), b.section_ref) AS nth
FROM keys a JOIN keys b ON a.chapter_number = b.chapter_number AND a.section_ref <> b.section_ref QUALIFY nth <= 5""")
def resolve_alternatives(spark, d):
    rows = versions(spark, d)
    return temporal.alternatives(rows, rows).withColumn("nth", F.col("nth").cast("long"))


@query(SQL + "SELECT (SELECT count(*) FROM chapters) AS chapters, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(embedding) FROM chunks LEFT JOIN embeddings ON vec_id = chunk_id) AS embedded")
def stats(spark, d):
    embedded = chunks(spark, d).join(table(spark, d, "embeddings"), F.col("vec_id") == F.col("chunk_id"), "left")
    counts = [chapters(spark, d).agg(F.count("*").alias("chapters")), versions(spark, d).agg(F.count("*").alias("versions")), embedded.agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded"))]
    return counts[0].join(counts[1]).join(counts[2])  # three rows


@query(SQL + """SELECT 'duplicate chapter' AS rule, count(*) AS n FROM (SELECT chapter_number FROM chapters GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate version', count(*) FROM (SELECT chapter_number, section_ref, download_id FROM versions GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'version without chapter', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT chapter_id FROM chapters)
UNION ALL SELECT 'chunk without chapter', count(*) FROM chunks WHERE chapter_number NOT IN (SELECT chapter_number FROM chapters)
UNION ALL SELECT 'citation without case', count(*) FROM citations WHERE case_id NOT IN (SELECT id FROM cases)""")
def constraint_checks(spark, d):
    from statvine.sources.corpus import cases

    many = lambda df, *key: df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    found = {
        "duplicate chapter": many(chapters(spark, d), "chapter_number"),
        "duplicate version": many(versions(spark, d), "chapter_number", "section_ref", "download_id"),
        "version without chapter": table(spark, d, "lineitem").join(chapters(spark, d), F.col("l_partkey") == F.col("chapter_id"), "left_anti"),
        "chunk without chapter": chunks(spark, d).join(chapters(spark, d), "chapter_number", "left_anti"),
        "citation without case": citations(spark, d).join(cases(spark, d), F.col("case_id") == F.col("id"), "left_anti"),
    }
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in found.items()]
    return functools.reduce(DataFrame.unionByName, rows)


@query(SQL + f"""SELECT chapter_number, section_ref, download_id, l_suppkey, concat_ws(' · ', CASE WHEN position = 0 AND as_at_date IS NOT NULL THEN 'Latest available' END, coalesce(as_at_date::VARCHAR, 'Date unavailable'), nullif(version_label, '')) AS label
FROM (SELECT *, row_number() OVER (PARTITION BY chapter_number, section_ref ORDER BY {ORDER}) - 1 AS position FROM versions)""")
def version_labels(spark, d):
    return temporal.history(versions(spark, d)).select("chapter_number", "section_ref", "download_id", "l_suppkey", version_label(F.col("position"), F.col("as_at_date"), F.col("version_label")).alias("label"))


@query(SQL + f"""SELECT chapter_number, section_ref, download_id, l_suppkey, CASE WHEN download_id % 3 = 0 THEN 'Available as at ' || as_at_date
WHEN download_id = first_value(download_id) OVER (PARTITION BY chapter_number, section_ref ORDER BY {ORDER}) THEN 'Latest available' WHEN as_at_date IS NOT NULL THEN 'Historical version' ELSE 'No effective date on file' END AS label FROM versions""")
def authority_labels(spark, d):
    rows = versions(spark, d)
    newest = F.max(F.struct("as_at_date", "download_id"))["download_id"]
    latest = rows.groupBy(*temporal.KEY).agg(newest.alias("latest"))
    asked = F.when(F.col("download_id") % 3 == 0, F.col("as_at_date"))
    label = authority_label(F.col("as_at_date"), F.col("download_id") == F.col("latest"), asked)
    return rows.join(latest, list(temporal.KEY)).select("chapter_number", "section_ref", "download_id", "l_suppkey", label.alias("label"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(id, 0) <> 0 THEN '/api/pdf/' || id ELSE '' END AS pdf_url FROM (SELECT *, CASE l_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE l_orderkey END AS id FROM lineitem)")
def enrich_pdf_url(spark, d):
    """Where a version's file is; an id that is missing or 0 has none."""
    download_id = F.expr("CASE l_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE l_orderkey END")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pdf_url(download_id).alias("pdf_url"))
