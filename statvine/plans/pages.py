"""Web page queries."""

from pyspark.sql import functions as F

from statvine.plans.registry import query
from statvine.sources import html
from statvine.sources.corpus import SQL, chapters, table

ITEM = r'<li[^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'


@query(rf"""SELECT page_id, h[i] AS href, t[i] AS text, i AS place FROM (SELECT page_id, h, t, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '{ITEM}', 1) AS h, regexp_extract_all(html, '{ITEM}', 2) AS t FROM pages))""")
def html_listing_parse(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(html.links(F.col("html"))).alias("i", "x"))
    return rows.select("page_id", "x.href", "x.text", (F.col("i") + 1).cast("long").alias("place"))


@query(r"SELECT page_id, regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS heading, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_detail_parse(spark, d):
    return table(spark, d, "pages").select("page_id", html.heading(F.col("html")).alias("heading"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, parts[i] AS chunk_text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(parts[i]) <> ''")
def section_chunking(spark, d):
    """Paragraphs of each text with their place."""
    parts = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("chunk_index", "chunk_text")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("SELECT doc_id, substring(body, 1, 4) = '%PDF' AS valid FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '%PDF-1.7 ' ELSE '<html>' END || text AS body FROM documents)")
def valid_pdf_magic(spark, d):
    from statvine.sources.files import is_pdf

    body = F.concat(F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7 ").otherwise("<html>"), "text").cast("binary")
    return table(spark, d, "documents").select("doc_id", is_pdf(body).alias("valid"))


@query(SQL + "SELECT chapter_id, chapter_number, title FROM chapters")
def ingest_slug_parse(spark, d):
    slug = F.concat_ws("_", F.translate("chapter_number", ":", "_"), F.translate("title", " ", "_"))
    form = r"^([0-9]+)_([0-9]{2,3})_(.*)$"
    rows = chapters(spark, d).select("chapter_id", slug.alias("slug"))
    return rows.select("chapter_id", F.concat_ws(":", F.regexp_extract("slug", form, 1), F.regexp_extract("slug", form, 2)).alias("chapter_number"), F.translate(F.regexp_extract("slug", form, 3), "_", " ").alias("title"))


#: Pages in the site's shape, made of the tables.
ENTRY = """concat('<li class="flex"><a href="/laws?currentid=', chapter_id, '&x=1"><strong class="block">', title, '</strong><small>', p_brand, '</small><small>Chapter ', chapter_number, if(p_size % 3 = 0, ' (repealed)', ''), '</small></a></li>')"""
PAGE = """concat('<h4 class="x"><a href="/">', title, ' Chap. ', chapter_number, '</a></h4><p><i class="y"></i> <strong>An Act on ', title, '</strong></p><a>Year - ', 1900 + p_size, '</a><a>Act Number - ', p_size, ' of ', 1900 + p_size, '</a><a>Commencement Date - Fri, ', 1 + p_size % 28, ' Aug 19', lpad(p_size, 2, '0'), '</a><a>Classification - ', p_brand, '</a>',
    '<a href="/download/', chapter_id, '"><strong><small>as at December 31st 2016</small></strong><strong>current</strong></a><a href="/download/', chapter_id + 1, '"><strong><small>as at March 2nd 20', lpad(p_size, 2, '0'), '</small></strong><strong>old</strong></a>')"""
MARKDOWN = "concat('# ', source, '\n## 1. Begin\n', replace(text, '#', ''), '\n## 2A. End ', lang, '\nlast\n## Schedule\nrest')"


@query(SQL + "SELECT chapter_id AS download_id, title, chapter_number, CASE WHEN p_size % 3 = 0 THEN 'repealed' ELSE '' END AS note FROM chapters")
def law_listing(spark, d):
    """The listing pages, a hundred entries each, read back."""
    entry = chapters(spark, d).select((F.col("chapter_id") % 100).alias("page"), F.expr(ENTRY).alias("e"))
    pages = entry.groupBy("page").agg(F.concat(F.lit("<ul>"), F.array_join(F.collect_list("e"), "\n"), F.lit("</ul>")).alias("html"))
    return html.listing(pages)


@query(SQL + """SELECT title, chapter_number, 'An Act on ' || title AS long_title, 1900 + p_size AS year, p_size || ' of ' || (1900 + p_size) AS act_number, make_date(1900 + p_size, 8, 1 + p_size % 28) AS commencement_date, p_brand AS classification,
chapter_id || ' 2016-12-31 current,' || (chapter_id + 1) || ' ' || make_date(2000 + p_size, 3, 2) || ' old' AS revisions FROM chapters""")
def law_detail(spark, d):
    """The detail page of every chapter, read back."""
    found = html.detail(chapters(spark, d).select(F.expr(PAGE).alias("html")))
    listed = F.array_join(F.transform("revisions", lambda x: F.concat_ws(" ", x["download_id"], x["as_at_date"], x["label"])), ",")
    return found.withColumn("revisions", listed)


@query("""SELECT doc_id, i AS chunk_index, ['1', '2A', 'SCHEDULE'][i + 1] AS section_ref, ['Begin', 'End ' || lang, ''][i + 1] AS heading, length(['## 1. Begin' || chr(10) || replace(text, '#', ''), '## 2A. End ' || lang || chr(10) || 'last', '## Schedule' || chr(10) || 'rest'][i + 1]) AS size FROM documents, (SELECT unnest([0, 1, 2]) AS i)""")
def law_sections(spark, d):
    """Markdown versions cut into sections and schedules."""
    from statvine.sources.files import sections

    versions = table(spark, d, "documents").select("doc_id", F.expr(MARKDOWN).alias("text"))
    return sections(versions).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "section_ref", "heading", F.length("chunk_text").cast("long").alias("size"))
