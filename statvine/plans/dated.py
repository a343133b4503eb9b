"""Lookups and resolutions with a date of each request."""

from pyspark.sql import functions as F

from statvine.operators import temporal
from statvine.plans.lookup import ORDER
from statvine.plans.registry import query
from statvine.sources.corpus import SQL, chapters, table, versions

#: Each line asks for its provision, every eleventh for one that isn't there, at its order's date; every seventh without a date.
ASKED = SQL + """, requests AS (SELECT l_orderkey AS id, l_linenumber AS line, chapter_number, CASE WHEN l_orderkey % 11 = 0 THEN '99' ELSE l_linenumber::VARCHAR END AS section_ref,
    CASE WHEN l_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) + (l_orderkey % 400)::INTEGER END AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN chapters ON l_partkey = chapter_id),
asked AS (SELECT *, coalesce(date, DATE '9999-12-31') AS at FROM requests),
newest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY chapter_number, section_ref, as_at_date ORDER BY {0}) = 1),
texts AS (SELECT chapter_number, section_ref, as_at_date, count(DISTINCT l_extendedprice) > 1 AS several FROM versions GROUP BY ALL)
""".format(ORDER)


def _requests(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("chapter_id"))
    rows = lines.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey").join(chapters(spark, d).select("chapter_id", "chapter_number"), "chapter_id")
    section = F.when(F.col("l_orderkey") % 11 == 0, "99").otherwise(F.col("l_linenumber").cast("string"))
    date = F.when(F.col("l_orderkey") % 7 != 0, F.date_add(F.col("o_orderdate").cast("date"), (F.col("l_orderkey") % 400).cast("int")))
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), "chapter_number", section.alias("section_ref"), date.alias("date"))


@query(ASKED + "SELECT id, line, r.chapter_number, r.section_ref, date, v.as_at_date, v.download_id, v.version_label FROM asked r ASOF LEFT JOIN newest v ON r.chapter_number = v.chapter_number AND r.section_ref = v.section_ref AND r.at >= v.as_at_date")
def lookup_asof_batch(spark, d):
    """The version of every requested provision at the request's own date."""
    found = temporal.as_of_each(_requests(spark, d), versions(spark, d))
    return found.select("id", "line", *temporal.KEY, "date", "version.as_at_date", "version.download_id", "version.version_label")


@query(ASKED + """SELECT id, line, CASE WHEN v.as_at_date IS NULL THEN 'not_found' WHEN several THEN 'ambiguous' ELSE 'found' END AS status, v.as_at_date, v.download_id
FROM asked r ASOF LEFT JOIN newest v ON r.chapter_number = v.chapter_number AND r.section_ref = v.section_ref AND r.at >= v.as_at_date
LEFT JOIN texts t ON t.chapter_number = v.chapter_number AND t.section_ref = v.section_ref AND t.as_at_date = v.as_at_date""")
def resolve_batch(spark, d):
    """Status of every requested provision at the request's own date."""
    return temporal.resolve_each(_requests(spark, d), versions(spark, d), "l_extendedprice").select("id", "line", "status", "as_at_date", "download_id")


@query(ASKED + """, top AS (SELECT * FROM newest QUALIFY row_number() OVER (PARTITION BY chapter_number, section_ref ORDER BY as_at_date DESC) = 1)
SELECT id, line, coalesce(v.download_id, t.download_id) AS download_id, coalesce(v.as_at_date, t.as_at_date) AS as_at_date, v.as_at_date IS NULL AND t.as_at_date IS NOT NULL AS fell_back
FROM asked r ASOF LEFT JOIN newest v ON r.chapter_number = v.chapter_number AND r.section_ref = v.section_ref AND r.at >= v.as_at_date
LEFT JOIN top t ON t.chapter_number = r.chapter_number AND t.section_ref = r.section_ref""")
def lookup_fallback_batch(spark, d):
    """The same, with the newest version where none is as old as the request's date."""
    found = temporal.with_fallback_each(_requests(spark, d), versions(spark, d))
    return found.select("id", "line", "version.download_id", "version.as_at_date", "fell_back")


@query(ASKED + """, keys AS (SELECT DISTINCT chapter_number, section_ref FROM versions), missing AS (SELECT DISTINCT chapter_number, section_ref FROM requests WHERE section_ref = '99')
SELECT m.chapter_number, m.section_ref, k.section_ref AS other, row_number() OVER (PARTITION BY m.chapter_number, m.section_ref ORDER BY abs(k.section_ref::INT - m.section_ref::INT), k.section_ref) AS nth
FROM missing m JOIN keys k ON m.chapter_number = k.chapter_number QUALIFY nth <= 5 UNION ALL SELECT chapter_number, section_ref, '', 6 FROM missing WHERE chapter_number IN (SELECT chapter_number FROM keys)""")
def nearby_references(spark, d):
    """What to offer for a provision that isn't there: sections of its chapter, and the chapter alone."""
    missing = _requests(spark, d).where("section_ref = '99'").select(*temporal.KEY)
    return temporal.nearby(versions(spark, d), missing).withColumn("nth", F.col("nth").cast("long"))
