"""Listing and detail pages of a statute site, read with regular expressions on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(html: Column) -> Column:
    """array<struct<href, text>> of the list items that are links."""
    item = r'<li[^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    return F.zip_with(F.regexp_extract_all(html, F.lit(item), F.lit(1)), F.regexp_extract_all(html, F.lit(item), F.lit(2)), lambda a, b: F.struct(a.alias("href"), b.alias("text")))


def heading(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)


def listing(pages: DataFrame) -> DataFrame:
    """currentid, title, chapter_number and note of each entry of a listing page (column html)."""
    block = r'(?s)<li[^>]*>\s*<a[^>]*href="[^"]*currentid=[0-9]+[^"]*".*?</li>'
    entry = pages.select(F.explode(F.regexp_extract_all("html", F.lit(block), F.lit(0))).alias("e"))
    part = lambda pattern: F.trim(F.regexp_extract("e", pattern, 1))
    return entry.select(
        part(r"currentid=([0-9]+)").cast("long").alias("download_id"),
        part(r'(?s)<strong class="block[^"]*"[^>]*>(.*?)</strong>').alias("title"),
        part(r"Chapter\s+([0-9]+:[0-9]{2,3})").alias("chapter_number"),
        part(r"Chapter\s+[0-9:]+\s*\(([^)]*)\)").alias("note"),
    )


def ordinal_date(text: Column) -> Column:
    """``December 31st 2016`` and ``as at December 31st 2016`` as a date."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)^\s*as at\s+", ""), r"([0-9]{1,2})(st|nd|rd|th)\b", "$1")
    return F.try_to_date(F.trim(plain), "MMMM d yyyy")


def detail(pages: DataFrame) -> DataFrame:
    """A row for each page of a chapter: title, chapter_number, long_title, year, act_number, commencement_date,
    classification and revisions, an array of (download_id, as_at_date, label) in the page's order."""
    part = lambda pattern: F.trim(F.regexp_replace(F.regexp_extract("html", pattern, 1), r"\s+", " "))
    fact = lambda name: part(rf"(?s){name}\s*-\s*(.*?)\s*</a>")
    heading = r"(?s)<h4[^>]*>\s*<a[^>]*>\s*(.*?)\s+Chap\.\s*[0-9]+:[0-9]{2,3}"
    # the link with the address is followed by the date and the label
    item = r'(?s)<a[^>]*href="[^"]*/download/([0-9]+)[^"]*"[^>]*>\s*<strong>\s*<small[^>]*>(.*?)</small>\s*</strong>\s*<strong[^>]*>(.*?)</strong>'
    group = lambda k: F.regexp_extract_all("html", F.lit(item), F.lit(k))
    zipped = F.arrays_zip(group(1).alias("i"), group(2).alias("d"), group(3).alias("l"))
    revisions = F.transform(zipped, lambda x: F.struct(x["i"].try_cast("long").alias("download_id"), ordinal_date(x["d"]).alias("as_at_date"), F.trim(x["l"]).alias("label")))
    day = F.regexp_replace(fact("Commencement Date"), r"^[A-Za-z]{3},\s*", "")
    return pages.select(
        part(heading).alias("title"),
        part(r"Chap\.\s*([0-9]+:[0-9]{2,3})").alias("chapter_number"),
        part(r"(?s)<p>(?:\s*<i[^>]*></i>)?\s*<strong>(.*?)</strong>").alias("long_title"),
        fact("Year").try_cast("int").alias("year"),
        fact("Act Number").alias("act_number"),
        F.try_to_date(day, "d MMM yyyy").alias("commencement_date"),
        fact("Classification").alias("classification"),
        revisions.alias("revisions"),
    )
