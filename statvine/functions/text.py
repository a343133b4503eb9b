"""Text shown to readers: snippets, excerpts around a query, highlights, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET, EXCERPT, TOOL_TEXT = 400, 620, 6000


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """One line of at most ``most`` characters, an ellipsis after a cut."""
    line = squeeze(text)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def tool_text(text: Column) -> Column:
    """What of a tool's text an assistant is given."""
    return F.substring(F.coalesce(text, F.lit("")), 1, TOOL_TEXT)


def query_terms(query: Column) -> Column:
    """The distinct lower-case words of more than two characters, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda x: F.length(x) > 2))


def excerpt_around_query(text: Column, query: Column, most: int = EXCERPT) -> Column:
    """At most ``most`` characters around the first hit of any term, cut at blanks."""
    value = F.trim(F.coalesce(text, F.lit("")))
    hits = F.filter(F.transform(query_terms(query), lambda t: F.instr(F.lower(value), t) - 1), lambda p: p >= 0)
    # zero-based, end exclusive
    begin = F.greatest(F.lit(0), F.coalesce(F.array_min(hits), F.lit(0)) - int(most * 0.25))
    end = F.least(F.length(value), begin + most)
    blank = F.locate(" ", F.substring(value, begin + 1, F.length(value)))
    start = F.when((begin > 0) & (blank > 0) & (begin + blank - 1 < end), begin + blank).otherwise(begin)
    back = F.locate(" ", F.reverse(F.substring(value, F.lit(1), end + 1)))
    last = F.when((end < F.length(value)) & (back > 0) & (end + 1 - back > start), end + 1 - back).otherwise(end)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.trim(F.substring(value, start + 1, last - start)), F.when(last < F.length(value), "…").otherwise(""))
    return F.when(F.length(value) <= most, value).otherwise(cut)


def highlight_segments(text: Column, terms: list[str]) -> Column:
    """array<struct<text, match>>: the text cut at the terms, whatever their case."""
    if not terms:
        return F.array(F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(False).alias("match")))
    escaped = "|".join("".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in t) for t in terms)
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i)({escaped})", "\u0001$1\u0001"), "\u0001"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(x.alias("text"), F.lower(x).isin([t.lower() for t in terms]).alias("match")))


def format_date(value: Column, fallback: str, long: bool = False) -> Column:
    return F.coalesce(F.date_format(value, "d MMMM yyyy" if long else "d MMM yyyy"), F.lit(fallback))


def version_label(position: Column, as_at: Column, label: Column) -> Column:
    """The entry of a version in a list, newest first."""
    latest = F.when((position == 0) & as_at.isNotNull(), F.lit("Latest available"))
    return F.concat_ws(" · ", latest, F.coalesce(as_at.cast("string"), F.lit("Date unavailable")), F.nullif(label, F.lit("")))


def authority_label(as_at: Column, is_latest: Column, asked: Column) -> Column:
    """How a version stands to the date asked for, and to the newest one."""
    return (
        F.when(asked.isNotNull(), F.concat(F.lit("Available as at "), asked.cast("string")))
        .when(is_latest, F.lit("Latest available"))
        .when(as_at.isNotNull(), F.lit("Historical version"))
        .otherwise(F.lit("No effective date on file"))
    )


def resolve_url(url: Column, prefix: str) -> Column:
    """Null for links that lead nowhere, absolute ones as they are, others behind the prefix."""
    dead = url.isNull() | url.isin("", "#") | url.contains("/undefined") | url.contains("/null")
    return F.when(dead, F.lit(None).cast("string")).when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit(prefix), url))


def pdf_url(download_id: Column) -> Column:
    return F.when(F.coalesce(download_id.cast("long"), F.lit(0)) != 0, F.concat(F.lit("/api/pdf/"), download_id.cast("string"))).otherwise(F.lit(""))
