"""The seven questions an assistant may ask, each a bounded plan over the library's tables.

A tool gives rows place, source_id, kind, title, chapter, section, date, url, line: what to show and where it is from.
No rows mean that nothing was found.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statvine.functions import citations as forms
from statvine.functions.text import pdf_url, snippet
from statvine.operators import search, temporal


@dataclass(frozen=True)
class Library:
    """chapters: chapter_number, title; chunks: chunk_id, chapter_number, section_ref, chunk_text, as_at_date,
    download_id, version_label; cases: id, title, year; citations: case_id, chapter_number."""

    chapters: DataFrame
    chunks: DataFrame
    cases: DataFrame
    citations: DataFrame


def _shown(df: DataFrame, order: list, limit: int | None, *, source_id: Column, line: Column, kind: str, title: Column, chapter: Column | str = "", section: Column | str = "", date: Column | str = "", url: Column | str = "", keys: tuple[str, ...] = ()) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1  # over `limit` rows, or all rows of the keys
    text = lambda c, name: F.coalesce(F.lit(c).cast("string"), F.lit("")).alias(name)
    top = df if limit is None else df.orderBy(*order).limit(limit)
    return top.select(place.alias("place"), text(source_id, "source_id"), F.lit(kind).alias("kind"), text(title, "title"), text(chapter, "chapter"), text(section, "section"), text(date, "date"), text(url, "url"), line.alias("line"))


def _case(label: str = "title") -> Column:
    return F.when(F.trim(F.coalesce(label, F.lit(""))) != "", F.concat(F.col(label), F.lit(" ("), F.col("id"), F.lit(")"))).otherwise(F.col("id"))


def _version(head: Column) -> Column:
    dated = F.coalesce(F.col("as_at_date").cast("string"), F.lit("undated"))
    return F.concat(head, F.lit(" — "), F.coalesce(F.nullif("version_label", F.lit("")), F.lit("version")), F.lit(", available as at "), dated, F.lit("\n  "), snippet(F.col("chunk_text")))


def _place(section: Column) -> Column:
    return F.concat(F.lit("Chap. "), F.col("chapter_number"), F.lit(", s. "), section)


def search_provisions(lib: Library, query: str, chapter: str = "", date: str = "", limit: int = 5) -> DataFrame:
    """The provisions that hold every word, each by its best chunk."""
    rows = lib.chunks.where(F.col("chapter_number") == chapter) if chapter else lib.chunks
    found = search.grouped(rows, search.fts(rows, query), date or None).orderBy(F.desc("score"), "key").limit(limit)
    best = found.select("score", "key", "chapter_number", "section_ref", "matched_version.*")
    named = best.join(lib.chapters.select("chapter_number", "title"), "chapter_number", "left")
    section = F.coalesce(F.nullif("section_ref", F.lit("")), F.lit("whole chapter"))
    return _shown(named, [F.desc("score"), F.col("key")], limit, source_id=F.concat(F.lit("chunk:"), "chunk_id"), line=_version(_place(section)), kind="statute", title=F.col("title"), chapter=F.col("chapter_number"), section=F.col("section_ref"), date=F.col("as_at_date"), url=pdf_url(F.col("download_id")))


def lookup_section(lib: Library, chapter: str, section: str, date: str = "", limit: int | None = None) -> DataFrame:
    """The version of a provision on a day, or all its versions, the newest first."""
    rows = lib.chunks.where((F.col("chapter_number") == chapter) & (F.col("section_ref") == section))
    rows = temporal.as_of(rows, date) if date else rows
    order = [F.col("as_at_date").desc_nulls_last(), F.col("download_id").desc(), F.col("chunk_id")]
    numbered = _shown(rows, order, limit, source_id=F.col("download_id"), line=_version(_place(F.col("section_ref"))), kind="statute", title=F.col("chapter_number"), chapter=F.col("chapter_number"), section=F.col("section_ref"), date=F.col("as_at_date"), url=pdf_url(F.col("download_id")), keys=("chapter_number", "section_ref"))
    return numbered.withColumn("source_id", F.concat_ws(":", F.lit("lookup"), "source_id", "place"))


def resolve_citation(lib: Library, chapter: str, section: str, date: str = "", limit: int = 5) -> DataFrame:
    """The provision a written citation means, with its whole text; else its status and the nearest sections of the chapter.

    Several texts at the newest date are ambiguous. What isn't a chapter or section number gives a message.
    """
    number, part = forms.normalize_chapter(F.lit(chapter)), forms.normalize_section(F.lit(section))
    spark = lib.chunks.sparkSession
    wanted = spark.range(1).select(number.alias("chapter_number"), part.alias("section_ref"))
    named = lib.chunks.where(F.col("chapter_number") == number).join(lib.chapters.select("chapter_number", "title"), "chapter_number", "left")
    meant = named.where(F.col("section_ref") == part)
    status = temporal.resolve(meant, wanted, date or None, "chunk_text").select(F.when(number.isNull() | part.isNull(), "invalid").otherwise(F.col("status")).alias("status"))  # a row
    long, short = forms.format_citation(F.col("title"), F.col("chapter_number"), F.col("section_ref"), F.col("as_at_date"))
    common = {"kind": "statute", "title": F.col("title"), "chapter": F.col("chapter_number"), "section": F.col("section_ref"), "date": F.col("as_at_date"), "url": pdf_url(F.col("download_id"))}
    found = temporal.as_of(meant, date or None).join(F.broadcast(status.where("status = 'found'")), F.lit(True), "left_semi")
    hit = _shown(found, [F.col("chunk_id")], 1, source_id=F.concat(F.lit("chunk:"), "chunk_id"), line=F.concat_ws("\n", F.lit("found"), long, short, F.col("chunk_text")), **common)
    other = F.broadcast(status.where("status <> 'found'"))
    said = F.when(F.col("status") == "invalid", F.concat(F.lit("Invalid citation reference: "), F.lit(chapter), F.lit(", "), F.lit(section))).otherwise(F.concat(F.lit("Citation status: "), "status", F.lit(" for Chap. "), number, F.lit(", s. "), part, F.lit(".")))
    message = _shown(other, [F.col("status")], 1, source_id=F.lit(""), line=said, kind="status", title=F.lit(""))
    near = temporal.as_of(named, None).join(other.where("status <> 'invalid'"), F.lit(True), "left_semi")
    gap = F.abs(F.col("section_ref").try_cast("int") - F.regexp_extract(part, "^([0-9]+)", 1).try_cast("int"))
    others = _shown(near, [gap.asc_nulls_last(), F.col("section_ref"), F.col("chunk_id")], limit, source_id=F.concat(F.lit("chunk:"), "chunk_id"), line=F.concat(F.lit("near: "), short), **common)
    return hit.unionByName(message).unionByName(others.withColumn("place", F.col("place") + 1))


def list_chapters(lib: Library, query: str = "", limit: int = 20) -> DataFrame:
    rows = lib.chapters.where(F.col("chapter_number").ilike(f"%{query}%") | F.col("title").ilike(f"%{query}%")) if query else lib.chapters
    return _shown(rows, [F.col("chapter_number")], limit, source_id=F.concat(F.lit("chapter:"), "chapter_number"), line=F.concat(F.lit("Chap. "), "chapter_number", F.lit(" — "), "title"), kind="chapter", title=F.col("title"), chapter=F.col("chapter_number"))


def citing_cases(lib: Library, chapter: str, limit: int = 20) -> DataFrame:
    """The cases that cite a chapter, the newest first; no chapter number, no rows."""
    rows = lib.citations.where(F.col("chapter_number") == forms.normalize_chapter(F.lit(chapter))).join(lib.cases, F.col("case_id") == F.col("id"))
    return _shown(rows, [F.col("year").desc_nulls_last(), F.col("id")], limit, source_id=F.col("id"), line=F.concat(_case(), F.lit(" cites Chap. "), "chapter_number"), kind="case", title=F.col("title"), chapter=F.col("chapter_number"), url=F.concat(F.lit("/api/cases/"), "id"))


def search_cases(lib: Library, query: str, limit: int = 20) -> DataFrame:
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")"))).otherwise(F.lit(""))
    return _shown(lib.cases.where(F.col("title").ilike(f"%{query}%")), [F.col("title"), F.col("id")], limit, source_id=F.col("id"), line=F.concat(_case(), year), kind="case", title=F.col("title"), url=F.concat(F.lit("/api/cases/"), "id"))


def expand_case(lib: Library, case_id: str, limit: int = 20) -> DataFrame:
    """Other cases that cite a chapter this one cites."""
    own = case_id.removeprefix("case:")
    mine = lib.citations.where(F.col("case_id") == own).select("chapter_number").distinct()
    rows = lib.citations.where(F.col("case_id") != own).join(mine, "chapter_number").join(lib.cases, F.col("case_id") == F.col("id"))
    return _shown(rows, [F.col("year").desc_nulls_last(), F.col("id"), F.col("chapter_number")], limit, source_id=F.col("id"), line=F.concat(_case(), F.lit(" cites Chap. "), "chapter_number"), kind="case", title=F.col("title"), chapter=F.col("chapter_number"), url=F.concat(F.lit("/api/cases/"), "id"))


TOOLS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (search_provisions, lookup_section, resolve_citation, list_chapters, citing_cases, search_cases, expand_case)}


#: What a parameter means, for all tools that have it.
MEANING = {
    "query": "Words to look for.",
    "chapter": "A chapter number such as 8:08.",
    "section": "A section such as 4 or 12(3)(a), or a schedule's name.",
    "date": "A day as YYYY-MM-DD; only versions available by then.",
    "limit": "How many rows at most.",
    "case_id": "The id of a case, with or without case: before it.",
}


def schemas() -> list[dict]:
    """What an assistant is told of each tool: its name, what it gives, and its parameters as a JSON schema."""
    kinds = {"str": "string", "int": "integer", "int | None": "integer"}
    told = []
    for name, tool in TOOLS.items():
        own = [p for p in inspect.signature(tool).parameters.values() if p.name != "lib"]
        parameters = {"type": "object", "properties": {p.name: {"type": kinds[str(p.annotation)], "description": MEANING[p.name]} for p in own}, "required": [p.name for p in own if p.default is p.empty]}
        told.append({"type": "function", "function": {"name": name, "description": (tool.__doc__ or name).split("\n")[0], "parameters": parameters}})
    return told
