"""Citation forms: chapter numbers ``8:08``, section references ``12(3)(a)``, titles and written citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that already end a title. Fixed values.
TITLE_ENDS = ("Act", "Code", "Constitution", "Ordinance", "Order", "Regulations", "Rules")
BAD_CHAPTER = "Enter a chapter number such as 8:08."


def normalize_chapter(raw: Column) -> Column:
    """``Chap. 8:8`` and the like to ``8:08``; null if it is no chapter number."""
    bare = F.trim(F.regexp_replace(raw, r"(?i)^\s*chap(ter)?\.?\s*", ""))
    form = r"^([0-9]{1,3})\s*[:/.\s-]\s*([0-9]{1,3})$"
    first, second = F.regexp_extract(bare, form, 1), F.regexp_extract(bare, form, 2)
    padded = F.when(F.length(second) < 2, F.lpad(second, 2, "0")).otherwise(second)  # lpad alone would cut three digits
    return F.when(second != "", F.concat(first.try_cast("int").cast("string"), F.lit(":"), padded))


def normalize_section(raw: Column) -> Column:
    """``section 12 (3) (A)`` to ``12(3)(a)``; null if it is no section reference."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)^\s*(?:sections?|ss?)\.?\s*", ""), r"\s+", "")
    form = r"^([0-9]+)([A-Za-z]?)((?:\([0-9A-Za-z]+\))*)$"
    number, letter, rest = (F.regexp_extract(bare, form, k) for k in (1, 2, 3))
    nested = F.transform(F.regexp_extract_all(rest, F.lit(r"(\([0-9A-Za-z]+\))")), lambda g: F.when(g.rlike(r"^\([A-Za-z]+\)$"), F.lower(g)).otherwise(g))
    return F.when(number != "", F.concat(number.try_cast("bigint").cast("string"), F.upper(letter), F.array_join(nested, "")))


def citation_title(title: Column) -> Column:
    """The title with single blanks, ending in ``Act`` unless it ends in another kind of law."""
    bare = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    ends = rf"(?i)\b({'|'.join(TITLE_ENDS)})\s*$"
    return F.when(bare == "", F.lit("Title unavailable")).when(bare.rlike(ends), bare).otherwise(F.concat(bare, F.lit(" Act")))


def format_citation(title: Column, chapter: Column, section: Column, as_at: Column) -> tuple[Column, Column]:
    """The long and the short form; a date names the version in the long one."""
    dated = F.when(as_at.isNotNull(), F.concat(F.lit(" (version available as at "), F.date_format(as_at, "d MMMM yyyy"), F.lit(")"))).otherwise(F.lit(""))
    short = F.concat(F.lit("Chap. "), chapter, F.lit(", s. "), section)
    return F.concat(citation_title(title), F.lit(", "), short, dated), short


def parse_iso_date(raw: Column) -> Column:
    """A date written ``yyyy-MM-dd``; anything else is null."""
    return F.when(raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
