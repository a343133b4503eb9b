"""The parts, sections and schedules of a law's text, read line by line with what was last announced carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines that announce something: ``PART II``, ``FIRST SCHEDULE``, ``12A. Heading``, each also behind markdown's marks, where a schedule
#: may be written small. Fixed patterns.
PART = r"^[#* ]*PART +([IVXLC]+|[0-9]+[A-Z]?)\b[ *.:—-]*([^*\r]*?)[* \r]*$"
SCHEDULE = r"^[#* ]*((?:[A-Z]+ )?SCHEDULE(?: [IVXLC]+| [0-9]+)?)[* \r]*$"
MARKED = r"(?i)^#+ *((?:[a-z]+ )?schedule(?: [ivxlc]+| [0-9]+)?)[* \r]*$"
SECTION = r"^[#* ]*([0-9]+[A-Z]?)\.(?:[* ]+([^*\r]*?))?[* \r]*$"


def lines(laws: DataFrame, *keys: str) -> DataFrame:
    """keys, nth, line, and for each line the part, schedule, section and heading that hold there.

    laws: keys (which tell texts apart), text. A schedule ends the parts and sections before it, a part ends sections and schedules; numbers
    within a schedule are its items, not sections. ``chunk`` counts what was announced; it is 0 before the first.
    """
    rows = laws.select(*keys, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("nth", "line"))
    found = lambda p, k=1: F.nullif(F.trim(F.regexp_extract("line", p, k)), F.lit(""))
    rows = rows.withColumns({"a_part": found(PART), "a_schedule": F.coalesce(found(SCHEDULE), F.upper(found(MARKED)))})
    # a number is a section's only outside of schedules, so what holds of these comes first
    so_far = Window.partitionBy(*keys).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    outer = F.when(F.col("a_part").isNotNull(), F.struct(F.col("a_part").alias("part"), found(PART, 2).alias("heading"), F.lit(None).cast("string").alias("schedule"))).when(
        F.col("a_schedule").isNotNull(), F.struct(F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("heading"), F.col("a_schedule").alias("schedule")))
    rows = rows.withColumns({"outer": F.last(outer, ignorenulls=True).over(so_far), "turn": outer.isNotNull()})
    a_section = F.when(~F.col("turn") & F.col("outer.schedule").isNull(), found(SECTION))
    inner = F.when(F.col("turn"), F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("string").alias("heading"))).when(
        a_section.isNotNull(), F.struct(a_section.alias("section"), found(SECTION, 2).alias("heading")))
    rows = rows.withColumns({"inner": F.last(inner, ignorenulls=True).over(so_far), "chunk": F.count(inner).over(so_far)})
    heading = F.when(F.col("inner.section").isNotNull(), F.col("inner.heading")).otherwise(F.col("outer.heading"))
    return rows.select(*keys, "nth", "line", F.col("outer.part").alias("part"), F.col("outer.schedule").alias("schedule"), F.col("inner.section").alias("section"), heading.alias("heading"), "chunk")


def chunked(laws: DataFrame, *keys: str) -> DataFrame:
    """keys, chunk_index, part, schedule, section_ref, heading, chunk_text: a row for each section and schedule.

    ``section_ref`` is a section's number or a schedule's name, so both are looked up alike; a part's own line gives a row only if text follows it.
    What stands before the first announcement is no chunk.
    """
    rows = lines(laws, *keys).where("chunk > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n")
    whole = rows.groupBy(*keys, "chunk").agg(*(F.first(c).alias(c) for c in ("part", "schedule", "section", "heading")), F.count("*").alias("n"), text.alias("chunk_text"))
    reference = F.coalesce("section", "schedule", F.lit(""))
    kept = whole.where((reference != "") | (F.col("n") > 1))
    place: Column = F.row_number().over(Window.partitionBy(*keys).orderBy("chunk")) - 1
    return kept.select(*keys, place.alias("chunk_index"), "part", "schedule", reference.alias("section_ref"), F.coalesce("heading", F.lit("")).alias("heading"), "chunk_text")
