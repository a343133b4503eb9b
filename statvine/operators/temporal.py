"""Point-in-time lookup of provisions and resolution of citations."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("chapter_number", "section_ref")


def newest_first(df: DataFrame) -> list:
    """A total order: date (undated last), then download id, then whatever else tells rows apart."""
    return [F.col("as_at_date").desc_nulls_last(), F.col("download_id").desc(), *(F.col(c).desc() for c in ("l_suppkey", "l_extendedprice", "chunk_index") if c in df.columns)]


def cutoff(df: DataFrame, date: str | None) -> DataFrame:
    """Versions available by the date; undated ones only without a date."""
    return df.where(F.col("as_at_date") <= F.lit(date).cast("date")) if date else df


def as_of(df: DataFrame, date: str | None) -> DataFrame:
    """The newest version of each provision by the date."""
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(*newest_first(df)))
    return cutoff(df, date).withColumn("nth", nth).where("nth = 1").drop("nth")


def history(df: DataFrame) -> DataFrame:
    """All versions with their place, the newest first."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*KEY).orderBy(*newest_first(df))) - 1)


def with_fallback(df: DataFrame, date: str) -> DataFrame:
    """As of the date, or where nothing is that old the newest version without a cutoff."""
    late = ~F.coalesce(F.col("as_at_date") <= F.lit(date).cast("date"), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(late, *newest_first(df)))
    return df.withColumn("nth", nth).where("nth = 1").drop("nth").withColumn("fell_back", late)


def resolve(df: DataFrame, wanted: DataFrame, date: str, text: str) -> DataFrame:
    """status of each wanted (chapter_number, section_ref), with the chosen version.

    Several texts at the newest date make it ambiguous, no version by the date not_found.
    """
    by_date = cutoff(df, date).groupBy(*KEY, "as_at_date").agg(F.count_distinct(text).alias("texts"))
    texts = by_date.groupBy(*KEY).agg(F.max_by("texts", F.struct("as_at_date")).alias("texts"))  # undated ones come before all dates
    found = as_of(df, date).join(texts, list(KEY)).select(*KEY, "as_at_date", "download_id", "texts")
    status = F.when(F.col("texts").isNull(), "not_found").when(F.col("texts") > 1, "ambiguous").otherwise("found")
    return wanted.select(*KEY).distinct().join(found, list(KEY), "left").select(*KEY, status.alias("status"), "as_at_date", "download_id")


#: Rows of a provision from which its requests are dealt to ``SALTS`` tasks, and the most such provisions at once.
HOT, SALTS, MOST_HOT = 1_000_000, 64, 10_000


def as_of_each(requests: DataFrame, df: DataFrame, hot: int = HOT) -> DataFrame:
    """Every request (KEY, date and any other columns) with ``version``, the newest version by its own date, and ``newest``,
    the newest version at all; both are structs of the version's columns, null where there is none.

    Requests and versions meet as one table, sorted by date within a provision, and the newest version so far is carried forward:
    one shuffle for any number of dates. A request without a date takes the newest version, undated ones last, and no other
    request an undated one. A provision of more than ``hot`` rows (more, if over ``MOST_HOT`` provisions had as many) first
    leaves one version a day, and these stand in ``SALTS`` tasks, over which its requests are dealt. Repeated requests stay.
    """
    order = [c for c in ("as_at_date", "download_id", "l_suppkey", "l_extendedprice", "chunk_index") if c in df.columns]
    version = F.struct(*order, *(c for c in df.columns if c not in (*order, *KEY))).alias("version")
    versions = df.select(*KEY, "as_at_date", version)
    asked = requests.select(*KEY, F.coalesce(F.col("date").cast("date"), F.lit("9999-12-31").cast("date")).alias("at"), F.struct(*requests.columns).alias("request"))
    counts = versions.select(*KEY).unionByName(asked.select(*KEY)).groupBy(*KEY).agg(F.count("*").alias("n"))
    bar = max(hot, (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) // MOST_HOT)
    often = F.broadcast(counts.where(F.col("n") > bar).select(*KEY))  # at most MOST_HOT, as the counts add up to the total
    salt = lambda c: c.cast("int").alias("salt")
    few = versions.join(often, list(KEY), "left_anti").select(*KEY, salt(F.lit(0)), F.col("as_at_date").alias("at"), F.lit(0).alias("kind"), "version")
    daily = versions.join(often, list(KEY), "left_semi").groupBy(*KEY, "as_at_date").agg(F.max("version").alias("version"))
    many = daily.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("as_at_date").alias("at"), F.lit(0).alias("kind"), "version")
    dealt = asked.join(often.withColumn("many", F.lit(True)), list(KEY), "left")
    dealt = dealt.select(*KEY, salt(F.when(F.col("many"), F.pmod(F.xxhash64("request"), F.lit(SALTS))).otherwise(0)), "at", F.lit(1).alias("kind"), "request")
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (few, many, dealt))
    within = Window.partitionBy(*KEY, "salt")
    so_far = F.max("version").over(within.orderBy(F.col("at").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"so_far": so_far, "newest": F.max("version").over(within)}).where("kind = 1")
    fits = F.col("so_far.as_at_date").isNotNull() | F.col("request.date").isNull()
    return rows.select("request.*", F.when(fits, F.col("so_far")).alias("version"), "newest")


def resolve_each(requests: DataFrame, df: DataFrame, text: str, hot: int = HOT) -> DataFrame:
    """Every request with status (found, ambiguous, not_found) by its own date, and the chosen version's as_at_date and download_id.

    Several texts at the newest date make it ambiguous. Provisions are first reduced to a version a day.
    """
    daily = df.withColumn("text", F.col(text)).groupBy(*KEY, "as_at_date").agg(F.max("download_id").alias("download_id"), (F.min("text") != F.max("text")).alias("several"))
    rows = as_of_each(requests, daily, hot)
    status = F.when(F.col("version").isNull(), "not_found").when(F.col("version.several"), "ambiguous").otherwise("found")
    return rows.select(*requests.columns, status.alias("status"), "version.as_at_date", "version.download_id")


def with_fallback_each(requests: DataFrame, df: DataFrame, hot: int = HOT) -> DataFrame:
    """Every request with the version by its own date, or else the newest one, and whether it fell back; unknown provisions have neither."""
    rows = as_of_each(requests, df, hot)
    return rows.select(*requests.columns, F.coalesce("version", "newest").alias("version"), (F.col("version").isNull() & F.col("newest").isNotNull()).alias("fell_back"))


def nearby(df: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """As ``alternatives``, and after them the chapter alone (``other`` is empty) where the chapter is known."""
    sections = alternatives(df, wanted, most)
    chapters = wanted.select(*KEY).distinct().join(df.select("chapter_number").distinct(), "chapter_number", "left_semi")
    return sections.unionByName(chapters.select(*KEY, F.lit("").alias("other"), F.lit(most + 1).alias("nth")))


def alternatives(df: DataFrame, wanted: DataFrame, most: int = 5) -> DataFrame:
    """For each wanted provision the sections of its chapter nearest by number."""
    near = df.select(*KEY).distinct().withColumnRenamed("section_ref", "other")
    distance = F.abs(F.col("other").try_cast("int") - F.regexp_extract("section_ref", r"^([0-9]+)", 1).try_cast("int"))
    pairs = wanted.select(*KEY).distinct().join(near, "chapter_number").where("other <> section_ref").withColumn("distance", distance)
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.col("distance").asc_nulls_last(), "other"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= most).select(*KEY, "other", "nth")
