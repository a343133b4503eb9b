"""Citations of statutes in case texts: by chapter number and by name."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statvine.operators.graph import CITED as CHAPTER
from statvine.operators.graph import bare_references

#: The form of a law's name. Fixed pattern.
ACT = r"(?i)\bthe\s+([A-Z][A-Za-z\- ]{3,60}?)\s+(Act|Ordinance|Regulations?)\b"
HITS, GRAM = 3, 8


def normalize_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def chapter_citations(cases: DataFrame, chapters: DataFrame) -> DataFrame:
    """case_id, target, confidence, detail: an edge for each mention of a known chapter in ``text``."""
    found = cases.select("case_id", F.explode(F.regexp_extract_all("text", F.lit(CHAPTER))).alias("chapter"))
    known = chapters.select(F.col("chapter_number").alias("chapter")).distinct()
    return found.join(known, "chapter", "left_semi").select("case_id", F.concat(F.lit("chapter:"), "chapter").alias("target"), F.lit("medium").alias("confidence"), F.concat(F.lit("Ch. "), "chapter").alias("detail"))


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Pairs (s, l) of distinct strings of which s stands in l.

    They meet on the first ``GRAM`` characters of s (all, if it has fewer), which must be a gram of l; only such pairs
    are compared. Empty strings match nothing.
    """
    keyed = short.select("s", F.substring("s", 1, GRAM).alias("gram")).where("s <> ''")
    at = F.sequence(F.lit(1), F.length("l"))
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(F.col("l"), i, n)))))
    return keyed.join(long.where("l <> ''").select("l", F.explode(grams).alias("gram")), "gram").where(F.col("l").contains(F.col("s"))).select("s", "l").distinct()


def title_citations(cases: DataFrame, chapters: DataFrame) -> DataFrame:
    """case_id, target, confidence, detail of laws named in ``text``: titles equal after normalising, else titles that
    stand in the name or hold it.

    Of several chapters the first three stay, titles in the order of their first chapter; confidence is high where there
    is one chapter only. Names and titles meet as distinct strings, so a name that many cases hold is looked up once.
    """
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(ACT), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(ACT), F.lit(2)).alias("kind"))
    named = cases.select("case_id", F.explode(both).alias("x")).select("case_id", F.trim("x.name").alias("name"), "x.kind").withColumn("norm", normalize_title(F.col("name")))
    listed = chapters.select(normalize_title(F.col("title")).alias("title"), "chapter_number").where("title <> ''").distinct()
    per_title = Window.partitionBy("title").orderBy("chapter_number")
    titles = listed.groupBy("title").agg(F.count("*").alias("n"), F.min("chapter_number").alias("first"))
    heads = listed.withColumn("nth", F.row_number().over(per_title)).where(F.col("nth") <= HITS).select("title", "chapter_number")
    norms = named.select("norm").distinct()
    exact = norms.join(titles.select(F.col("title").alias("norm")), "norm", "left_semi").select("norm", F.col("norm").alias("title"))
    missed = norms.join(exact.select("norm"), "norm", "left_anti")
    inside = contained(titles.select(F.col("title").alias("s")), missed.select(F.col("norm").alias("l"))).select(F.col("l").alias("norm"), F.col("s").alias("title"))
    around = contained(missed.select(F.col("norm").alias("s")), titles.select(F.col("title").alias("l"))).select(F.col("s").alias("norm"), F.col("l").alias("title"))
    pairs = exact.unionByName(inside).unionByName(around).distinct().join(titles, "title")
    nth = F.row_number().over(Window.partitionBy("norm").orderBy("first", "title", "chapter_number"))
    chosen = pairs.join(heads, "title").withColumn("nth", nth).where(F.col("nth") <= HITS).select("norm", "chapter_number")
    counts = pairs.groupBy("norm").agg(F.sum("n").alias("hits"))
    edges = named.join(chosen, "norm").join(counts, "norm")
    return edges.select("case_id", F.concat(F.lit("chapter:"), "chapter_number").alias("target"), F.when(F.col("hits") == 1, "high").otherwise("low").alias("confidence"), F.concat(F.lit("the "), "name", F.lit(" "), "kind").alias("detail"))


def case_edges(cases: DataFrame, chapters: DataFrame) -> DataFrame:
    """source, target, type, evidence, method, confidence, detail of all citations in ``text`` of cases (case_id, text).

    Of equal source, target and method one stays: chapters in full form before bare numbers, then by detail.
    """
    bare = bare_references(cases.select(F.col("case_id").alias("chunk_id"), F.col("text").alias("chunk_text")), chapters)
    bare = bare.select(F.col("chunk_id").alias("case_id"), F.concat(F.lit("chapter:"), "chapter").alias("target"), "confidence", F.col("chapter").alias("detail"))
    kinds = ((0, "REGEX", chapter_citations(cases, chapters)), (1, "REGEX", bare), (2, "TITLE_MATCH", title_citations(cases, chapters)))
    parts = [df.select("case_id", "target", F.lit(method).alias("method"), F.struct(F.lit(place).alias("place"), "detail", "confidence").alias("x")) for place, method, df in kinds]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("case_id", "target", "method").agg(F.min("x").alias("x"))
    return one.select(F.concat(F.lit("case:"), "case_id").alias("source"), "target", F.lit("CITES_STATUTE").alias("type"), F.lit("EXTRACTED").alias("evidence"), "method", "x.confidence", "x.detail")


#: Confidences from the surest on. Fixed values.
SURE = ("high", "medium", "low")


def by_confidence(edges: DataFrame, cases: DataFrame) -> DataFrame:
    """id, title, year, confidence, sure (0 is surest) of the cases (id, title, year) that edges lead from, by their surest edge:
    sorted by sure, then the newest first, then id."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SURE)), F.col("confidence")), F.lit(0)), F.lit(len(SURE) + 1)) - 1
    best = edges.select(F.regexp_replace("source", "^case:", "").alias("id"), F.struct(rank.cast("int").alias("sure"), "confidence").alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    return best.join(cases.select("id", "title", "year"), "id").select("id", "title", "year", "x.confidence", "x.sure").orderBy("sure", F.col("year").desc_nulls_last(), "id")


def report(cases: DataFrame, edges: DataFrame, top: int = 15) -> DataFrame:
    """what, name, n: cases loaded, cases that cite, edges, edges by confidence and by method, and the most cited targets."""
    rows = [cases.agg(F.count("*").alias("n")).select(F.lit("cases_loaded").alias("what"), F.lit("").alias("name"), "n")]
    rows.append(edges.agg(F.count_distinct("source").alias("n")).select(F.lit("case_nodes").alias("what"), F.lit("").alias("name"), "n"))
    rows.append(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), F.lit("").alias("name"), "n"))
    for c in ("confidence", "method"):
        rows.append(edges.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), "name", "n"))
    rows.append(edges.groupBy(F.col("target").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(top).select(F.lit("target").alias("what"), "name", "n"))
    return functools.reduce(DataFrame.unionByName, rows)
