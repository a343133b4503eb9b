"""Full-text, vector and hybrid search, grouped by provision, page by page."""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from statvine.functions import english
from statvine.functions.text import pdf_url
from statvine.functions.vectors import cosine
from statvine.sources.shared import stash

RANKED, RRF = 100, 60


def tokens(text):
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf, size: what an inverted index holds."""
    words = chunks.select("chunk_id", tokens("chunk_text").alias("terms"))
    return words.select("chunk_id", F.size("terms").alias("size"), F.explode("terms").alias("term")).groupBy("chunk_id", "size", "term").agg(F.count("*").alias("tf"))


def wanted(query: str) -> list[str]:
    return sorted({w for w in re.split("[^a-z0-9]+", query.lower()) if w})


def fts(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id, score of the chunks that hold every word of the query: sum of tf * ln(1 + N / df) / (1 + ln(size)).

    Texts that contain none of the words, as letters anywhere, aren't cut into words. What holds some of the words is written
    to the shared folder, a few numbers a row, and read for the scores; how many texts there are is counted while it is written.
    """
    return _scan(chunks, [[w] for w in wanted(query)])


def _scan(chunks: DataFrame, terms: list[list[str]]) -> DataFrame:
    """``fts`` of terms, each of which stands as any of its words."""
    if not all(terms) or not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).where("false")
    any_of = lambda ws: lambda x: x.isin(ws)
    tf = lambda t: F.array(*(F.array_size(F.filter(t, any_of(ws))) for ws in terms))
    # a lambda's variable is evaluated once, however often it is used
    one = F.transform(F.array(tokens("chunk_text")), lambda t: F.struct(F.size(t).alias("size"), tf(t).alias("tf")))[0]
    some = functools.reduce(operator.or_, (F.lower("chunk_text").contains(w) for ws in terms for w in ws))
    seen = Observation()
    counted = chunks.select("chunk_id", "chunk_text").observe(seen, F.count(F.lit(1)).alias("n"))
    found = stash(counted.where(some).select("chunk_id", one.alias("x")).select("chunk_id", "x.*").where(F.exists("tf", lambda n: n > 0)), "fts-hits")
    counts = found.agg(*(F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms)))).first()  # a number a term
    if not all(counts):
        return found.select("chunk_id", F.lit(0.0).alias("score")).where("false")
    return _scored(found.where(F.forall("tf", lambda x: x > 0)), [F.col("tf")[i] for i in range(len(terms))], [math.log(1 + seen.get["n"] / df) for df in counts])


def _scored(rows: DataFrame, tf: list, weights: list[float]) -> DataFrame:
    total = functools.reduce(operator.add, (t * F.lit(w) for t, w in zip(tf, weights)))
    return rows.select("chunk_id", F.round(total / (1 + F.log("size")), 6).alias("score"))


def fts_english(chunks: DataFrame, query: str) -> DataFrame:
    """As ``fts``, by English stems and without stop words: ``debtor`` finds ``debtors``.

    Only distinct words that begin as a stem does are stemmed; a stem's words take its place in the scan.
    """
    terms = sorted({english.stem(w) for w in wanted(query) if w not in english.STOP})
    if not terms:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).where("false")
    begins = {t: english.beginnings(t) for t in terms}
    likely = lambda w: functools.reduce(operator.or_, (w.startswith(head) | w.isin(rest) for head, rest in begins.values()))
    words = chunks.select(F.explode(F.array_distinct(F.filter(tokens("chunk_text"), likely))).alias("word")).distinct()
    # the words of a few stems
    variants = words.withColumn("stem", english.stems(F.col("word"))).where(F.col("stem").isin(terms)).collect()
    return _scan(chunks, [sorted(r["word"] for r in variants if r["stem"] == t) for t in terms])


def vector(embeddings: DataFrame, query: list[float]) -> DataFrame:
    """chunk_id, score by cosine; missing and zero vectors don't take part. Exact, one scan, no shuffle before the sort."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return embeddings.select("chunk_id", F.round(cosine(F.col("embedding"), q), 6).alias("score")).where("score is not null")


def ranked(scores: DataFrame, most: int = RANKED) -> DataFrame:
    """The best rows with their rank from 1; equal scores by id."""
    top = scores.orderBy(F.desc("score"), "chunk_id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # over `most` rows


def fuse(a: DataFrame, b: DataFrame, most: int = RANKED) -> DataFrame:
    """Reciprocal rank fusion of two rankings (Cormack et al., 2009)."""
    left, right = (ranked(x, most).select("chunk_id", F.col("rank").alias(n)) for x, n in ((a, "rank_a"), (b, "rank_b")))
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    return left.join(right, "chunk_id", "full_outer").select("chunk_id", F.round(part("rank_a") + part("rank_b"), 9).alias("score"))


def grouped(chunks: DataFrame, scores: DataFrame, date: str | None = None, titles: DataFrame | None = None) -> DataFrame:
    """A row for each provision hit: key, title, chapter_number, section_ref, heading, matched_version, latest_available,
    versions (the newest first, each once) and score.

    A version is version_id, download_id, as_at_date, version_label and pdf_url; the matched one also has its best chunk's
    chunk_id and chunk_text. Only ids, dates and scores are compared; texts join the winners.
    """
    from statvine.operators.temporal import KEY, cutoff

    within = cutoff(chunks, date)
    version_id = F.col("version_id") if "version_id" in chunks.columns else F.col("download_id")
    heading = F.coalesce("heading", F.lit("")) if "heading" in chunks.columns else F.lit("")
    version = F.struct("as_at_date", "download_id", version_id.alias("version_id"), F.coalesce("version_label", F.lit("")).alias("version_label"), pdf_url(F.col("download_id")).alias("pdf_url"))
    hits = within.select("chunk_id", *KEY, "as_at_date").join(scores, "chunk_id")
    best = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), F.col("as_at_date").desc_nulls_last(), "chunk_id"))
    top = hits.withColumn("nth", best).where("nth = 1").select("chunk_id", "score")
    top = within.join(top, "chunk_id").select(*KEY, heading.alias("heading"), version.withField("chunk_id", F.col("chunk_id")).withField("chunk_text", F.col("chunk_text")).alias("matched_version"), "score")
    by_key = within.join(top.select(*KEY), list(KEY), "left_semi").groupBy(*KEY).agg(F.reverse(F.array_sort(F.collect_set(version))).alias("versions"))
    rows = top.join(by_key, list(KEY)).withColumn("latest_available", F.get(F.filter("versions", lambda v: v["as_at_date"].isNotNull()), F.lit(0))).withColumn("key", F.concat_ws("::", *KEY))
    if titles is None:
        return rows.withColumn("title", F.lit(""))
    return rows.join(titles.select("chapter_number", "title"), "chapter_number", "left").withColumn("title", F.coalesce("title", F.lit("")))


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page and has_more; one row past the page is looked at."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit runs from 1 to 100, offset from 0")
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    numbered = rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # over `limit` + 1 rows
    return numbered.withColumn("has_more", F.max("place").over(Window.partitionBy()) > limit).where(F.col("place") <= limit)


#: Words of a window, and the most passages that have no inner word.
WINDOW, SHORT = 8, 100_000


def _short(docs: DataFrame, passages: list[tuple], items: DataFrame) -> DataFrame:
    """item_id, doc_id, n_chars of the documents that hold a short passage; all hold an empty one."""
    held = docs.sparkSession.sparkContext.broadcast(passages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        of: dict[str, list] = {}
        for item, passage in held.value:
            of.setdefault(passage, []).append(item)
        machine, always = ahocorasick.Automaton(), of.pop("", [])
        for passage in of:
            machine.add_word(passage, passage)
        machine.make_automaton()
        for batch in batches:
            rows, names = [], []
            for at, text in enumerate(batch["text"].to_pylist()):
                seen = {p for _, p in machine.iter(text)} if text and len(machine) else ()
                mine = ([] if text is None else always) + [i for p in seen for i in of[p]]
                rows += [at] * len(mine)
                names += mine
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(names, kinds[0]), taken["doc_id"], taken["n_chars"]], names=["item_id", "doc_id", "n_chars"])

    from pyspark.sql.types import StructField, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([StructField("item_id", items.schema["item_id"].dataType), docs.schema["doc_id"], docs.schema["n_chars"]])
    kinds = to_arrow_schema(schema).types
    return docs.select("doc_id", "n_chars", "text").mapInArrow(run, schema)


def holding(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id, n_chars of the documents (doc_id, n_chars, text) that hold a passage (item_id, passage) as it is.

    Both meet on the hash of the passage's inner words, as many as ``WINDOW`` at most: the first and last word may be parts
    of words of the document. A document gives only the hashes of its windows, no text; passages of less than three words
    have no inner word. These are counted, and an automaton looks for all of them in one pass over a document; more than
    ``SHORT`` are an error.
    """
    words = lambda c: F.split(c, r"\s+")
    keyed = items.withColumn("inner", F.slice(words("passage"), 2, WINDOW)).withColumn("size", F.least(F.lit(WINDOW), F.size(words("passage")) - 2))
    long = keyed.where("size > 0").select("item_id", "passage", "size", F.xxhash64("size", F.slice("inner", F.lit(1), F.col("size"))).alias("key"))
    sizes = [r[0] for r in long.select("size").distinct().collect()]  # at most WINDOW
    cut = docs.select("doc_id", words("text").alias("w"))

    def of_size(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1)), lambda i: F.xxhash64(F.lit(n), F.slice("w", i, n)))

    windows = [of_size(n) for n in sizes]
    near = None
    if windows:
        dealt = cut.select("doc_id", F.explode(F.array_distinct(F.concat(*windows))).alias("key"))
        near = dealt.join(long.select("item_id", "key"), "key").select("item_id", "doc_id").distinct()
    short = keyed.where("size <= 0").select("item_id", "passage")
    found = []
    if near is not None:
        found.append(near.join(docs, "doc_id").join(items, "item_id").where(F.col("text").contains(F.col("passage"))).select("item_id", "doc_id", "n_chars"))
    few = short.limit(SHORT + 1).collect()  # counted by its limit
    if len(few) > SHORT:
        raise ValueError(f"more than {SHORT} passages have less than three words")
    if few:
        found.append(_short(docs, [(r["item_id"], r["passage"]) for r in few], short))
    return functools.reduce(DataFrame.unionByName, found) if found else docs.join(items, F.lit(False)).select("item_id", "doc_id", "n_chars")
