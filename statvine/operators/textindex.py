"""A stored inverted index with positions, for many queries: words, phrases and English stems.

Every batch of texts is a block; it leaves one row a term: how many of its chunks hold the term, their ids, lengths, counts and positions, all as
differences. So no row or task holds all of a frequent term, and building needs no grouping. Rows are dealt by ranges of (term, block) of about equal
size and lie sorted in their files, so a query reads the row groups of its words alone. Words of one block meet in one task, as arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statvine.functions.english import STOP, stem
from statvine.sources.shared import keep, stash

ROW = "term string, block string, n long, ids array<long>, sizes array<int>, counts array<int>, places array<int>"
WORD = np.zeros(256, bool)
WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _block(ids: np.ndarray, texts: list[bytes], name: str, english: bool, schema: pa.Schema) -> pa.RecordBatch:
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[i] for i in order]
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    letters = np.ascontiguousarray(data[inside])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    code, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
    chunk = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    size = np.bincount(chunk, minlength=len(texts))
    place = np.arange(len(starts)) - np.concatenate(([0], np.cumsum(size)))[chunk]
    if english:  # distinct words are stemmed, stop words leave no posting but keep their place and count
        found: dict[str, int] = {}
        to = np.array([-1 if w in STOP else found.setdefault(stem(w), len(found)) for w in names], np.int64)
        code, names = to[code], list(found)
        chunk, place, code = chunk[code >= 0], place[code >= 0], code[code >= 0]
    if not len(code):
        return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
    order = np.lexsort((place, chunk, code))
    code, chunk, place = code[order], chunk[order], place[order]
    pair = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(chunk, prepend=-1) != 0))  # the first of each term and chunk
    term = np.flatnonzero(np.diff(code[pair], prepend=-1) != 0)  # the first of each term
    delta = np.diff(place, prepend=0)
    delta[pair] = place[pair]
    chunks = ids[chunk[pair]]
    steps = np.diff(chunks, prepend=0)
    steps[term] = chunks[term]
    counts = np.diff(np.append(pair, len(code)))
    columns = [
        pa.array([names[i] for i in code[pair[term]]]), pa.array([name] * len(term)), pa.array(np.diff(np.append(term, len(pair)))),
        _lists(steps, term, pa.int64()), _lists(size[chunk[pair]], term, pa.int32()), _lists(counts, term, pa.int32()), _lists(delta, pair[term], pa.int32()),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _wanted(query: str, english: bool) -> list[tuple[str, int]]:
    """The terms of a query and their places in it."""
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in query.lower()).split()
    return [(stem(w) if english else w, i) for i, w in enumerate(words) if not (english and w in STOP)]


@dataclass(frozen=True)
class TextIndex:
    """The stored postings, how many chunks there are, and whether terms are English stems."""

    rows: DataFrame
    n: int
    english: bool

    @classmethod
    def build(cls, chunks: DataFrame, english: bool = False) -> "TextIndex":
        """chunks: chunk_id (whole numbers, each once), chunk_text. Written to the shared folder, once for many queries."""
        spark = chunks.sparkSession
        schema = _arrow(spark, ROW)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch["chunk_id"].to_numpy(zero_copy_only=False)
                if len(ids):  # ids are each in one block only, so the first tells blocks apart
                    yield _block(ids, [t or b"" for t in batch["text"].to_pylist()], f"{ids[0]}", english, schema)

        rows = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.lower("chunk_text").cast("binary").alias("text")).mapInArrow(run, ROW)
        stored, _ = keep(stash(rows, "text-blocks").repartitionByRange("term", "block").sortWithinPartitions("term", "block"), "text-index")  # outlives a scratch
        return cls(stored, chunks.count(), english)

    def _together(self, query: str, schema: str, meet) -> DataFrame:
        """``meet`` gets, for each block that holds all terms, the terms' rows of that block."""
        terms = sorted({t for t, _ in _wanted(query, self.english)})
        arrow = _arrow(self.rows.sparkSession, schema)

        def run(t: pa.Table) -> pa.Table:
            rows = {r["term"]: r for r in t.to_pylist()}
            found = meet(rows) if len(rows) == len(terms) else [[] for _ in arrow]
            return pa.table([pa.array(c, f.type) for c, f in zip(found, arrow)], schema=arrow)

        return self.rows.where(F.col("term").isin(terms)).groupBy("block").applyInArrow(run, schema)

    def _weights(self, query: str) -> dict[str, float]:
        """ln(1 + N / df) of each term; empty where some term is nowhere."""
        terms = {t for t, _ in _wanted(query, self.english)}
        df = {r["term"]: r["n"] for r in self.rows.where(F.col("term").isin(sorted(terms))).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
        return {t: math.log(1 + self.n / df[t]) for t in sorted(terms)} if len(df) == len(terms) else {}

    def fts(self, query: str) -> DataFrame:
        """chunk_id, score of the chunks that hold every term: sum of tf * ln(1 + N / df) / (1 + ln(size))."""
        weights, schema = self._weights(query), "chunk_id long, score double"
        if not weights:
            return self.rows.sparkSession.createDataFrame([], schema)

        def meet(rows: dict[str, dict]) -> list:
            at = _common(rows)
            if not len(at):
                return [[], []]
            total = np.zeros(len(at))
            for t, w in weights.items():
                place = np.searchsorted(np.cumsum(rows[t]["ids"]), at)
                total += np.array(rows[t]["counts"])[place] * w
            return [at, np.round(total / (1 + np.log(np.array(rows[t]["sizes"])[place])), 6)]

        return self._together(query, schema, meet)

    def phrase(self, query: str) -> DataFrame:
        """chunk_id, hits: how often the query's words stand there one after the other; stop words leave a gap of any one word."""
        wanted, schema = _wanted(query, self.english), "chunk_id long, hits long"
        if not wanted:
            return self.rows.sparkSession.createDataFrame([], schema)

        def meet(rows: dict[str, dict]) -> list:
            at = _common(rows)
            begins = None
            for term, offset in wanted:
                r = rows[term]
                counts, ids = np.array(r["counts"]), np.cumsum(r["ids"])
                total = np.cumsum(r["places"])
                base = np.repeat(np.concatenate(([0], total[np.cumsum(counts)[:-1] - 1])), counts)
                which = np.repeat(np.searchsorted(at, ids), counts)
                inside = np.repeat(np.isin(ids, at), counts)
                begin = (which[inside] << 32) + (total - base)[inside] - offset + len(query)
                begins = begin if begins is None else np.intersect1d(begins, begin, assume_unique=True)
            chunk, hits = np.unique(begins >> 32, return_counts=True)
            return [at[chunk], hits]

        return self._together(query, schema, meet)


def _common(rows: dict[str, dict]) -> np.ndarray:
    found = None
    for r in rows.values():
        ids = np.cumsum(r["ids"])
        found = ids if found is None else np.intersect1d(found, ids, assume_unique=True)
    return found
