"""Exact vector search for many queries at once, over cells whose bounds leave whole cells out.

Vectors of length one lie in cells around centres; a cell keeps the largest angle of its vectors to its centre, so by the triangle inequality
of angles no vector of it is nearer to a query than the angle to the centre less that radius, nor farther than their sum. Centres come
from a bounded sample and bear on how much is read, never on a result. A cell lies in blocks of at most ``BLOCK`` vectors; a
block meets the queries that need it as two matrices in one task, and leaves the best of each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statvine.sources.shared import keep, stash

#: Vectors of a block, vectors that centres are fitted to, rounds of fitting, and most cells.
BLOCK, SAMPLE, ROUNDS, MOST_CELLS = 4096, 20_000, 8, 1024
#: Angles are compared with this much room for rounding.
ROOM = 1e-6


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(vectors: DataFrame) -> DataFrame:
    """id and v, the vectors of length one; missing, empty and zero vectors and such with missing or infinite components take no part."""
    x = F.transform("embedding", lambda y: y.cast("double"))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y))
    rows = vectors.where(F.col("embedding").isNotNull()).withColumn("length", length).where((F.col("length") > 0) & (F.col("length") < float("inf")))
    return rows.select("id", F.transform(x, lambda y: y / F.col("length")).alias("v"))


def centres(v: np.ndarray, n: int) -> np.ndarray:
    """``n`` directions that ``v`` lies around, by spherical k-means from the farthest points."""
    chosen, near = [0], v @ v[0]
    while len(chosen) < min(n, len(v)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, v @ v[chosen[-1]])
    c = v[chosen]
    for _ in range(ROUNDS):
        of = (v @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, of, v)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 1e-12, total / np.maximum(length, 1e-12), c)
    return c


@dataclass(frozen=True)
class Cells:
    """vectors: cell, block, id, v. sizes: of each cell its blocks, vectors and largest angle; ``centre`` of each on the driver, as there
    are at most ``MOST_CELLS``."""

    vectors: DataFrame
    centre: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    blocks: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, n_cells: int | None = None, sample: int = SAMPLE) -> "Cells":
        """vectors: id (any orderable type, each once), embedding; all of one length."""
        spark = vectors.sparkSession
        rows = stash(unit(vectors), "cells-unit")
        n = rows.count()
        fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()  # at most `sample` vectors
        v = _matrix(fitted["v"])
        c = centres(v, n_cells or min(MOST_CELLS, max(1, int(n**0.5) // 2))) if len(v) else np.zeros((0, 0))
        of_id = rows.schema["id"].dataType.simpleString()
        schema = f"cell int, id {of_id}, v array<double>, angle double"
        arrow = _arrow(spark, schema)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _matrix(batch["v"]) @ c.T
                    cell = near.argmax(1)
                    angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch["id"], batch["v"], pa.array(angle)], schema=arrow)

        assigned = stash(rows.mapInArrow(assign, schema), "cells-assigned")
        sizes = assigned.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect()  # a row a cell
        radius, count = np.zeros(len(c)), np.zeros(len(c), np.int64)
        for r in sizes:
            radius[r["cell"]], count[r["cell"]] = r["radius"], r["n"]
        blocks = np.maximum(1, -(-count // BLOCK))
        dealt = F.pmod(F.xxhash64("id"), F.array(*(F.lit(int(b)) for b in blocks))[F.col("cell")] if len(c) else F.lit(1)).cast("int")
        stored = assigned.select("cell", dealt.alias("block"), "id", "v").repartitionByRange("cell", "block").sortWithinPartitions("cell", "block")
        return cls(keep(stored, "cells")[0], c, radius, count, blocks)  # outlives a scratch

    def _bounds(self, queries: DataFrame, extra: tuple[str, ...], choose) -> DataFrame:
        """``extra`` columns, v and cell of each query for the cells that ``choose`` (least and largest angle to a cell's vectors, the rows) wants."""
        schema = ", ".join([*(f"{c} {queries.schema[c].dataType.simpleString()}" for c in extra), "v array<double>", "cell int"])
        arrow = _arrow(queries.sparkSession, schema)
        centre, radius, count = self.centre, self.radius, self.count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(centre):
                    continue
                angle = np.arccos(np.clip(_matrix(batch["v"]) @ centre.T, -1, 1))
                q, cell = np.nonzero(choose(np.maximum(0, angle - radius), np.minimum(np.pi, angle + radius), batch) & (count > 0))
                taken = batch.take(pa.array(q))
                yield pa.RecordBatch.from_arrays([*(taken[c] for c in (*extra, "v")), pa.array(cell, pa.int32())], schema=arrow)

        return queries.select(*extra, "v").mapInArrow(run, schema)

    def _meet(self, asked: DataFrame, extra: tuple[str, ...], schema: str, score) -> DataFrame:
        """``score`` of the cosines (queries by vectors) of the queries that need a block, their rows and the block's ids."""
        blocks = F.array(*(F.lit(int(b)) for b in self.blocks))[F.col("cell")]
        wanted = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).groupBy("cell", "block")
        arrow = _arrow(asked.sparkSession, schema)

        def run(q: pa.Table, x: pa.Table) -> pa.Table:
            if not q.num_rows or not x.num_rows:
                return pa.table([pa.array([], f.type) for f in arrow], schema=arrow)
            x = x.sort_by("id")
            v, parts = _matrix(x["v"]), []
            for at in range(0, q.num_rows, BLOCK):  # however many queries need a block, two matrices stand in memory
                part = q.slice(at, BLOCK)
                parts.append(score(_matrix(part["v"]) @ v.T, part, x["id"].combine_chunks()))
            return pa.table([pa.concat_arrays([pa.array(p[i]).cast(f.type) for p in parts]) for i, f in enumerate(arrow)], schema=arrow)

        return wanted.cogroup(self.vectors.groupBy("cell", "block")).applyInArrow(run, schema)

    def search(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """query, id, score (cosine) and rank of each query's ``k`` nearest, equal ones by id; and query and read, the share of all
        vectors that it was compared with.

        queries: query (each once), embedding. First the nearest cells that hold ``k`` vectors are read; then all others whose bound reaches
        the k-th best so far.
        """
        spark = queries.sparkSession
        of_query, of_id = queries.schema["query"].dataType.simpleString(), self.vectors.schema["id"].dataType.simpleString()
        asked = stash(unit(queries.withColumnRenamed("query", "id")).withColumnRenamed("id", "query"), "cells-queries")
        schema, count = f"query {of_query}, id {of_id}, score double", self.count

        def best(cosine: np.ndarray, q: pa.Table, ids: pa.Array) -> list:
            cosine = np.round(cosine, 9)
            n = min(k, cosine.shape[1])
            kth = np.partition(cosine, -n, axis=1)[:, -n]
            row, column = np.nonzero(cosine >= kth[:, None])
            order = np.lexsort((column, -cosine[row, column], row))
            row, column = row[order], column[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < n
            row, column = row[first], column[first]
            return [q["query"].combine_chunks().take(pa.array(row)), ids.take(pa.array(column)), pa.array(cosine[row, column])]

        def nearest(low: np.ndarray, high: np.ndarray, _) -> np.ndarray:
            order = np.argsort(low + high, axis=1, kind="stable")
            before = np.cumsum(count[order], axis=1) - count[order]
            chosen = np.zeros(low.shape, bool)
            np.put_along_axis(chosen, order, before < k, axis=1)
            return chosen

        top = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        cut = lambda df: df.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        begun = stash(self._bounds(asked, ("query",), nearest), "cells-begun")
        first = stash(cut(self._meet(begun, ("query",), schema, best)).drop("rank"), "cells-first")
        reached = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1.0).alias("least"))
        known = asked.join(reached, "query")

        def others(low: np.ndarray, high: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            least = np.arccos(np.clip(batch["least"].to_numpy(), -1, 1))
            return (low <= least[:, None] + ROOM) & ~nearest(low, high, batch)

        more = stash(self._bounds(known, ("query", "least"), others), "cells-more")
        second = self._meet(more, ("query",), schema, best)
        found = cut(first.unionByName(second))
        number = F.array(*(F.lit(int(x)) for x in self.count))[F.col("cell")] if len(self.count) else F.lit(0)
        read = begun.select("query", "cell").unionByName(more.select("query", "cell")).groupBy("query").agg((F.sum(number) / max(1, int(self.count.sum()))).alias("read"))
        return found, read

    def ranks(self, targets: DataFrame) -> DataFrame:
        """query, target, rank: at which place a search for the query finds its target; targets that aren't there have none.

        targets: query, embedding, target (an id). Cells that are all nearer than the target are counted unread, cells that are all farther are left out.
        """
        of_query, of_id = targets.schema["query"].dataType.simpleString(), self.vectors.schema["id"].dataType.simpleString()
        aims = targets.select("query", "target")
        asked = unit(targets.select(F.col("query").alias("id"), "embedding")).withColumnRenamed("id", "query").join(aims, "query")
        own = asked.join(self.vectors.select(F.col("id").alias("target"), F.col("v").alias("w")), "target")
        cosine = F.round(F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 9)
        known = stash(own.select("query", "target", "v", cosine.alias("aim")), "cells-aims")
        keep = ("query", "target", "aim")
        angle = lambda b: np.arccos(np.clip(b["aim"].to_numpy(), -1, 1))[:, None]
        nearer = self._bounds(known, keep, lambda low, high, b: high < angle(b) - ROOM)
        doubtful = self._bounds(known, keep, lambda low, high, b: (high >= angle(b) - ROOM) & (low <= angle(b) + ROOM))

        def better(cosine: np.ndarray, q: pa.Table, ids: pa.Array) -> list:
            cosine, aim = np.round(cosine, 9), q["aim"].to_numpy()[:, None]
            names = np.array(ids.to_pylist())
            target = np.array(q["target"].to_pylist())[:, None]
            n = ((cosine > aim) | ((cosine == aim) & (names[None, :] < target))).sum(1)
            return [q["query"].combine_chunks(), pa.array(n)]

        number = F.array(*(F.lit(int(x)) for x in self.count))[F.col("cell")] if len(self.count) else F.lit(0)
        parts = self._meet(doubtful, keep, f"query {of_query}, n long", better).unionByName(nearer.select("query", number.cast("long").alias("n")))
        ahead = parts.groupBy("query").agg(F.sum("n").alias("n"))
        return known.select("query", "target").join(ahead, "query", "left").select("query", "target", (F.coalesce("n", F.lit(0)) + 1).alias("rank"))
