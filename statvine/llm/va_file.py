r"""Operator 11, clustering around centroids through a VA-file.

Vectors are whole numbers: ``floor(SCALE * x)`` of each component. The file holds each of them as one cell of ``BITS`` bits a
component, narrow where numbers are dense (Weber et al., "vector-approximation file", 1998). In a round, tables of each cell's
least and largest squared distance to every centroid add up to an interval a centroid; a vector whose nearest centroid the intervals
settle is not fetched. Full vectors are fetched, by a join with a table bucketed by row number,

* where intervals overlap, and then compared with the centroids whose intervals do, exactly;
* where the cluster changes, as sums of components are carried on by what comes and goes: so for all vectors in the first round;
* for the last assignment, as the result has the distance of each vector: then to its own centroid alone, where that is settled.

All arithmetic is on whole numbers. The driver holds the centroids, their sums and the cells' boundaries, no vector besides.

Kept are arrays of exactly ``DIMENSIONS`` components, none of them null or not finite; null arrays and all other rows give no row of
the result. Repeated rows are vectors of their own. A null id hashes as the text ``1:``; equal hashes go by the vector. With fewer vectors
than centroids each of them is one; without vectors the result is empty. A component of 2**27 or more after scaling is an error, as
its squared distances may not fit into a long. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statvine.llm.common import arrow_schema, shared_dir, stash

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, BITS = 64, 64, 16, 3, 6
MOST = 2**27
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole(rows: DataFrame) -> DataFrame:
    """vec_id, v (array<int>) of the rows that are kept."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.where((F.size("embedding") == DIMENSIONS) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))
    small = F.forall("v", lambda x: F.abs(x) < MOST)
    return kept.select("vec_id", F.when(small, F.col("v").cast("array<int>")).otherwise(F.raise_error(F.lit("a component is too large for whole distances"))).alias("v"))


def matrix(column: pa.Array, dtype=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), DIMENSIONS)


def boundaries(least: int, most: int, quantiles: list[int], cells: int) -> np.ndarray:
    """The first number of each cell but the first, ``cells`` at most: the denser the numbers, the narrower the cell.

    Expected widths are least where cells stand as densely as the root of the numbers' density; no cell is below one number.
    """
    starts, mass = np.unique([least, *quantiles], return_counts=True)
    starts, mass = starts.astype(np.int64), mass.astype(float)
    widths = np.diff(np.append(starts, most + 1))
    share = lambda s: np.minimum(widths, s * np.sqrt(mass * widths))
    low, high = 0.0, float(max(cells, widths.max()))
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if share(middle).sum() <= cells else (low, middle)
    place = np.concatenate(([0.0], np.cumsum(share(low))))
    at = np.interp(np.arange(1, cells), place, np.append(starts, most + 1))
    return np.unique([x for x in np.round(at).astype(np.int64) if least < x <= most])


class Cells:
    """Boundaries of the cells of each component, and the packing of cells into bytes."""

    def __init__(self, least: list[int], most: list[int], quantiles: list[list[int]], bits: int):
        self.bits = bits
        self.edges = [boundaries(a, b, between, 2**bits) for a, b, between in zip(least, most, quantiles)]
        n = 1 + max(len(e) for e in self.edges)
        self.low, self.high = np.zeros((DIMENSIONS, n), np.int64), np.zeros((DIMENSIONS, n), np.int64)
        for d, e in enumerate(self.edges):
            self.low[d, : len(e) + 1] = np.concatenate(([least[d]], e))
            self.high[d, : len(e) + 1] = np.concatenate((e - 1, [most[d]]))

    def pack(self, v: np.ndarray) -> list[bytes]:
        cells = np.stack([np.searchsorted(e, v[:, d], "right") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        return [row.tobytes() for row in np.packbits(bits.reshape(len(v), DIMENSIONS * self.bits), axis=1)]

    def unpack(self, packed: pa.Array) -> np.ndarray:
        rows = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), -1)
        bits = np.unpackbits(rows, axis=1)[:, : DIMENSIONS * self.bits].reshape(len(packed), DIMENSIONS, self.bits)
        return bits @ (1 << np.arange(self.bits)[::-1])

    def intervals(self, cells: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest squared distance of each row of cells to each centroid."""
        c = centroids.T[:, None, :]  # component, cell, centroid
        low, high = self.low[:, :, None], self.high[:, :, None]
        near = np.maximum(np.maximum(low - c, c - high), 0) ** 2
        far = np.maximum(np.abs(low - c), np.abs(high - c)) ** 2
        least, most = (np.zeros((len(cells), len(centroids)), np.int64) for _ in range(2))
        for d in range(DIMENSIONS):
            least += near[d][cells[:, d]]
            most += far[d][cells[:, d]]
        return least, most


def _boundaries(full: DataFrame, bits: int) -> Cells:
    """From quantiles of each component; they bear on how much is fetched, never on the result."""
    fractions = [i / 200 for i in range(1, 200)]
    parts = full.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.percentile_approx("x", fractions, 1000).alias("q"))
    rows = sorted(parts.collect())  # a row a component
    return Cells([r["a"] for r in rows], [r["b"] for r in rows], [r["q"] for r in rows], bits)


def _bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` in the shared folder, bucketed and sorted by ``key``: joins on it move the other side alone."""
    spark = df.sparkSession
    n, called = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{called}").saveAsTable(called)
    return spark.table(called)


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` where ``run`` gives the columns of a batch."""
    arrow = arrow_schema(df.sparkSession, schema)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(run(batch), arrow.types)], schema=arrow)

    return df.mapInArrow(batches, schema)


def _judged(file: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """k, cells, cluster (the last one), may: the centroids that may be nearest, as bits."""

    def run(batch: pa.RecordBatch) -> list:
        least, most = cells.intervals(cells.unpack(batch["cells"]), centroids)
        may = (least <= most.min(axis=1, keepdims=True)) @ (np.int64(1) << np.arange(len(centroids)))
        return [batch["k"], batch["cells"], batch["cluster"], may]

    return _mapped(file.select("k", "cells", "cluster"), run, "k long, cells binary, cluster int, may long")


def _nearest(v: np.ndarray, may: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids in ``may``, the smaller number where several are, and the squared distance."""
    best, cluster = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
    for j, c in enumerate(centroids):
        rows = np.flatnonzero(may >> j & 1)
        away = ((v[rows] - c) ** 2).sum(axis=1)
        closer = away < best[rows]
        best[rows[closer]], cluster[rows[closer]] = away[closer], j
    return cluster, best


def _moved(fetched: DataFrame, centroids: np.ndarray) -> DataFrame:
    """k, cells, cluster of each fetched vector, and rows without k: what a cluster gained, vectors first, then each component."""

    def run(batch: pa.RecordBatch) -> list:
        v, old = matrix(batch["v"]), batch["cluster"].to_numpy(zero_copy_only=False)
        new, _ = _nearest(v, batch["may"].to_numpy(zero_copy_only=False), centroids)
        other = old != new
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMENSIONS), np.int64)
        for where, rows, sign in ((new, other, 1), (old, other & (old >= 0), -1)):
            np.add.at(n, where[rows], sign)
            np.add.at(sums, where[rows], sign * v[rows])
        clusters = np.flatnonzero((n != 0) | sums.any(axis=1))
        gained = np.column_stack([n, sums])[clusters].tolist()
        none = [None] * len(clusters)
        return [batch["k"].to_pylist() + none, batch["cells"].to_pylist() + none, [*new.tolist(), *clusters.tolist()], [None] * len(new) + gained]

    return _mapped(fetched.select("k", "cells", "cluster", "may", "v"), run, "k long, cells binary, cluster int, gained array<long>")


def cluster(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, bits: int = BITS) -> tuple[DataFrame, list[tuple[int, int]]]:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector kept; and for each round but the
    last how many vectors were fetched, and how many of them because intervals overlap."""
    if not 1 <= k <= 62 or not 1 <= bits <= 8:
        raise ValueError("k runs from 1 to 62, bits from 1 to 8")
    spark = rows.sparkSession
    numbered = stash(whole(rows).withColumn("k", F.monotonically_increasing_id()), "va-vectors")  # a lost task can't number anew
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = numbered.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not seeds:
        return spark.createDataFrame([], RESULT), []
    centroids = np.array([r["v"] for r in seeds], np.int64)
    full, cells = _bucketed(numbered, "va_full", "k"), _boundaries(numbered, bits)
    file = stash(_mapped(numbered.select("k", "v"), lambda b: [b["k"], cells.pack(matrix(b["v"])), [-1] * b.num_rows], "k long, cells binary, cluster int"), "va-file")
    sums, report = [[0] * (1 + DIMENSIONS) for _ in seeds], []
    several = F.bit_count("may") > 1
    for _ in range(rounds):
        judged = stash(_judged(file, cells, centroids), "va-judged")
        wanted = F.when(F.col("cluster") < 0, True).otherwise(several | (F.getbit("may", F.greatest("cluster", F.lit(0))) == 0))
        report.append(tuple(judged.agg(F.count_if(wanted), F.count_if(several)).first()))
        moved = stash(_moved(judged.where(wanted).join(full, "k"), centroids), "va-moved")
        gains = moved.where("k is null").select("cluster", F.posexplode("gained").alias("d", "x")).groupBy("cluster", "d").agg(F.sum("x").alias("x"))
        for r in gains.collect():  # a row a cluster and component
            sums[r["cluster"]][r["d"]] += r["x"]
        centroids = np.array([[s // own[0] for s in own[1:]] if own[0] else c for own, c in zip(sums, centroids.tolist())], np.int64)
        file = judged.where(~wanted).select("k", "cells", "cluster").unionByName(moved.where("k is not null").select("k", "cells", "cluster"))

    def last(batch: pa.RecordBatch) -> list:
        return [batch["vec_id"], *_nearest(matrix(batch["v"]), batch["may"].to_numpy(zero_copy_only=False), centroids)]

    found = _mapped(_judged(file, cells, centroids).select("k", "may").join(full, "k").select("vec_id", "may", "v"), last, "vec_id long, cluster int, distance long")
    found = stash(found, "va-assigned")
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    of = lambda values, kind: F.array(*(F.lit(x).cast(kind) for x in values))[F.col("cluster")]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return found.select("vec_id", "cluster", "distance", of([own.get(j, 0) for j in range(len(seeds))], "long").alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"), of(hashes, "string").alias("centroid_sha256")), report
