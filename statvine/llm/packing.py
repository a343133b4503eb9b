"""Operator 6, packing into optimal length buckets.

Lengths (words of the whole text) are counted in one exact global histogram, a row for each length that occurs; k different
lengths need a corpus of k * k / 2 words, so even 10**13 words have less than 5 million. Dynamic programming over it
chooses the ``BUCKETS`` boundaries of least total padding, exactly: the cost of ending a bucket at a length is the lower
envelope of one line for each earlier boundary, which whole numbers follow from length to length. Inside a bucket,
batches hold as many texts as fit the token budget when all are padded to the boundary, one at least.

Batches are cut without bringing a bucket together: a bucket is dealt to as many shards as its rows and words ask for,
rows are numbered within a shard by length, and each shard leaves at most one batch that isn't full.

Null or empty texts have length 0 and their own place in the first bucket. A text longer than the budget is a batch
of its own and is not cut. Equal rows take different slots, null ids too. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statvine.llm.common import stash, unused

BUCKETS, BUDGET = 16, 65_536
#: Rows and words that a shard of a bucket should have.
SHARD, SHARD_TOKENS = 20_000, 5_000_000


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def histogram(sizes: DataFrame, n_tokens: str = "n_tokens") -> list[tuple[int, int]]:
    """(length, rows), ascending."""
    counts = sizes.groupBy(n_tokens).agg(F.count("*").alias("rows")).toArrow()
    return sorted(zip(*(c.to_pylist() for c in counts.columns)))


def boundaries(lengths: list[tuple[int, int]], most: int = BUCKETS) -> list[int]:
    """The boundaries, ascending, of at most ``most`` buckets that leave the least padding; the last is the longest length."""
    if not lengths:
        return []
    edge, rows, tokens = [], [0], [0]
    for length, n in lengths:
        edge.append(length)
        rows.append(rows[-1] + n)
        tokens.append(tokens[-1] + length * n)
    n = len(edge)
    best = [edge[j] * rows[j + 1] - tokens[j + 1] for j in range(n)]  # one bucket over the first j + 1 lengths
    cuts = []
    for _ in range(1, min(most, n)):
        new, cut = best.copy(), [-1] * n
        lines: list[tuple[int, int, int]] = []  # slope, height at 0, the length before
        at = 0
        for j in range(1, n):
            slope, height = -rows[j], best[j - 1] + tokens[j]
            while len(lines) > 1 and (height - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope):
                lines.pop()
            lines.append((slope, height, j - 1))
            at = min(at, len(lines) - 1)
            while at + 1 < len(lines) and lines[at + 1][0] * edge[j] + lines[at + 1][1] <= lines[at][0] * edge[j] + lines[at][1]:
                at += 1
            cost = lines[at][0] * edge[j] + lines[at][1] + edge[j] * rows[j + 1] - tokens[j + 1]
            if cost < new[j]:
                new[j], cut[j] = cost, lines[at][2]
        cuts.append(cut)
        best = new
    found, j = [edge[-1]], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            j = cut[j]
            found.append(edge[j])
    return found[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, padded (the bucket's boundary), batch (bucket-shard-number), slot, batch_rows.

    Only ids and lengths are shuffled.
    """
    sizes = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_in("text").alias("n_tokens")), "packing-lengths")
    return _place(sizes, "n_tokens", histogram(sizes), buckets, budget)


def pack_texts(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """All columns of ``docs`` and those of ``pack``; a new column whose name is taken gets underscores at its end."""
    n_tokens = unused(docs, "n_tokens")
    sized = docs.withColumn(n_tokens, words_in("text"))
    return _place(sized, n_tokens, histogram(sized.select(n_tokens), n_tokens), buckets, budget)


def _place(sized: DataFrame, n_tokens: str, lengths: list[tuple[int, int]], buckets: int, budget: int) -> DataFrame:
    edges = boundaries(lengths, buckets) or [0]
    rows, tokens, at = [0] * len(edges), [0] * len(edges), 0
    for length, n in lengths:
        at += length > edges[at]
        rows[at] += n
        tokens[at] += n * length
    shards = [max(1, -(-n // SHARD), -(-t // SHARD_TOKENS)) for n, t in zip(rows, tokens)]
    holds = [max(1, budget // max(1, e)) for e in edges]
    array = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    names = {c: unused(sized, c) for c in ("bucket", "padded", "batch", "slot", "batch_rows", "shard", "number", "shard_rows")}
    col = lambda c: F.col(names[c])
    of_bucket = lambda values: F.element_at(array(values), col("bucket") + 1)
    placed = sized.withColumn(names["bucket"], F.size(F.filter(array(edges), lambda e: e < F.col(n_tokens))))
    placed = placed.withColumn(names["shard"], F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), of_bucket(shards)).cast("int"))
    shard = Window.partitionBy(names["bucket"], names["shard"])
    placed = placed.withColumn(names["number"], F.row_number().over(shard.orderBy(n_tokens, "doc_id")) - 1).withColumn(names["shard_rows"], F.count("*").over(shard))
    piece = F.floor(col("number") / of_bucket(holds))
    placed = placed.withColumns({
        names["padded"]: of_bucket(edges), names["batch"]: F.concat_ws("-", col("bucket"), col("shard"), piece), names["slot"]: (col("number") % of_bucket(holds)).cast("int"),
        names["batch_rows"]: F.least(of_bucket(holds), col("shard_rows") - piece * of_bucket(holds)),
    })
    return placed.drop(names["shard"], names["number"], names["shard_rows"])
