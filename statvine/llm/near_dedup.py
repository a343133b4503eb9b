r"""Operator 9, near-duplicates by SetSketch registers.

A text's set holds its distinct word shingles (words ``[^\x20\x09-\x0D]+``, A-Z lower-cased; a text with fewer words
than a shingle has one, all of them), as 64-bit hashes. Its sketch has ``BANDS * WIDTH`` registers: the least of an
exponential variate of each shingle, on a scale of powers of ``BASE``, truncated to a byte (Ertl, "SetSketch",
2021). Sketches of two sets merge by the larger register. Then

1. texts of the same words form one class, represented by its least doc_id; copies are never expanded;
2. bands of registers deal the classes into buckets; each class meets the least class of its bucket, and the joint
   likelihood of both sketches estimates their similarity; those of ``LEAST_ESTIMATE`` and more
   join into clusters, which is far below any link's similarity, as leaders are only a meeting point. In buckets
   that still hold several clusters, all pairs of different clusters meet in the same way, so none is lost to
   an unlike leader. A bucket of more than ``MEET`` such rows is dealt anew by bands of its registers in another order, each row once a
   band, with leaders of its own, ``LEVELS`` times if need be; only what is hot even then is cut into blocks that meet in pairs;
3. within a cluster, pairs that are not yet connected are compared on their full sets, exactly, in numpy: one set
   against all others at a time. A cluster of more than ``BLOCK`` shingles or ``SETS`` sets is cut into blocks. First each
   block compares its members and the cluster's leader, then only what is outside the cluster's largest part
   meets the other blocks, a block at a time: a group of near copies costs one more reading of its texts, not the
   square of its blocks. Only links that connect something new are written, at most one a text and task;
4. links join classes into components.

A pair of similarity s shares a band with probability 1 - (1 - s**WIDTH)**BANDS: misses are below 3e-9 at 0.85 and
3e-6 at 0.8. Null text and texts without words have an empty set, link with nothing and are their own
component. A null doc_id never represents a component unless all its ids are null; then the component is null
and the row is kept. Repeated rows share a component; those whose id is the least are all marked as kept, and
``keep_one`` leaves one of them. Different texts under one id are told apart by a hash of the text. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statvine.llm.common import arrow_schema, bare, map_rows, stash, to_batch, unused
from statvine.operators.communities import connected_components

BANDS, WIDTH = 42, 6
REGISTERS = BANDS * WIDTH
BASE, RATE = 1.1, 20.0
LEAST_ESTIMATE = 0.5
#: Shingles and sets of a cluster in a block.
BLOCK, SETS = 2_000_000, 4096
SALTS = 64
#: Rows of a table of large clusters that may be broadcast; beyond it is joined.
MOST_BROADCAST = 200_000
#: Rows of a bucket in a block, and how often larger buckets are dealt anew; each time registers are read in steps of another width.
MEET, LEVELS, STEPS = 4096, 2, (1, 5, 11)
#: Words whose hashes a task remembers.
CACHE = 300_000
_ODD = np.random.default_rng(9).integers(0, 1 << 31, REGISTERS, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(10).integers(0, 1 << 32, REGISTERS, np.uint32)
_MIX = np.random.default_rng(12).integers(1, 1 << 63, 16, np.uint64) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], size: int, hashes: WordHashes) -> np.ndarray:
    """The set of a text, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], np.uint64)
    size = min(size, len(h))
    total = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        total = _scramble(total + h[k : len(h) - size + 1 + k] * _MIX[k])
    return np.unique(total)


def sketch(items: np.ndarray) -> np.ndarray:
    """The registers of a set."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        block = short[None, at : at + 1024] * _ODD[:, None]
        block += _ADD[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    variate = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / math.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities of pairs of sketches of sets of known sizes, by the joint likelihood of their registers."""
    share_a = (n_a / (n_a + n_b))[:, None]
    share_b = 1 - share_a
    most = np.minimum(share_a / share_b, share_b / share_a)
    s = _GRID[None, :] * most
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = chance(share_a - share_b * s), chance(share_b - share_a * s)
    d_more, d_less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    log = lambda x: np.log(np.maximum(x, 1e-12))
    like = d_more * log(more) + d_less * log(less) + (a.shape[1] - d_more - d_less) * log(1 - more - less)
    return np.take_along_axis(s, like.argmax(1)[:, None], 1)[:, 0]


def link(sets: list[np.ndarray], part: np.ndarray, within: tuple[bool, bool], percent: int, start: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all pairs of similarity of at least percent / 100, directly or through others.

    part: 0 or 1 for each set; sets of the same part are compared only if ``within`` says so. start: numbers from 0 on;
    sets of an equal number are connected already.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    label, links = np.arange(n) if start is None else start.copy(), []

    def connect(x: int, y: int) -> None:
        if label[x] != label[y]:
            links.append((x, y))
            of_x, of_y = label == label[x], label == label[y]
            if of_x.sum() < of_y.sum():
                label[of_x] = label[y]
            else:
                label[of_y] = label[x]

    comparable = lambda x: (part != part[x]) | within[part[x]]
    enough = lambda inter, x, ys: 100 * inter >= percent * (size[x] + size[ys] - inter)
    if n <= 8:
        for x in range(n):
            for y in range(x + 1, n):
                if label[x] != label[y] and 100 * min(size[x], size[y]) >= percent * max(size[x], size[y]) and comparable(x)[y]:
                    inter = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if enough(inter, x, y):
                        connect(x, y)
        return links
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    common = times[item] > 1
    central = np.bincount(owner, times[item], n) / np.maximum(1, size)
    item, owner = item[common], owner[common]
    held = np.bincount(owner, minlength=n)
    at = np.concatenate([[0], np.cumsum(held)])
    flag = np.zeros(len(times), np.int32)
    waiting = np.ones(n, bool)

    class Pool:
        """Some sets, side by side."""

        def __init__(self, member: np.ndarray) -> None:
            self.rows = np.flatnonzero(member)
            self.item = item[member[owner]]
            self.at = np.concatenate([[0], np.cumsum(held[self.rows])])

        def shared(self) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flag[self.item])])[self.at])

    everything, outside, main = Pool(waiting), None, -1
    order = np.argsort(-central, kind="stable")
    if not any(within):  # all pairs have a set in the smaller part
        order = order[part[order] == int((part == 0).sum() > (part == 1).sum())]
    for x in order.tolist():
        counts = np.bincount(label[waiting], minlength=n)
        largest = int(counts.argmax())
        left = int(waiting.sum())
        if counts[largest] == left and waiting[x] and label[x] == largest:
            break
        if left < 0.8 * len(everything.rows):
            everything = Pool(waiting)
        pool = everything
        if label[x] == largest and counts[largest] > 0.2 * left:
            if outside is None or main != largest or left - counts[largest] < 0.8 * len(outside.rows):
                outside, main = Pool(waiting & (label != largest)), largest
            pool = outside
        own = item[at[x] : at[x + 1]]
        flag[own] = 1
        inter = pool.shared()
        flag[own] = 0
        ys = pool.rows
        good = enough(inter, x, ys) & waiting[ys] & (label[ys] != label[x]) & comparable(x)[ys]
        for y in ys[good].tolist():
            connect(x, y)
        waiting[x] = False
    return links


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, mark, n_shingles, the digest of the words and the registers (null for an empty set)."""
    made = WordHashes()

    def rows(batch: pa.RecordBatch):
        for doc_id, mark, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "text"))):
            words = text.lower().split()
            items = shingles(words, size, made)
            yield doc_id, mark, len(items), digest(words), sketch(items).tobytes() if len(items) else None

    return map_rows(_marked(docs), rows, "doc_id long, mark long, n_shingles long, digest binary, registers binary")


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def meet(registers: np.ndarray, size: np.ndarray, label: np.ndarray, part: np.ndarray, within: tuple[bool, bool]) -> list[tuple[int, int]]:
    """Pairs of labels to join, so that all pairs of rows of an estimate of at least ``LEAST_ESTIMATE`` share one.

    part, within: as in ``link``.
    """
    names, label, times = np.unique(label, return_inverse=True, return_counts=True)
    main = label == times.argmax()  # these share a label already
    rest, found = np.flatnonzero(~main), []
    for x in rest.tolist():
        good = (main | (np.arange(len(label)) > x)) & (label != label[x])
        good &= np.minimum(size, size[x]) >= LEAST_ESTIMATE * np.maximum(size, size[x])
        if not within[part[x]]:
            good &= part != part[x]
        ys = np.flatnonzero(good)
        # registers of similar sets are equal at least as often as the sets are similar
        ys = ys[(registers[ys] == registers[x]).sum(1) >= LEAST_ESTIMATE * REGISTERS]
        if len(ys):
            ys = ys[estimate(registers[ys], np.broadcast_to(registers[x], (len(ys), REGISTERS)), size[ys], np.full(len(ys), size[x])) >= LEAST_ESTIMATE]
        for y in np.unique(label[ys]).tolist():
            found.append((int(names[y]), int(names[label[x]])))
        label[np.isin(label, label[ys])] = label[x]
    return found


def unmet(shared: DataFrame, classes: DataFrame, labels: DataFrame, level: int = 0) -> DataFrame:
    """a, b: labels to join, from the buckets whose classes (without the leader, who met all) have several labels."""
    rows = shared.where("n > 2").select("bucket", "class").join(labels, "class", "left").select("bucket", "class", F.coalesce("cluster", "class").alias("label"))
    counted = rows.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count("*") / F.lit(MEET)).cast("int").alias("blocks"))
    counted = stash(counted.where("x < y").select("bucket", "blocks"), "dedup-several")
    hot = counted.where("blocks > 1")
    if level == LEVELS or hot.isEmpty():
        return _in_blocks(rows.join(counted, "bucket"), classes)
    found = _in_blocks(rows.join(counted.where("blocks = 1"), "bucket"), classes)
    again = rows.join(hot.select("bucket"), "bucket").select("bucket", "class").join(classes.select("class", "registers"), "class")
    finer = _led(_banded(again, level + 1, "bucket"))
    of = lambda c, name: labels.select(F.col("class").alias(c), F.col("cluster").alias(name))
    near = _met(finer, classes).join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    near = stash(near.where("a <> b").distinct(), "dedup-near")
    return found.unionByName(near).unionByName(unmet(finer, classes, _relabelled(labels, near), level + 1))


def _in_blocks(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: labels to join, from all pairs of different labels within a bucket, by pairs of its blocks."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class", F.lit(1)), "blocks").cast("int")).join(classes.select("class", "n_shingles", "registers"), "class")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")))
    dealt = rows.withColumn("other", F.explode(others)).select("bucket", "label", "blocks", "own", "n_shingles", "registers", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    schema = "a long, b long"
    arrow = arrow_schema(classes.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            label, own, size, registers = zip(*held)
            _, i, j, blocks = key
            within = (True, True) if blocks == 1 else (j == i + 1, j == i + 1 and j == blocks - 1)
            table = np.frombuffer(b"".join(registers), np.uint8).reshape(-1, REGISTERS)
            return meet(table, np.array(size, float), np.array(label, np.int64), (np.array(own) != i).astype(int), within)

        for batch in batches:
            out = []
            for bucket, i, j, blocks, *row in zip(*(batch[x].to_pylist() for x in ("bucket", "i", "j", "blocks", "label", "own", "n_shingles", "registers"))):
                if (bucket, i, j, blocks) != key:
                    out += found()
                    key, held = (bucket, i, j, blocks), []
                held.append(row)
            yield to_batch(out, arrow)
        yield to_batch(found(), arrow)

    return dealt.mapInArrow(run, schema)


def _banded(rows: DataFrame, level: int, *within: str) -> DataFrame:
    """class, bucket: ``BANDS`` buckets of each row (class, registers), apart by the columns ``within``; each level bands other registers together."""
    if level:
        letters = lambda i: F.concat(*(F.substring(F.col("registers"), ((i * WIDTH + k) * STEPS[level]) % REGISTERS + 1, F.lit(1)) for k in range(WIDTH)))
    else:
        letters = lambda i: F.substring(F.col("registers"), i * WIDTH + 1, F.lit(WIDTH))
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, letters(i))))
    return rows.select("class", *within, bands.alias("band", "key")).select("class", F.xxhash64(*within, "band", "key").alias("bucket"))


def _led(rows: DataFrame) -> DataFrame:
    """bucket, class, leader, n of the buckets (class, bucket) that hold several classes, but for the leaders' own rows."""
    # partial minima shrink a hot bucket before the shuffle; most buckets hold one class and leave here
    leaders = rows.groupBy("bucket").agg(F.min("class").alias("leader"), F.max("class").alias("last"), F.count("*").alias("n")).where("leader < last").select("bucket", "leader", "n")
    return stash(rows.join(leaders, "bucket").where("class <> leader"), "dedup-shared")


def _met(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes that are likely like their buckets' leaders."""
    met = shared.select("class", "leader").distinct()
    one = classes.select("class", "n_shingles", "registers")
    pairs = met.join(one, "class").join(one.select(F.col("class").alias("leader"), F.col("n_shingles").alias("n"), F.col("registers").alias("r")), "leader")

    def likely(batch: pa.RecordBatch):
        table = lambda c: np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, REGISTERS)
        if not batch.num_rows:
            return []
        found = estimate(table("registers"), table("r"), batch["n_shingles"].to_numpy().astype(float), batch["n"].to_numpy().astype(float))
        good = np.flatnonzero(found >= LEAST_ESTIMATE)
        return list(zip(batch["class"].to_numpy()[good].tolist(), batch["leader"].to_numpy()[good].tolist()))

    return map_rows(pairs, likely, "a long, b long")


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """class, cluster after joining labels by edges; a class without a cluster is its own label."""
    joined = _joined(edges)
    known = labels.join(joined.select(F.col("node").alias("cluster"), "label"), "cluster", "left").select("class", F.coalesce("label", "cluster").alias("cluster"))
    alone = joined.join(labels.select(F.col("cluster").alias("node")).distinct(), "node", "left_anti")
    return known.unionByName(alone.select(F.col("node").alias("class"), F.col("label").alias("cluster")))


def clusters(classes: DataFrame) -> DataFrame:
    """class, cluster of the classes that meet another one."""
    shared = _led(_banded(classes.where("n_shingles > 0").select("class", "registers"), 0))
    labels = stash(_joined(_met(shared, classes)).withColumnsRenamed({"node": "class", "label": "cluster"}), "dedup-met")
    more = stash(unmet(shared, classes, labels), "dedup-unmet")
    return labels if more.isEmpty() else _relabelled(labels, more)


def _joined(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node on an edge a, b."""
    return connected_components(edges.select(F.col("a").alias("source"), F.col("b").alias("target"))).select(F.col("id").alias("node"), F.col("component").alias("label"))


def _blocks() -> Column:
    """How many blocks hold the rows of a group, by shingles and by sets."""
    return F.greatest(F.ceil(F.sum("n_shingles") / F.lit(BLOCK)), F.ceil(F.count("*") / F.lit(SETS))).cast("int")


def _small(written: DataFrame) -> DataFrame:
    """To be broadcast, if its rows, some numbers each, are few; a large cluster's members then stay where they are."""
    return F.broadcast(written) if written.count() <= MOST_BROADCAST else written


def links(docs: DataFrame, classes: DataFrame, clustered: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: classes whose full sets are similar enough, as many as connect them.

    First every block of a cluster links its own members and the cluster's leader, so that one leader ties near copies
    together over all blocks. What is then outside the cluster's largest part meets the other blocks; members of one part
    are never compared again.
    """
    members = clustered.join(classes.select("class", "doc_id", "mark", "n_shingles"), "class")
    blocks = members.groupBy("cluster").agg(_blocks().alias("blocks"), F.min(F.struct(F.xxhash64("class"), "class")).alias("x"))
    large = _small(stash(blocks.where("blocks > 1").select("cluster", "blocks", F.col("x.class").alias("leader")), "dedup-large"))
    members = members.join(large, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    lead = F.when(F.col("class") == F.col("leader"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    first = members.select("class", "cluster", "doc_id", "mark", F.lit(0).alias("i"), F.explode(lead).alias("j"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("label"), F.lit(True).alias("all"))
    found = stash(_verify(docs, first, size, percent), "dedup-links")
    if large.isEmpty():
        return found
    many = members.where("blocks > 1").select("class", "cluster", "doc_id", "mark", "n_shingles", "own", "blocks")
    parts = _joined(found)
    many = many.join(parts.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    main = many.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    many = stash(many.join(_small(stash(main, "dedup-main")), "cluster"), "dedup-parts")
    outside = many.where("label <> main")
    dealt = _small(stash(outside.groupBy("cluster").agg(_blocks().alias("outer")), "dedup-outside"))
    # block i of what is outside meets block j of the whole cluster
    rows = outside.join(dealt, "cluster").withColumn("i", F.pmod(F.xxhash64("class", F.lit(2)), "outer").cast("int"))
    asks = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("part", F.lit(0))
    told = many.join(dealt, "cluster").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).withColumn("j", F.col("own")).withColumn("part", F.lit(1))
    second = [x.select("class", "cluster", "doc_id", "mark", "i", "j", "part", "label", F.lit(False).alias("all")) for x in (asks, told)]
    return found.unionByName(_verify(docs, second[0].unionByName(second[1]), size, percent))


def _verify(docs: DataFrame, dealt: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links on full sets among the classes that meet in one (cluster, i, j).

    all: every pair counts; else part 0 meets part 1, and what has an equal label is connected already.
    """
    wanted = dealt.withColumnsRenamed({"doc_id": "wanted_id", "mark": "wanted_mark"})
    texts = _marked(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("mark") == F.col("wanted_mark")))
    texts = texts.select("class", "cluster", "text", "i", "j", "part", "label", "all")
    texts = texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "part", "class")
    schema = "a long, b long"
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, key = WordHashes(), None
        held: list[tuple] = []
        sets: list[np.ndarray] = []

        def found() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids, part, label, every = zip(*held)
            within = (True, True) if every[0] else (False, False)
            start = np.arange(len(ids)) if every[0] else np.unique(np.array(label), return_inverse=True)[1]
            return [(ids[x], ids[y]) for x, y in link(sets, np.array(part), within, percent, start)]

        for batch in batches:
            out = []
            for c, cluster, text, i, j, part, label, every in zip(*(batch[x].to_pylist() for x in ("class", "cluster", "text", "i", "j", "part", "label", "all"))):
                if (cluster, i, j) != key:
                    out += found()
                    key, held, sets = (cluster, i, j), [], []
                if held and held[-1][:2] == (c, part):
                    continue  # a repeated row
                held.append((c, part, label, every))
                sets.append(shingles(text.lower().split(), size, hashes))
            yield to_batch(out, arrow)
        yield to_batch(found(), arrow)

    return texts.mapInArrow(run, schema)


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text and its ``mark``, which tells apart different texts under one id."""
    return bare(docs).withColumn("mark", F.xxhash64("text"))


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles of every row, ``least`` (the least id of its component) and ``label``, the component's own number.

    Rows without shingles have no label.
    """
    rows = stash(sketches(docs, size), "dedup-sketches")
    made = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark")).alias("x"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    # numbers in random order, each its own: xxhash64 permutes 64-bit numbers
    classes = stash(made.select("digest", "x.doc_id", "x.mark", "n_shingles", "registers", F.xxhash64(F.monotonically_increasing_id()).alias("class")), "dedup-classes")
    clustered = stash(clusters(classes), "dedup-clusters")
    joined = _joined(links(docs, classes, clustered, size, percent)).join(classes.select(F.col("class").alias("node"), "doc_id"), "node")
    least = joined.groupBy("label").agg(F.min("doc_id").alias("least"))
    of_class = joined.select("node", "label").join(least, "label").select(F.col("node").alias("class"), "label", "least")
    known = classes.select("class", "digest", F.col("doc_id").alias("own")).join(of_class, "class", "left").select("digest", F.coalesce("label", "class").alias("label"), F.when(F.col("label").isNull(), F.col("own")).otherwise(F.col("least")).alias("least"))
    shown = rows.select("doc_id", "mark", "n_shingles", "digest").join(known, "digest")
    empty = F.col("n_shingles") == 0
    return shown.select("doc_id", "mark", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("least")).alias("least"), F.when(~empty, F.col("label")).alias("label"))


def components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs``, all columns as they are, of each component: that of the least id, then the least mark.

    Different texts under one id are documents of their own. Of rows without words, one of each id and text stays, so they
    differ from others only in that they have no copies under other ids. Null ids come last.
    """
    rows = _grouped(docs, size, percent)
    one = rows.groupBy("label", F.when(F.col("label").isNull(), F.struct("doc_id", "mark")).alias("own"), "doc_id", "mark").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "n")).alias("x")
    kept = stash(one.groupBy("label", "own").agg(best).select("x.doc_id", "x.mark", "x.n"), "dedup-kept")
    inner = unused(docs, "kept_id"), unused(docs, "kept_mark"), unused(docs, "kept_salt"), unused(docs, "kept_nth")
    marked = docs.withColumns({inner[0]: F.col("doc_id").cast("long"), inner[1]: F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    matches = lambda other, *more: [F.col(inner[0]).eqNullSafe(other["doc_id"]), F.col(inner[1]) == other["mark"], *more]
    alone, repeated = kept.where("n = 1"), kept.where("n > 1")
    found = marked.join(alone, matches(alone), "left_semi").select(docs.columns)
    if repeated.isEmpty():
        return found
    # rows equal in id and text: one of each salt, then one of these
    dealt = repeated.select("doc_id", "mark", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    some = marked.withColumn(inner[2], F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    some = some.join(dealt, matches(dealt, F.col(inner[2]) == dealt["salt"]), "left_semi")
    for keys in (inner[:3], inner[:2]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
        some = some.withColumn(inner[3], nth).where(F.col(inner[3]) == 1).drop(inner[3])
    return found.unionByName(some.select(docs.columns))

