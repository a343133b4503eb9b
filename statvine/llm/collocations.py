r"""Operator 12, collocations by vertically partitioned suffix subtrees.

A-Z is lower-cased; texts are cut at ``[.,;:!?\x0A-\x0D]`` into pieces and these into words ``[^\x20\x09]+``. Every word
begins a suffix, truncated to ``DEPTH`` words and to its piece. As in ERA (Mansour et al., 2011), suffixes are dealt by a prefix, and prefixes
are grouped so that a group's suffixes fit a budget:

1. one scan counts words, and the prefixes of two and three words that make up a ``SHARES``-th of some batch of texts at least. A prefix
   that a group can't hold is among them, as it is that frequent in some batch;
2. prefixes above half the budget are extended by a word, up to whole suffixes; the other frequent ones are dealt to groups, the largest first to
   the emptiest, and all rare ones by hash. The driver holds at most ``SHARES`` prefixes a length;
3. a second scan adds up equal suffixes of a batch and sends each group its own as one row: words, numbers of words, counts;
4. a task builds a group's subtrees level by level: suffixes are sorted by their first words, a node's count is the total of its
   leaves, and nodes below ``LEAST`` are not grown further. What stands above an extended prefix is counted in parts, and added up;
5. candidates meet the counts of their parts in joins, cuts are scored on decimals, and a longer candidate's count reaches the
   phrases in it by a maximum.

Every language is on its own; a null one is ``und``. Null and empty texts hold no words; an empty table gives no rows. Repeated rows count
as often as they are there. Ids and other columns are not read. A piece may be as long as its text; texts are cut into
chunks of about ``CHUNK`` bytes, between pieces, so that a task's memory depends on the longest piece alone.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statvine.llm.common import arrow_schema, stash, to_batch

DEPTH, LEAST, TOP, OVER = 4, 30, 2000, 80
CHUNK, BUDGET, SHARES, SALTS = 8 << 20, 2_000_000, 1 << 15, 16
#: Of each byte: 0 in a word, 1 blank, 2 the end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ENDS = b".,;:!?\n\x0b\x0c\r"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """lang and texts of a batch, joined by ends of pieces, about ``CHUNK`` bytes at once."""
    by_lang: dict[str, list[bytes]] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
        by_lang.setdefault(lang, []).append(text)
    for lang, texts in by_lang.items():
        held, size = [], 0
        for text in texts:
            begin = 0
            while len(text) - begin > CHUNK:
                cut = max(text.rfind(e, begin, begin + CHUNK) for e in (ENDS[i : i + 1] for i in range(len(ENDS))))
                if cut < 0:
                    cut = min((x for x in (text.find(ENDS[i : i + 1], begin + CHUNK) for i in range(len(ENDS))) if x >= 0), default=len(text) - 1)
                yield lang, text[begin : cut + 1]
                begin = cut + 1
            held.append(text[begin:])
            size += len(held[-1]) + 1
            if size >= CHUNK:
                yield lang, b"\n".join(held)
                held, size = [], 0
        if held:
            yield lang, b"\n".join(held)


def suffixes(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a text and, for each word's place, the numbers (from 1) of the words of its suffix; 0 is none."""
    data = np.frombuffer(text.translate(LOWER), np.uint8)
    kind = KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return [], np.zeros((0, DEPTH), np.int64)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    letters = data[inside]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
    number = words.indices.to_numpy().astype(np.int64) + 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    found = np.zeros((len(starts), DEPTH), np.int64)
    for d in range(DEPTH):
        found[: len(starts) - d, d] = np.where(piece[d:] == piece[: len(starts) - d], number[d:], 0)
    return words.dictionary.to_pylist(), found


def distinct(rows: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, sorted, and their counts."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    key, base = rows[:, 0], int(rows.max()) + 1
    for d in range(1, rows.shape[1]):
        if int(key.max()) > np.iinfo(np.int64).max // base - 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + rows[:, d]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=key[order[0]] - 1))
    return rows[order[first]], np.add.reduceat(np.ones(len(rows), np.int64) if counts is None else counts[order], first)


def _map(df: DataFrame, rows, schema: str) -> DataFrame:
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in _chunks(batch):
                yield to_batch(list(rows(lang, text)), arrow)

    return df.mapInArrow(run, schema)


def frequent(texts: DataFrame) -> DataFrame:
    """lang, phrase, size, n: all words with their counts, and prefixes of two and three words as counted in the chunks where they make up a
    ``SHARES``-th of the suffixes at least."""

    def rows(lang: str, text: bytes) -> Iterator[tuple]:
        words, found = suffixes(text)
        least = max(1, len(found) // SHARES)
        held = np.bincount(found[:, 0], minlength=len(words) + 1)
        yield from ((lang, w, 1, n) for w, n in zip(words, held[1:].tolist()))
        often = held > least
        for size in (2, 3):
            found = found[often[found[:, 0]] & (found[:, size - 1] > 0)]
            nodes, counts = distinct(found[:, :size])
            for node, n in zip(nodes[counts > least].tolist(), counts[counts > least].tolist()):
                yield lang, b" ".join(words[i - 1] for i in node), size, n

    return _map(texts, rows, "lang string, phrase binary, size int, n long").groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Plan:
    """Prefixes that are extended, those dealt by name with their group, and the number of groups."""

    extended: dict[str, list[set[tuple[bytes, ...]]]]
    named: dict[str, list[dict[tuple[bytes, ...], int]]]
    groups: int


def plan(counts: DataFrame, partitions: int, budget: int = BUDGET) -> Plan:
    """counts: of ``frequent``. At most ``SHARES`` prefixes of each length come to the driver."""
    total = counts.where("size = 1").agg(F.sum("n").alias("n")).first()["n"] or 0
    groups = min(SHARES // 2, max(partitions, -(-total // budget)))
    most = max(1, total // groups)
    # a prefix over `most` is counted in full but for a SHARES-th of the suffixes, which is half of `most` at most
    rows = counts.where(F.col("n") > max(0, total // SHARES)).collect()
    extended, named, dealt = {}, {}, []
    for r in rows:
        prefix = tuple(bytes(r["phrase"]).split(b" "))
        if r["n"] > most // 2 and r["n"] > 1:
            extended.setdefault(r["lang"], [set() for _ in range(DEPTH)])[r["size"]].add(prefix)
        else:
            dealt.append((r["n"], r["lang"], prefix))
    heap = [(0, g) for g in range(groups)]
    for n, lang, prefix in sorted(dealt, key=lambda x: (-x[0], x[1], x[2])):
        held = extended.get(lang)
        if all(held and prefix[:k] in held[k] for k in range(1, len(prefix))):  # else a shorter prefix takes its suffixes along
            load, g = heapq.heappop(heap)
            named.setdefault(lang, [{} for _ in range(DEPTH)])[len(prefix)][prefix] = g
            heapq.heappush(heap, (load + n, g))
    return Plan(extended, named, groups)


def _keys(prefixes, number: dict[bytes, int]) -> list[tuple[int, ...]]:
    return [p for p in (tuple(number.get(w, 0) for w in prefix) for prefix in prefixes) if all(p)]


def _among(rows: np.ndarray, keys: list[tuple[int, ...]]) -> np.ndarray:
    """For each row its place in ``keys``, or -1."""
    if not keys or not len(rows):
        return np.full(len(rows), -1)
    both = np.concatenate([np.array(keys, np.int64), rows])
    _, inverse = np.unique(both, axis=0, return_inverse=True) if both.shape[1] > 1 else np.unique(both[:, 0], return_inverse=True)
    inverse = inverse.ravel()
    place = np.full(inverse.max() + 1, -1)
    place[inverse[: len(keys)]] = np.arange(len(keys))
    return place[inverse[len(keys) :]]


def _dealt(rows: np.ndarray, words: list[bytes], lang: str, how: Plan) -> np.ndarray:
    """The group of each suffix: of its shortest prefix that isn't extended."""
    number = {w: i for i, w in enumerate(words, 1)}
    mark = np.array([0] + [zlib.crc32(w) for w in words], np.uint64)
    seed = np.uint64(zlib.crc32(lang.encode()))
    group, hashed = np.full(len(rows), -1), np.full(len(rows), seed, np.uint64)
    open_ = np.arange(len(rows))
    for size in range(1, DEPTH + 1):
        hashed[open_] = (hashed[open_] * np.uint64(0x9E3779B97F4A7C15) + mark[rows[open_, size - 1]] + np.uint64(size)) ^ (hashed[open_] >> np.uint64(29))
        going = np.zeros(len(open_), bool)
        chosen = ((hashed[open_] ^ (hashed[open_] >> np.uint64(32))) % np.uint64(how.groups)).astype(np.int64)
        if size < DEPTH:
            names = how.named.get(lang, [{}] * DEPTH)[size]
            known = {k: g for p, g in names.items() for k in _keys([p], number)}
            at = _among(rows[open_, :size], list(known))
            chosen = np.where(at >= 0, np.array(list(known.values()) or [0])[at], chosen)
            going = (_among(rows[open_, :size], _keys(how.extended.get(lang, [set()] * DEPTH)[size], number)) >= 0) & (rows[open_, size] > 0)
        group[open_[~going]] = chosen[~going]
        open_ = open_[going]
    return group


def partitioned(texts: DataFrame, how: Plan) -> DataFrame:
    """group, lang, words (with blanks between), ids and counts of the distinct suffixes of a chunk that belong to the group."""

    def rows(lang: str, text: bytes) -> Iterator[tuple]:
        words, found = suffixes(text)
        nodes, counts = distinct(found[found[:, 1] > 0])  # single words are counted
        group = _dealt(nodes, words, lang, how)
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
            own, ids = np.unique(nodes[part], return_inverse=True)
            ids = ids.reshape(-1, DEPTH) + (0 if own[0] == 0 else 1)
            ids = ids.astype("<u2" if len(own) < 65_000 else "<u4")
            yield int(group[part[0]]), lang, b" ".join(words[i - 1] for i in own if i), ids.T.tobytes(), counts[part].astype("<u4").tobytes()

    return _map(texts, rows, "group int, lang string, words binary, ids binary, counts binary")


def _subtrees(parts: list[tuple[bytes, bytes, bytes]], extended: list[set], least: int) -> Iterator[tuple[bytes, int, int]]:
    """phrase, size and count of the nodes of two words and more; those above an extended prefix whatever their count."""
    number: dict[bytes, int] = {}
    rows, counts = [], []
    for words, ids, n in parts:
        local = np.array([0] + [number.setdefault(w, len(number) + 1) for w in words.split(b" ")], np.int64)
        counts.append(np.frombuffer(n, "<u4").astype(np.int64))
        rows.append(local[np.frombuffer(ids, "<u2" if len(ids) == 2 * DEPTH * len(counts[-1]) else "<u4").reshape(DEPTH, -1).T])
    names = [b"", *number]
    at, n = np.concatenate(rows), np.concatenate(counts)
    node, base = at[:, 0], len(names)
    once = np.bincount(node, weights=n, minlength=base)[node]  # whole numbers below 2**53
    grow = (once >= least) | (_among(at[:, :1], _keys(extended[1], number)) >= 0)
    for size in range(2, DEPTH + 1):
        grow &= at[:, size - 1] > 0
        at, n, node = at[grow], n[grow], node[grow]
        if not len(at):
            return
        _, first, node = np.unique(node * base + at[:, size - 1], return_index=True, return_inverse=True)
        held = np.zeros(len(first), np.int64)
        np.add.at(held, node, n)
        inner = _among(at[first][:, :size], _keys(extended[size], number)) >= 0 if size < DEPTH else np.zeros(len(first), bool)
        told = inner | (held >= least)
        for words, count in zip(at[first[told], :size].tolist(), held[told].tolist()):
            yield b" ".join(names[i] for i in words), size, count
        grow = told[node]


def counted(groups: DataFrame, how: Plan, least: int = LEAST) -> DataFrame:
    """lang, phrase, size, f of all phrases of two words and more with f >= ``least``."""
    schema = "lang string, phrase binary, size int, n long"
    arrow = arrow_schema(groups.sparkSession, schema)

    def build(t: pa.Table) -> pa.Table:
        langs: dict[str, list] = {}
        for r in t.to_pylist():
            langs.setdefault(r["lang"], []).append((r["words"], r["ids"], r["counts"]))
        found = [(lang, *x) for lang, parts in langs.items() for x in _subtrees(parts, how.extended.get(lang, [set()] * DEPTH), least)]
        return pa.Table.from_batches([to_batch(found, arrow)])

    nodes = groups.groupBy("group").applyInArrow(build, schema)
    return nodes.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).where(F.col("f") >= least)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases."""
    spark = docs.sparkSession
    texts = _texts(docs)
    prefixes = stash(frequent(texts), "collocations-frequent")
    how = plan(prefixes, int(spark.conf.get("spark.sql.shuffle.partitions")), budget)
    phrases = counted(partitioned(texts, how), how, least)
    words = prefixes.where(F.col("size") == 1)
    known = stash(phrases.unionByName(words.where(F.col("n") >= least).select("lang", "phrase", "size", F.col("n").alias("f"))).withColumn("phrase", F.col("phrase").cast("string")), "collocations-counts")
    n = words.groupBy("lang").agg(F.sum("n").alias("n"))

    parts = F.split("phrase", " ")
    between = lambda i, j: F.array_join(F.slice("w", i, j), " ")
    candidates = known.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", parts.alias("w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", between(F.lit(1), F.col("k")).alias("first"), between(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    counts = lambda part, name: known.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(counts("first", "l"), ["lang", "first"]).join(counts("rest", "r"), ["lang", "rest"])
    score = F.expr(f"(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    # what stands in a longer candidate, and that one's count
    spans = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("size") - 1)), lambda j: F.struct((i + j <= F.col("size") + 1).alias("fits"), between(i, j).alias("phrase"))))), lambda x: x["fits"])
    inner = candidates.where("size > 2").select("lang", F.explode(spans).alias("x"), "a").groupBy("lang", "x.phrase").agg(F.max("a").alias("longer"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.*")
    free = scored.join(inner, ["lang", "phrase"], "left").where("longer is null or cast(100 as decimal(20,0)) * longer < cast(80 as decimal(20,0)) * a")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = free.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("nth", nth("lang", "salt")).where(F.col("nth") <= top)
    best_of = some.withColumn("nth", nth("lang")).where(F.col("nth") <= top)  # over SALTS * top rows a language
    return best_of.join(n, "lang").select("lang", F.col("nth").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
