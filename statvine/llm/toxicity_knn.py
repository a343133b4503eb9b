"""Operator 8, toxicity from the nearest labelled examples.

Terms of a text are its words (ASCII lower case, punctuation apart) and their beginnings of 5 bytes. The examples are
labelled rows outside the held-out fold whose text is among the documents: at most ``EXAMPLES`` of them with at most ``MOST_BYTES`` of
text together (the documented bound; smallest hash of the id first, and a text that doesn't fit in is passed over alone). Rows of equal words and equal label count once, all others stay.
Texts become unit TF-IDF vectors over all terms of the examples: (1 + ln tf) * idf * relevance, where relevance is
``LEAST_RELEVANCE`` plus the standardised difference between how many toxic examples hold a term and how many
would by chance. Every term keeps a weight; none is dropped, however rare or unrelated.

Cosine search is exact: an inverted index over the examples is cut into blocks of ``BLOCK`` neighbouring examples
with the largest weight of each term, blocks are visited by their upper bound, and the search stops when no bound
reaches the k-th best. Neighbours vote with weight 1 / (distance + 0.05); an isotonic map, fitted to the
examples' own votes without themselves, turns votes into probabilities. The three nearest are kept as evidence.

The index is bounded with the examples and is broadcast; nothing that grows with the corpus is. A score depends on the
text alone: equal texts score equally under any id, and an example's own text finds that example at distance 0.
Null or empty texts, and texts without any known term, get the share of toxic examples among those without
terms, smoothed towards the share of all. Repeated ids in ``labels``: toxic if one row says so; null ids or labels
are not used; of several texts under one id the least is the example. Without any usable label, or with labels of
one kind only, scores are the smoothed rate (0.25 without rows, as nothing speaks for toxic).
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statvine.llm.common import WHITESPACE, arrow_schema, bare, fold_remainder, map_rows, stash, to_batch

EXAMPLES, MOST_BYTES = 2560, 32_000_000
BEGINNINGS = (5,)
LEAST_RELEVANCE = 0.1
BLOCK, NEIGHBOURS, SHOWN = 128, 15, 3
#: Blocks that are visited before any bound is compared, if the next bound is below this share of the highest; where
#: bounds are flat, hardly a block would be left out.
BEGIN, FLAT = 4, 0.6
#: Words that a task remembers the terms of.
CACHE = 200_000
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
assert all(_PLAIN[b] == 32 for b in WHITESPACE)


def words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def terms_of(word: bytes) -> list[int]:
    """The word itself, marked by a trailing blank, and its beginnings, as 64-bit hashes."""
    return [xxhash.xxh3_64_intdigest(x) for x in (word + b" ", *(word[:n] for n in BEGINNINGS if len(word) >= n))]


def examples_of(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, toxic, text of the labelled rows to learn from."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(fold_remainder("doc_id", 5) != 0).join(bare(docs).select("doc_id"), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = bare(docs).join(F.broadcast(chosen), "doc_id")  # at most `most` rows
    signed = map_rows(joined.select("doc_id", "toxic", "text"), _digest, "doc_id long, toxic int, text binary, digest binary")
    one = signed.groupBy("doc_id").agg(F.min_by(F.struct("toxic", "text", "digest"), "text").alias("x")).select("doc_id", "x.*")
    copies = one.groupBy("toxic", "digest").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("x"))
    examples = stash(copies.select("x.doc_id", "toxic", "x.text"), "toxicity-examples")
    sizes = examples.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()  # at most `most` rows
    kept, total = [], 0
    for r in sizes:
        if total + r["size"] <= most_bytes:
            kept.append(r["doc_id"])
            total += r["size"]
    return examples if len(kept) == len(sizes) else examples.where(F.col("doc_id").isin(kept))


def _digest(batch: pa.RecordBatch):
    """The digest of the words: copies of one label count once."""
    for doc_id, toxic, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "toxic", "text"))):
        yield doc_id, toxic, text, hashlib.blake2b(b" ".join(words(text)), digest_size=16).digest()


def weigh_terms(examples: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all terms of the examples, ascending, and what a single occurrence weighs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for toxic, text in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist()):
                own: set[int] = set()
                for w in set(words(text)):
                    own.update(terms_of(w))
                found[bool(toxic)].update(own)
        for kind in (0, 1):
            term, n = np.array(list(found[kind]), np.uint64).view(np.int64), np.array(list(found[kind].values()), np.int64)
            for at in range(0, len(term), 200_000):
                part = n[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(term[at : at + 200_000]), pa.array(part * kind), pa.array(part)], schema=arrow)

    schema = "term long, toxic long, n long"
    arrow = arrow_schema(examples.sparkSession, schema)
    total = examples.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    n, share = total["n"], total["t"] / max(1, total["n"])
    counts = examples.mapInArrow(count, schema).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).toArrow()  # the terms of the examples
    term = counts["term"].to_numpy().view(np.uint64)
    toxic, held = counts["toxic"].to_numpy().astype(float), counts["n"].to_numpy().astype(float)
    by_chance = share * (1 - share) * held * (1 - held / max(1, n))
    relevance = LEAST_RELEVANCE + np.abs(toxic - held * share) / np.sqrt(by_chance + 0.5)
    order = np.argsort(term)
    return term[order], ((np.log((1 + n) / (1 + held)) + 1) * relevance)[order]


class Vectors:
    """Texts to unit TF-IDF vectors over the known terms."""

    def __init__(self, term: np.ndarray, weight: np.ndarray) -> None:
        self.term, self.weight = term, weight
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _learn(self, new: list[bytes]) -> None:
        made = [terms_of(w) for w in new]
        wanted = np.array([t for own in made for t in own], np.uint64)
        at = np.searchsorted(self.term, wanted)
        at[at == len(self.term)] = 0
        found = np.where(self.term[at] == wanted, at, -1).tolist() if len(self.term) else [-1] * len(wanted)
        begin = 0
        for w, own in zip(new, made):
            self.known[w] = tuple(i for i in found[begin : begin + len(own)] if i >= 0)
            begin += len(own)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        times = Counter(words(text))
        known = self.known
        new = [w for w in times if w not in known]
        if new:
            if len(known) + len(new) > CACHE:
                known.clear()
                new = list(times)
            self._learn(new)
        own = [known[w] for w in times]
        ids = np.fromiter(chain.from_iterable(own), np.int64)
        if not len(ids):
            return ids, np.zeros(0)
        tf = np.repeat(np.fromiter(times.values(), np.int64, len(times)), np.fromiter(map(len, own), np.int64, len(own)))
        ids, at = np.unique(ids, return_inverse=True)
        weight = (1 + np.log(np.bincount(at, tf))) * self.weight[ids]
        return ids, weight / np.sqrt((weight * weight).sum())


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    found = np.repeat(start - np.cumsum(length) + length, length)
    found += np.arange(len(found))
    return found


@dataclass
class BlockMax:
    """Postings by term, then example, over examples sorted so that like ones are neighbours."""

    first: np.ndarray  # by term, into entries; an entry is a term in a block
    block: np.ndarray  # by entry
    top: np.ndarray  # by entry: the largest weight
    start: np.ndarray  # by entry, into postings
    example: np.ndarray
    weight: np.ndarray
    n: int

    @classmethod
    def build(cls, lengths: np.ndarray, term: np.ndarray, weight: np.ndarray, n_terms: int) -> BlockMax:
        """lengths: the number of terms of each example; term, weight: theirs, side by side."""
        number = np.uint16 if len(lengths) <= 2**16 else np.uint32
        owner = np.repeat(np.arange(len(lengths), dtype=number), lengths)
        order = np.argsort(term, kind="stable")
        term, owner, weight = term[order], owner[order], weight[order].astype(np.float32)
        block = owner // number(BLOCK)
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        start = np.flatnonzero(new)
        top = np.maximum.reduceat(weight, start) if len(start) else weight
        first = np.searchsorted(term[start], np.arange(n_terms + 1)).astype(np.int32)
        return cls(first, block[start], top, np.append(start, len(term)).astype(np.int64), owner, weight, len(lengths))

    def search(self, ids: np.ndarray, weight: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest positive cosine, and the cosines; ties: the smaller number first. but: is left out."""
        begin, end = self.first[ids], self.first[ids + 1]
        entry = _ranges(begin, end - begin)
        block, of_entry = self.block[entry], np.repeat(weight, end - begin)
        bounds = np.bincount(block, of_entry * self.top[entry], self.n // BLOCK + 1)
        visit = np.argsort(-bounds, kind="stable")
        visit = visit[bounds[visit] > 0]

        def visited(blocks: np.ndarray) -> np.ndarray:
            chosen = np.zeros(len(bounds), bool)
            chosen[blocks] = True
            own = np.flatnonzero(chosen[block])
            return self._add_up(self.start[entry[own]], self.start[entry[own] + 1], of_entry[own])

        left, score = visit, None
        if len(visit) > BEGIN and bounds[visit[BEGIN]] < FLAT * bounds[visit[0]]:
            score = visited(visit[:BEGIN])
            best = self._best(score, k, but)
            left = visit[BEGIN:]
            if len(best) == k:
                left = left[bounds[left] >= score[best[-1]] - 1e-9]
        if len(left):
            # where most blocks are left, whole lists are cheaper than their parts
            score = self._add_up(self.start[begin], self.start[end], weight) if score is None or 2 * len(left) > len(visit) else score + visited(left)
            best = self._best(score, k, but)
        return best, score[best]

    def _add_up(self, begin: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The scores of all examples from the postings of these ranges."""
        posting = _ranges(begin, end - begin)
        found = self.weight.take(posting, mode="clip").astype(np.float64)
        found *= np.repeat(weight, end - begin)
        return np.bincount(self.example.take(posting, mode="clip"), found, self.n)

    def _best(self, score: np.ndarray, k: int, but: int) -> np.ndarray:
        shown = np.round(score, 9)
        if but >= 0:
            shown[but] = 0
        high = np.flatnonzero(shown >= np.partition(shown, -k)[-k]) if k < self.n else np.arange(self.n)
        high = high[shown[high] > 0]
        return high[np.lexsort((high, -shown[high]))][:k]


@dataclass
class Model:
    term: np.ndarray
    weight: np.ndarray
    index: BlockMax
    doc_id: np.ndarray
    toxic: np.ndarray
    empty_rate: float
    steps: tuple[np.ndarray, np.ndarray]  # votes and calibrated probabilities, both ascending

    def vectors(self) -> Vectors:
        return Vectors(self.term, self.weight)

    def vote(self, vectors: Vectors, text: bytes, but: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """The share of toxic votes (-1: no neighbours), the neighbours and their cosines. but: an example that has no vote."""
        ids, weight = vectors(text)
        who, how = self.index.search(ids, weight, NEIGHBOURS, but) if len(ids) else (np.zeros(0, np.int64), np.zeros(0))
        if not len(who):
            return -1.0, who, how
        votes = 1 / (np.maximum(0, 1 - how) + 0.05)
        return float((votes * self.toxic[who]).sum() / votes.sum()), who, how

    def score(self, vote: float) -> float:
        return self.empty_rate if vote < 0 else float(np.interp(vote, *self.steps))


def _isotonic(values: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; one added row of each kind at the ends keeps 0 and 1 out of reach."""
    pools: list[list] = []
    for v, h, n in zip(values.tolist(), hits.tolist(), rows.tolist()):
        pools.append([[v], h, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            v_, h_, n_ = pools.pop()
            pools[-1] = [pools[-1][0] + v_, pools[-1][1] + h_, pools[-1][2] + n_]
    x = [v for pool in pools for v in pool[0]]
    y = [(pool[1] + 0.5) / (pool[2] + 1) for pool in pools for _ in pool[0]]
    return np.array(x), np.maximum.accumulate(np.array(y))


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model:
    examples = examples_of(docs, labels, most)
    spark = examples.sparkSession
    term, weight = weigh_terms(examples)
    terms = spark.sparkContext.broadcast((term, weight))
    made: list[Vectors] = []

    def vectorise(batch: pa.RecordBatch):
        if not made:
            made.append(Vectors(*terms.value))
        for doc_id, toxic, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "toxic", "text"))):
            ids, own = made[0](text)
            main = int(ids[np.argmax(own)]) if len(ids) else -1
            yield doc_id, toxic, main, ids.astype(np.uint32).tobytes(), own.astype(np.float32).tobytes()

    # at most `most` rows, like ones side by side
    rows = map_rows(examples, vectorise, "doc_id long, toxic int, main int, ids binary, weight binary").orderBy("main", F.octet_length("ids"), "doc_id").toArrow()
    terms.destroy()
    joined = lambda c, t: np.frombuffer(b"".join(rows[c].to_pylist()), t)
    doc_id, toxic = rows["doc_id"].to_numpy(), rows["toxic"].to_numpy().astype(np.float64)
    lengths = np.array([len(x) // 4 for x in rows["ids"].to_pylist()], np.int64)
    rate = (toxic.sum() + 0.5) / (len(toxic) + 2)
    empty_rate = float((toxic[lengths == 0].sum() + rate) / ((lengths == 0).sum() + 1))
    index = BlockMax.build(lengths, joined("ids", np.uint32), joined("weight", np.float32), len(term))
    model = Model(term, weight, index, doc_id, toxic, empty_rate, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    if not 0 < toxic.sum() < len(toxic):
        model.steps = (np.array([0.0, 1.0]), np.array([rate, rate]))
        return model
    held = spark.sparkContext.broadcast(model)
    places = F.broadcast(spark.createDataFrame(pa.table({"doc_id": doc_id, "place": np.arange(len(doc_id))})))  # at most `most` rows

    def own_votes(batch: pa.RecordBatch):
        m = held.value
        own = m.vectors()
        for place, y, text in zip(*(batch[c].to_pylist() for c in ("place", "toxic", "text"))):
            yield round(m.vote(own, text, place)[0] * 50), y

    found = map_rows(examples.join(places, "doc_id").select("place", "toxic", "text"), own_votes, "step int, toxic int").where("step >= 0").groupBy("step").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).orderBy("step").collect()  # at most 51 rows
    if found:
        model.steps = _isotonic(np.array([r["step"] / 50 for r in found]), np.array([float(r["t"]) for r in found]), np.array([float(r["n"]) for r in found]))
    held.destroy()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and ``evidence``: the three nearest examples."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    made: list[Vectors] = []

    def rows(batch: pa.RecordBatch):
        m = held.value
        if not made:
            made.append(m.vectors())
        for doc_id, held_out, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "held_out", "text"))):
            vote, who, how = m.vote(made[0], text)
            s = m.score(vote)
            near = [{"doc_id": int(m.doc_id[w]), "cosine": round(float(h), 6), "toxic": int(m.toxic[w])} for w, h in zip(who[:SHOWN], how[:SHOWN])]
            yield doc_id, held_out, s, int(s >= 0.5), near

    schema = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"
    return map_rows(bare(docs, (fold_remainder("doc_id", 5) == 0).alias("held_out")), rows, schema)


def keep_civil(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        vectors = m.vectors()
        for batch in batches:
            good = [m.score(m.vote(vectors, (t or "").encode())[0]) < 0.5 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good, pa.bool_())).columns, schema=arrow)

    return docs.mapInArrow(run, schema)
