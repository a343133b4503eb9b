"""Operator 2, a hidden Markov language model.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, then one end. The model is
P(text) = P(classes) * prod P(word | class): the ``OWN`` most frequent words are classes of their own, the others share
``SHARED`` classes by CRC-32, the end is class 0. Class sequences come from a hidden Markov model of ``STATES``
states, trained by Baum-Welch on the sequences of all training documents: each task runs forward-backward
over its rows and adds up expected counts, Spark sums them across partitions, until the likelihood hardly rises. Within a shared class, P(word | class) is
add-one smoothed over its training words and one unknown word. The score is the exact log10 probability by
scaled forward recursion, plus the word terms.

Word counts grow with the corpus and stay in a table. Only the words above a count that at most ``FREQUENT``
words reach are broadcast; the others of each document meet their counts in a join, so no word is dropped.
Texts of any length are one sequence, in training and in scoring.

Null text: empty, one end token. Repeated rows count and are scored as often as they occur. A null doc_id is
hashed as an empty text for the fold. Without training rows every count is 0.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statvine.llm.common import arrow_schema, bare, fold_remainder, map_rows, stash, to_batch

STATES, ROUNDS = 8, 4
#: Training ends when a round raises the log likelihood by less than this share.
GAIN = 1e-3
OWN, SHARED = 3071, 1024
CLASSES = 1 + OWN + SHARED
FREQUENT = 200_000
#: Tokens of a piece; longer texts are computed in pieces side by side, with the same result.
RUN = 4096
#: Tokens whose forward variables a task holds at once; distinct words it counts before it hands them on.
TOGETHER, COUNTED = 1_000_000, 400_000
#: The end token's key among the words; no word holds white space.
END = b"\n"


def count_words(texts: DataFrame) -> DataFrame:
    """word, n over all rows of ``texts``, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def hand_on():
            rows = list(counts.items())
            counts.clear()
            for at in range(0, len(rows), 100_000):
                yield to_batch(rows[at : at + 100_000], arrow)

        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update(text.lower().split())
                counts[END] += 1
                if len(counts) > COUNTED:
                    yield from hand_on()
        yield from hand_on()

    schema = "word binary, n long"
    arrow = arrow_schema(texts.sparkSession, schema)
    return texts.mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """What a task needs to know of words: the frequent ones, the classes and their sizes."""

    def __init__(self, counts: DataFrame, frequent: int = FREQUENT) -> None:
        step = F.floor(8 * F.log2("n")).cast("int")  # few hundred steps, whatever the counts
        steps = counts.where(F.col("word") != END).groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
        least, room = 1 << 30, frequent
        for r in steps:
            if r["words"] > room:
                break
            least, room = r["step"], room - r["words"]
        top = counts.where((F.col("word") != END) & (step >= least)).collect() if steps else []  # at most `frequent` rows
        top = sorted(((r["n"], bytes(r["word"])) for r in top), key=lambda x: (-x[0], x[1]))
        shared = {r["k"]: r for r in counts.where(F.col("word") != END).groupBy((F.crc32("word") % SHARED).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
        ends = counts.where(F.col("word") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.least = least
        self.tokens = sum(r["n"] for r in steps) + ends
        self.kinds = sum(r["words"] for r in steps) + (ends > 0)
        self.ends = ends
        size = np.zeros(SHARED)
        kinds = np.zeros(SHARED)
        for k, r in shared.items():
            size[k], kinds[k] = r["n"], r["v"]
        self.number = {w: i for i, (_, w) in enumerate(top)}
        n = np.array([c for c, _ in top], np.float64)
        self.class_of = np.empty(len(top), np.uint16)
        class_n = np.zeros(CLASSES)
        class_n[0] = ends
        for i, (c, w) in enumerate(top):
            k = zlib.crc32(w) % SHARED
            if i < OWN:
                self.class_of[i] = 1 + i
                class_n[1 + i] = c
                size[k] -= c
                kinds[k] -= 1
            else:
                self.class_of[i] = 1 + OWN + k
        class_n[1 + OWN :] = size
        self.class_share = (class_n + 1) / (class_n.sum() + CLASSES)
        self.log_count = np.log10(n + 1)
        self.log_shared = np.log10(size + kinds + 1)
        within = self.log_count - self.log_shared[np.maximum(0, self.class_of.astype(int) - 1 - OWN)]
        self.log_within = np.where(self.class_of > OWN, within, 0.0)


def encode(docs: DataFrame, words: Words) -> DataFrame:
    """A row for each document: its classes (binary, unsigned 16-bit), the sums over frequent words, the other words."""
    held = docs.sparkSession.sparkContext.broadcast(words)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, within_sum double, classes binary, rare array<struct<word:binary,n:int>>"

    def rows(batch: pa.RecordBatch):
        w = held.value
        number = w.number.get
        ends = math.log10(w.ends + 1)
        for doc_id, held_out, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "held_out", "text"))):
            own = text.lower().split()
            ids = np.array([number(x, -1) for x in own], np.int64)
            hidden = np.flatnonzero(ids < 0).tolist()
            seen = ids[ids >= 0]
            classes = np.zeros(len(own) + 1, "<u2")
            within = float(w.log_within[seen].sum())
            if len(own):
                classes[:-1] = w.class_of[ids] if len(w.class_of) else 0
            rare = Counter(own[i] for i in hidden)
            if hidden:
                k = np.array([zlib.crc32(own[i]) % SHARED for i in hidden])
                classes[hidden] = 1 + OWN + k
                within -= float(w.log_shared[k].sum())
            yield doc_id, held_out, len(own) + 1, len(seen) + (w.ends > 0), float(w.log_count[seen].sum()) + ends, within, classes.tobytes(), [{"word": x, "n": n} for x, n in rare.items()]

    return map_rows(docs, rows, schema)


class Hidden:
    """Start, transition and emission probabilities."""

    def __init__(self, share: np.ndarray, states: int = STATES, seed: int = 11) -> None:
        random = np.random.default_rng(seed)
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.95 if states > 1 else 1.0)
        emit = share * np.exp(random.normal(0, 0.5, (states, len(share))))
        self.emit = emit / emit.sum(1, keepdims=True)
        self.share = share

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """From expected counts, smoothed towards uniform moves and the classes' overall shares."""
        self.start = (start + 1) / (start + 1).sum()
        self.move = (move + 1) / (move + 1).sum(1, keepdims=True)
        self.emit = (emit + 50 * self.share) / (emit.sum(1, keepdims=True) + 50)


class Lockstep:
    """Sequences side by side, the longest first, so that those still running at any step are the first ones.

    Arrays hold a row for each state, in 32-bit numbers: forward variables are scaled to one at each token.
    """

    def __init__(self, sequences: list[np.ndarray]) -> None:
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.running = (len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0] + 1), "right")).tolist()
        self.at = np.concatenate([[0], np.cumsum(self.running)]).tolist()
        step = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.seen = np.empty(lengths.sum(), np.int64)
        self.seen[np.array(self.at)[step] + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate([sequences[i] for i in self.order])

    def forward(self, model: Hidden, prior: np.ndarray | None = None, keep: bool = False):
        """ln of each sequence's probability, its last forward variables, and if kept all of them and the scales.

        prior: of each sequence, what its first states are expected to be, else the model's start.
        """
        states = len(model.start)
        chance, move = model.emit.astype(np.float32), np.ascontiguousarray(model.move.T, np.float32)
        out, last = np.zeros(len(self.order)), np.empty((states, len(self.order)), np.float32)
        kept, scales = (np.empty((states, len(self.seen)), np.float32), np.empty(len(self.seen), np.float32)) if keep else (None, None)
        a = (np.repeat(model.start[:, None], len(self.order), 1) if prior is None else prior[:, self.order]).astype(np.float32)
        for t, n in enumerate(self.running[:-1]):
            lo = self.at[t]
            if t:
                a = move @ a[:, :n]
            a *= chance.take(self.seen[lo : lo + n], 1)
            s = a.sum(0)
            a /= s
            out[:n] += np.log(s)
            if keep:
                kept[:, lo : lo + n], scales[lo : lo + n] = a, s
            m = self.running[t + 1]
            if m < n:
                last[:, m:n] = a[:, m:]
        result, ends = np.empty(len(out)), np.empty_like(last)
        result[self.order], ends[:, self.order] = out, last
        return result, ends, kept, scales

    def expect(self, model: Hidden, pieces: Pieces):
        """Expected starts, moves, emissions, and the ln likelihood, over all sequences."""
        total, _, alpha, scales = self.forward(model, pieces.prior, keep=True)
        states, chance, move = len(model.start), model.emit.astype(np.float32), model.move.astype(np.float32)
        moves, final = np.zeros((states, states)), pieces.final[:, self.order].astype(np.float32)
        gamma = alpha  # becomes alpha * beta from the end on
        later, m = np.zeros((states, 0), np.float32), 0
        for t in range(len(self.running) - 2, -1, -1):
            lo, n = self.at[t], self.running[t]
            beta = final[:, :n].copy() if n > m else np.empty((states, n), np.float32)
            if m:
                moves += alpha[:, lo : lo + m] @ later.T
                beta[:, :m] = move @ later
            gamma[:, lo : lo + n] *= beta
            beta *= chance.take(self.seen[lo : lo + n], 1)
            beta /= scales[lo : lo + n]
            later, m = beta, n
        first = pieces.first[self.order]
        starts = gamma[:, : self.running[0]][:, first].sum(1, dtype=np.float64)
        moves += pieces.before[:, self.order][:, ~first] @ later[:, ~first].T
        emitted = np.stack([np.bincount(self.seen, gamma[k], model.emit.shape[1]) for k in range(states)])
        return starts, moves * model.move, emitted, float(total.sum())


class Pieces:
    """Sequences of which long ones are cut into pieces of ``RUN`` tokens that run side by side, without a loss.

    A piece's transfer, the forward variables at its end from each single state at its beginning, chains into the true
    forward variables at the beginning of each piece and the true backward variables at its end.
    """

    def __init__(self, sequences: list[np.ndarray], model: Hidden) -> None:
        states = len(model.start)
        cut = [[s[at : at + RUN] for at in range(0, len(s), RUN)] for s in sequences]
        self.sequences = [p for own in cut for p in own]
        self.owner = np.repeat(np.arange(len(cut)), [len(own) for own in cut])
        self.first = np.concatenate([[True], self.owner[1:] != self.owner[:-1]])
        self.prior = np.repeat(model.start[:, None], len(self.owner), 1)
        self.final = np.ones((states, len(self.owner)))
        self.before = np.zeros((states, len(self.owner)))  # forward variables at the end of the piece before
        long = np.flatnonzero(np.bincount(self.owner)[self.owner] > 1)
        if not len(long):
            return
        logs, ends, _, _ = Lockstep([self.sequences[i] for i in long for _ in range(states)]).forward(model, np.tile(np.eye(states), len(long)))
        logs, ends = logs.reshape(-1, states), ends.astype(np.float64).T.reshape(-1, states, states)
        weight = np.exp(logs - logs.max(1, keepdims=True))
        after = np.empty((states, len(long)))
        for at, i in enumerate(long.tolist()):
            if not self.first[i]:
                self.before[:, i] = after[:, at - 1]
                self.prior[:, i] = after[:, at - 1] @ model.move
            end = (self.prior[:, i] * weight[at]) @ ends[at]
            after[:, at] = end / end.sum()
        for at, i in reversed(list(enumerate(long.tolist()))):
            if not self.first[i]:
                beta = model.move @ (weight[at] * (ends[at] @ self.final[:, i]))
                self.final[:, i - 1] = beta / (after[:, at - 1] @ beta)


def _groups(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Neighbouring sequences of about TOGETHER tokens."""
    group, size = [], 0
    for i, s in enumerate(sequences):
        if group and size + len(s) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(s)
    if group:
        yield group


def chances(sequences: list[np.ndarray], model: Hidden) -> np.ndarray:
    """ln of each sequence's probability."""
    pieces = Pieces(sequences, model)
    return np.bincount(pieces.owner, Lockstep(pieces.sequences).forward(model, pieces.prior)[0], len(sequences))


def expectations(sequences: list[np.ndarray], model: Hidden):
    """Expected starts, moves, emissions, and the ln likelihood, over all sequences."""
    pieces = Pieces(sequences, model)
    return Lockstep(pieces.sequences).expect(model, pieces)


def train(encoded: DataFrame, words: Words, rounds: int = ROUNDS, states: int = STATES, gain: float = GAIN) -> tuple[Hidden, list[float]]:
    """Baum-Welch over all rows that aren't held out; the likelihood (ln) before each round's update.

    It ends when a round raises the likelihood by less than ``gain`` of it, or after ``rounds``.
    """
    model, history = Hidden(words.class_share, states), []
    schema = "k int, x double"
    arrow = arrow_schema(encoded.sparkSession, schema)
    sequences = encoded.where(~F.col("held_out")).select("classes")
    n_classes = len(words.class_share)
    cuts = np.cumsum([states, states * states, states * n_classes])
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(cuts[-1] + 1)
            for batch in batches:
                whole = [np.frombuffer(x, "<u2") for x in batch["classes"].to_pylist()]
                for group in _groups(whole):
                    start, move, emit, total = expectations([whole[i] for i in group], model)
                    sums += np.concatenate([start, move.ravel(), emit.ravel(), [total]])
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], schema=arrow)

        sums = np.zeros(cuts[-1] + 1)
        for r in sequences.mapInArrow(run, schema).groupBy("k").agg(F.sum("x").alias("x")).toArrow().to_batches():  # states x classes rows
            sums[r["k"].to_numpy()] = r["x"].to_numpy()
        start, move, emit = np.split(sums[:-1], cuts[:-1])
        history.append(float(sums[-1]))
        new = Hidden(words.class_share, states)
        new.update(start, move.reshape(states, states), emit.reshape(states, n_classes))
        model = new
        if len(history) > 1 and history[-1] - history[-2] < gain * abs(history[-2]):
            break
    return model, history


@dataclass
class Fitted:
    counts: DataFrame
    words: Words
    encoded: DataFrame
    model: Hidden
    history: list[float]


def fit(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES, frequent: int = FREQUENT) -> Fitted:
    """Learns from the training fold of ``docs``; all rows are encoded, to be scored."""
    texts = bare(docs, (fold_remainder("doc_id", 7) == 2).alias("held_out"))
    counts = stash(count_words(texts.where(~F.col("held_out")).select("text")), "lm-counts")
    words = Words(counts, frequent)
    encoded = stash(encode(texts, words).withColumn("row", F.monotonically_increasing_id()), "lm-encoded")
    return Fitted(counts, words, encoded, *train(encoded, words, rounds, states))


def score(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    return score_encoded(fit(docs, rounds, states, frequent))


def score_encoded(fitted: Fitted) -> DataFrame:
    counts, words, encoded = fitted.counts, fitted.words, fitted.encoded
    held = encoded.sparkSession.sparkContext.broadcast(fitted.model)

    def rows(batch: pa.RecordBatch):
        sequences = [np.frombuffer(x, "<u2") for x in batch["classes"].to_pylist()]
        total = np.zeros(len(sequences))
        for group in _groups(sequences):
            total[group] = chances([sequences[i] for i in group], held.value)
        return list(zip(*(batch[c].to_pylist() for c in carried), (total / math.log(10)).tolist()))

    carried = [c for c in encoded.columns if c not in ("classes", "rare")]
    schema = ", ".join(f"{c} {encoded.schema[c].dataType.simpleString()}" for c in carried)
    found = map_rows(encoded.select(*carried, "classes"), rows, f"{schema}, class_sum double")
    # of the words too rare to be broadcast, those that training saw; a word unknown to it adds log10(1)
    rare_words = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    rare = rare_words.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_sum"), F.sum("times").alias("rare_known"))
    per_token = math.log10(words.tokens + words.kinds + 1)
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    return (
        found.join(rare, "row", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base_sum") + rare_sum - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), (F.col("class_sum") + F.col("within_sum") + rare_sum).alias("score"))
    )
