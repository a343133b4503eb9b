r"""Operator 7, secret scans through a trigram inverted index.

Each rule's regex is parsed once and turned into a Boolean query over byte trigrams of lower-cased text that
every match must hold (after Cox, "Regular expression matching with a trigram index", 2012). The index is
partitioned by documents: an Arrow batch is a block, and its postings list, for each trigram that any query
names, the rows of the block that hold it. Postings are intersected and united as the query says, and the
candidates left are verified by running the regex. Rules without mandatory trigrams scan every text.

Null or empty text: no secrets. Texts are scanned whole. Repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statvine.llm.common import bare, map_rows

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as P

#: A set of exact strings larger than this, or of longer strings, is turned into trigrams.
MOST_STRINGS, LONGEST = 64, 12


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes
    accept: Callable[[re.Match], bool] = lambda m: True


#: The base rules, in the order of their kinds, then those that the method adds: public token formats.
BASE = (
    Rule("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    Rule("access", rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    Rule("hex", rb"[0-9a-f]{32,}"),  # the runs ``[0-9a-f]+`` of 32 and more: both take whole runs
)
ADDED = (
    Rule("private_key", rb"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("github", rb"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("stripe", rb"[sr]k_live_[A-Za-z0-9]{16,250}"),
    Rule("google", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_login", rb"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%-]{1,80}:[A-Za-z0-9._%!$&*+=-]{6,80}@"),
)

# A query is True (no demand), ("tri", trigram), ("and", queries) or ("or", queries).


def _both(*queries):
    rest = [q for q in queries if q is not True]
    return True if not rest else rest[0] if len(rest) == 1 else ("and", tuple(dict.fromkeys(rest)))


def _either(queries):
    queries = tuple(dict.fromkeys(queries))
    return True if True in queries or not queries else queries[0] if len(queries) == 1 else ("or", queries)


def _demand(strings):
    """The query of a text that holds one of the strings."""
    return _either(_both(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) for s in strings)


def _parse(nodes):
    """(exact strings or None, query): what each match of the sequence is, or must hold."""
    strings, query = [b""], True

    def close():
        nonlocal strings, query
        query, strings = _both(query, _demand(strings)), [b""]

    whole = True
    for op, value in nodes:
        own, needs = _node(op, value)
        query = _both(query, needs)
        if own is None:
            close()
            whole = False
            continue
        joined = [a + b for a, b in product(strings, own)]
        if len(joined) > MOST_STRINGS or max(map(len, joined)) > LONGEST:
            close()
            whole, joined = False, own
        strings = joined
    return (strings, query) if whole else (None, _both(query, _demand(strings)))


def _node(op, value):
    if op is C.LITERAL:
        return [bytes([value]).lower()], True
    if op is C.IN:
        found: set[bytes] = set()
        for kind, x in value:
            if kind is C.LITERAL:
                found.add(bytes([x]).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                found |= {bytes([b]).lower() for b in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (sorted(found), True) if len(found) <= 8 else (None, True)
    if op is C.BRANCH:
        parts = [_parse(x) for x in value[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return [x for s, _ in parts for x in s], _either(q for _, q in parts)
        return None, _either(_both(q, _demand(s)) if s is not None else q for s, q in parts)
    if op is C.SUBPATTERN:
        return _parse(value[3])
    if op is C.ATOMIC_GROUP:
        return _parse(value)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, getattr(C, "POSSESSIVE_REPEAT", None)):
        least, most, inner = value
        strings, query = _parse(inner)
        if least == 0:
            if most == 1 and strings is not None:
                return [b"", *strings], True
            return None, True
        if least == most == 1:
            return strings, query
        return None, _both(query, _demand(strings)) if strings is not None else query
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return [b""], True
    return None, True


def trigram_query(pattern: bytes):
    """The Boolean query that every lower-cased text with a match satisfies; True if nothing is mandatory."""
    strings, query = _parse(P.parse(pattern))
    return query if strings is None else _both(query, _demand(strings))


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


def _code(trigram: bytes) -> int:
    return trigram[0] << 16 | trigram[1] << 8 | trigram[2]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Index:
    """The postings of one block, of the trigrams asked for."""

    def __init__(self, wanted: list[bytes]) -> None:
        self.slot = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(wanted, 1):
            self.slot[_code(t)] = k
        self.number = {t: k for k, t in enumerate(wanted, 1)}

    def build(self, block: np.ndarray, starts: np.ndarray) -> None:
        """starts: where each row begins in the block, and the block's length."""
        self.rows = np.arange(len(starts) - 1)
        keys = []
        for at in range(0, max(0, len(block) - 2), 1 << 20):  # bounds memory
            low = _LOWER[block[at : at + (1 << 20) + 2]].astype(np.uint32)
            found = self.slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            here = np.flatnonzero(found)
            row = np.searchsorted(starts, here + at, "right") - 1
            inside = here + at + 3 <= starts[row + 1]
            keys.append(np.unique(found[here[inside]].astype(np.int64) * len(starts) + row[inside]))
        pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.owner, self.row = pairs // len(starts), pairs % len(starts)

    def postings(self, trigram: bytes) -> np.ndarray:
        k = self.number[trigram]
        return self.row[slice(*np.searchsorted(self.owner, [k, k + 1]))]

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return self.rows
        if query[0] == "tri":
            return self.postings(query[1])
        if query[0] == "or":
            return np.unique(np.concatenate([self.candidates(q) for q in query[1]]))
        parts = sorted((self.candidates(q) for q in query[1]), key=len)
        found = parts[0]
        for part in parts[1:]:
            if not len(found):
                break
            found = np.intersect1d(found, part, assume_unique=True)
        return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """doc_id and ``found``: the spans of each text by start, then kind as the rules are listed, as code points."""
    compiled = [(r.kind, re.compile(r.pattern), r.accept, trigram_query(r.pattern)) for r in rules]
    wanted = sorted(set().union(*(trigrams(q) for *_, q in compiled)))
    made: list[Index] = []

    def rows(batch: pa.RecordBatch):
        if not made:
            made.append(Index(wanted))
        index, texts = made[0], batch["text"].to_pylist()
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        index.build(np.frombuffer(b"".join(texts), np.uint8), starts)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (_, regex, accept, query) in enumerate(compiled):
            for row in index.candidates(query).tolist():
                spans[row].extend((m.start(), k, m.end()) for m in regex.finditer(texts[row]) if accept(m))
        for doc_id, data, own in zip(batch["doc_id"].to_pylist(), texts, spans):
            yield doc_id, _in_code_points(data, sorted(own), compiled)

    return map_rows(bare(docs), rows, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def _in_code_points(data: bytes, own: list[tuple[int, int, int]], compiled) -> list[dict]:
    if not own:
        return []
    ascii_only, out = data.isascii(), []
    before = at = 0
    for start, k, end in own:
        if ascii_only:
            a, b = start, end
        else:
            before, at = before + len(data[at:start].decode()), start
            a, b = before, before + len(data[start:end].decode())
        out.append({"kind": compiled[k][0], "start": a, "end": b})
    return out


def digests(found: DataFrame, base: tuple[str, ...] = tuple(r.kind for r in BASE)) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as one string."""

    def rows(batch: pa.RecordBatch):
        for doc_id, own in zip(batch["doc_id"].to_pylist(), batch["found"].to_pylist()):
            written = [(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in own]
            joined = ",".join(w for k, w in written if k in base)
            yield (doc_id, *(sum(k == b for k, _ in written) for b in base), hashlib.sha256(joined.encode()).hexdigest(), ",".join(w for _, w in written))

    counts = ", ".join(f"n_{b} long" for b in base)
    return map_rows(found.select("doc_id", "found"), rows, f"doc_id long, {counts}, base_sha256 string, spans string")
