"""Operator 5, quality rules as a short-circuit cascade.

Every rule looks at measures of one text. On a random sample (``SAMPLE_ROWS`` rows, a bound on the
planning effort only) each rule's cost and the share it rejects are measured; the whole table then runs the
rules by rejections per second, dearest last, and a text leaves the cascade at the first rule that rejects
it. The verdict is the conjunction of all rules, so the order never changes it.

Null or empty text: no words, all counts 0, rejected by the word count. Repeated rows give repeated
results; other columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statvine.llm.common import WHITESPACE, arrow_schema, bare, map_rows

SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"
_LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")
_BYTES = np.arange(256)
_SPACE = np.isin(_BYTES, list(WHITESPACE))
_SYMBOL = np.isin(_BYTES, list(SYMBOLS))
_TAIL = (_BYTES & 0xC0) == 0x80  # of a character of several bytes
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)


class Measures:
    """Measures of one text, each computed when first asked for."""

    def __init__(self, data: bytes) -> None:
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.bincount(np.frombuffer(self.data, np.uint8), minlength=256)

    @cached_property
    def word_chars(self) -> int:
        return int(self.counts[~_SPACE & ~_TAIL].sum())

    @cached_property
    def n_symbols(self) -> int:
        return int(self.counts[_SYMBOL].sum())

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def ids(self) -> np.ndarray:
        """A number for each word, equal for equal words."""
        number: dict[bytes, int] = {}
        return np.array([number.setdefault(w, len(number)) for w in self.words], np.int64)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that the text holds twice or more."""
        ids = self.ids
        if len(ids) < 4:
            return 0
        pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
        _, inverse, times = np.unique(windows, return_inverse=True, return_counts=True)
        hit = times[inverse] > 1
        covered = np.zeros(len(ids), bool)
        for shift in range(3):
            covered[shift : shift + len(hit)] |= hit
        return int(covered.sum())

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words

    @cached_property
    def top_share(self) -> float:
        return int(np.bincount(self.ids).max()) / self.n_words if self.n_words else 0.0

    @cached_property
    def share_with_letters(self) -> float:
        letters = _LETTERS.search
        return sum(1 for w in self.words if letters(w)) / self.n_words if self.n_words else 0.0


#: name -> does it reject?
RULES: dict[str, Callable[[Measures], bool]] = {
    "too_few_words": lambda m: m.n_words < 50,
    "repeated_windows": lambda m: 100 * m.n_repeat_words > 50 * m.n_words,
    "symbols": lambda m: m.n_symbols > 0.1 * m.n_words,
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 18 * m.n_words,
    "words_without_letters": lambda m: m.share_with_letters < 0.75,
    "capitals": lambda m: m.counts[_UPPER].sum() > m.counts[_LOWER].sum(),
    "digits": lambda m: m.counts[_DIGIT].sum() > 0.25 * max(1, m.word_chars),
    "repeated_lines": lambda m: m.n_dup_lines > 0.5 * max(1, len(m.lines)),
    "one_word": lambda m: m.top_share > 0.35,
    "exclamations": lambda m: m.counts[33] > 0.3 * max(1, m.n_words),
}


def plan(docs: DataFrame, rules: dict[str, Callable[[Measures], bool]] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' names by rejections per second on a sample; ties and an empty sample: as given."""
    n = docs.count()
    if not n:
        return list(rules)
    named = list(rules.items())

    def rows(batch: pa.RecordBatch):
        spent, rejected = [0.0] * len(named), [0] * len(named)
        for data in batch["text"].to_pylist():
            for k, (_, rule) in enumerate(named):
                measures = Measures(data)  # afresh: a rule pays for what it needs
                began = time.perf_counter()
                rejected[k] += bool(rule(measures))
                spent[k] += time.perf_counter() - began
        return list(zip(range(len(named)), spent, rejected))

    sample = bare(docs).sample(fraction=min(1.0, sample_rows / n), seed=5)
    found = map_rows(sample, rows, "rule int, spent double, rejected long").groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected")).collect()
    worth = {r["rule"]: r["rejected"] / max(r["spent"], 1e-9) for r in found}
    return [named[k][0] for k in sorted(range(len(named)), key=lambda k: (-worth.get(k, 0.0), k))]


def judge(docs: DataFrame, rules: dict[str, Callable[[Measures], bool]] = RULES, sample_rows: int = SAMPLE_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, the measures of the base rules, ``kept`` and the rule that rejected (null if none).

    Which of several rejecting rules is named depends on the measured order; ``kept`` doesn't.
    """
    order = plan(docs, rules, sample_rows)
    cascade = [(name, rules[name]) for name in order]
    extra = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"doc_id long, {extra}n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"

    def rows(batch: pa.RecordBatch):
        for values in zip(*(batch[c].to_pylist() for c in ("doc_id", *keep, "text"))):
            m = Measures(values[-1])
            by = next((name for name, rule in cascade if rule(m)), None)
            yield (*values[:-1], m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, by is None and not m.base_failed, by)

    return map_rows(bare(docs, *keep), rows, schema)


def keep_good(docs: DataFrame, rules: dict[str, Callable[[Measures], bool]] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that no rule rejects."""
    cascade = [rules[name] for name in plan(docs, rules, sample_rows)]
    schema = docs.schema
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            good = [not any(rule(m) for rule in cascade) for m in (Measures((t or "").encode()) for t in texts)]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(good, pa.bool_())).columns, schema=arrow)

    return docs.mapInArrow(run, schema)
