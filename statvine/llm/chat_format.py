r"""Operator 1, chat formatting checked by a grammar round trip.

A turn is written ``<|im_start|>ROLE\nTEXT<|im_end|>\n``. The reader is deterministic: it knows that grammar
and nothing else, and takes one backslash out of every control string that carries some
(``<\|im_end|>`` reads ``<|im_end|>``, ``<\\|im_end|>`` reads ``<\|im_end|>``). The writer first writes a
turn as it is, reads it back, and where role or text differ from the source adds a backslash to every control
string, escaped or not, and writes again, until both are identical. Since each turn reads back alone as exactly
one turn, their concatenation reads back as exactly the source.

Turns are written one row each and stay ordered segments of their conversation, so a conversation of any
length never has to fit in memory: reading it back is a stream over sorted rows. The loss mask covers the
texts of assistant turns.

Null role or text: empty. Turns are ordered by turn (null first), role, text; equal rows are equal turns and
all stay. A null conv_id is a conversation of its own. Other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statvine.llm.common import arrow_schema, map_rows, to_batch

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n"}
_ROLE_IN = {v: k for k, v in _ROLE_OUT.items()}
TRAINED = "assistant"


class BadChat(ValueError):
    """Text outside the grammar."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def _escape_role(role: str) -> str:
    return escape(re.sub(r"[\\\n]", lambda m: _ROLE_OUT[m[0]], role))


def _unescape_role(role: str) -> str:
    return re.sub(r"\\[\\n]", lambda m: _ROLE_IN[m[0]], unescape(role))


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, and the span of the written text of each turn."""
    at = 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise BadChat(f"no turn begins at {at}")
        line = rendered.find("\n", at)
        end = rendered.find(END, line + 1)
        if line < 0 or end < 0 or rendered[end + len(END) : end + len(END) + 1] != "\n":
            raise BadChat(f"the turn at {at} does not end")
        yield _unescape_role(rendered[at + len(START) : line]), unescape(rendered[line + 1 : end]), line + 1, end
        at = end + len(END) + 1


def render_turn(role: str, text: str) -> str:
    """One written turn that reads back as exactly (role, text)."""
    for r, t in ((role, text), (role, escape(text)), (_escape_role(role), text), (_escape_role(role), escape(text))):
        written = f"{START}{r}\n{t}{END}\n"
        try:
            if [x[:2] for x in parse(written)] == [(role, text)]:
                return written
        except BadChat:
            pass
    raise AssertionError("escaping is reversible")


def render(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, ``segment`` (its written form), and where its text is under the loss mask.

    ``loss_start``, ``loss_end`` are code points within the segment, null where nothing is trained on.
    """

    def rows(batch: pa.RecordBatch):
        for conv, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            segment = render_turn(role, text)
            _, _, start, end = next(parse(segment))
            trained = role == TRAINED
            yield conv, turn, role, text, segment, start if trained else None, end if trained else None

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    bare = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return map_rows(bare, rows, "conv_id long, turn long, role string, text string, segment string, loss_start int, loss_end int")


def read_back(rendered: DataFrame) -> DataFrame:
    """Parses the segments of each conversation in order and returns digests of what was read.

    Rows are dealt by conv_id and sorted within partitions; a task holds one batch and the running digests, so
    a conversation with a third of all rows is a stream, not a group in memory.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    arrow = arrow_schema(rendered.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None

        def result():
            n, turns, loss_chars, loss, chars = state
            return current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            out = []
            for conv, segment, start, end in zip(*(batch[c].to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if state is None or conv != current:
                    if state is not None:
                        out.append(result())
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(segment):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    masked = unescape(segment[start:end])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(segment)
            yield to_batch(out, arrow)
        if state is not None:
            yield to_batch([result()], arrow)

    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(run, schema)


def assemble(rendered: DataFrame) -> DataFrame:
    """conv_id and the whole written conversation, for conversations that fit in a task's memory."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "segment")))
    return rendered.groupBy("conv_id").agg(F.concat_ws("", F.transform(ordered, lambda x: x["segment"])).alias("formatted"))
