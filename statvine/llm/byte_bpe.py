"""Operator 4, byte-level BPE through a sentencepiece model written straight from a rank file.

Each byte stands for one printable character, so every entry of the vocabulary is a piece; its score is its
negative rank, hence the best-scoring merge is the lowest-ranked one and, among equals, the leftmost: the
order of byte-pair merging. The normaliser is the identity. Pre-tokens are encoded apart from each other;
decoding looks ids up and undoes the byte mapping.

Null text: empty, no tokens. Texts are never cut. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statvine.llm.common import bare, map_rows

#: Pre-tokens that a task remembers; beyond that it starts afresh.
CACHE = 200_000


def byte_letters() -> str:
    """256 characters, one a byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def write_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: ids are ranks, one unknown piece follows the last rank."""
    letters = byte_letters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _field(3, kind))
    pieces = [piece("".join(letters[b] for b in token), -rank, 1) for rank, token in enumerate(by_rank)]
    pieces.append(piece("<unk>", 0.0, 2))
    minus_one = (1 << 64) - 1
    trainer = _field(3, 2) + _field(40, len(by_rank)) + _field(41, minus_one) + _field(42, minus_one) + _field(43, minus_one)
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encodes and decodes in one task; made there, from the model's bytes."""

    def __init__(self, model: bytes, pattern: str) -> None:
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        letters = byte_letters()
        self.to_letters = dict(enumerate(letters))
        to_byte = {ord(c): b for b, c in enumerate(letters)}
        n = self.processor.get_piece_size() - 1
        self.bytes_of = [self.processor.id_to_piece(i).translate(to_byte).encode("latin-1") for i in range(n)]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out = []
        for text in texts:
            tokens = self.split(text)
            known = self.known
            new = list({t for t in tokens if t not in known})
            if new:
                if len(known) + len(new) > CACHE:
                    self.known = known = {}
                    new = list(set(tokens))
                mapped = [t.encode().decode("latin-1").translate(self.to_letters) for t in new]
                known.update((t, np.array(ids, "<u4").tobytes()) for t, ids in zip(new, self.processor.encode(mapped, out_type=int, num_threads=1)))
            out.append(b"".join(map(known.__getitem__, tokens)))
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (binary: little-endian unsigned 32-bit)."""
    model = write_model(read_ranks(ranks_path))  # under 1 MB, as large as the vocabulary
    codecs: list[Codec] = []

    def rows(batch: pa.RecordBatch):
        if not codecs:
            codecs.append(Codec(model, pattern))
        texts = [t.decode() for t in batch["text"].to_pylist()]
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), codecs[0].encode_all(texts)):
            yield doc_id, len(ids) // 4, ids

    return map_rows(bare(docs), rows, "doc_id long, n_tokens long, ids binary")


def digests(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Decodes ``ids`` and returns digests of the ids and of the decoded bytes."""
    model = write_model(read_ranks(ranks_path))
    codecs: list[Codec] = []

    def rows(batch: pa.RecordBatch):
        if not codecs:
            codecs.append(Codec(model, pattern))
        for doc_id, n, ids in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
            decoded = codecs[0].decode(np.frombuffer(ids, "<u4").tolist())
            yield doc_id, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()

    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
