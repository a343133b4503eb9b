"""Operator 10, media columns: texts stored as grey PNG images, read back and hashed.

The payload of a row is its UTF-8 text padded with bytes 255 to a positive multiple of 576; it becomes the
8-bit samples of a grey PNG 576 samples wide. Rows are filtered (none, left or upper neighbour, whichever
leaves the smallest residue), deflated through zlib, and framed in chunks with CRC-32. Reading tests every
checksum, inflates, undoes the filters with numpy and takes a 64-bit hash of the low frequencies of a
cosine transform, kept in a binary column.

Null or empty text: one row of 576 bytes 255. A damaged file raises :class:`BadPng`. Repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statvine.llm.common import bare, map_rows

UNIT = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
SIDE, LOW = 32, 8


class BadPng(ValueError):
    """A file that breaks the format or fails a checksum."""


def pad(data: bytes) -> bytes:
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(samples: np.ndarray, level: int = 4) -> bytes:
    """A grey 8-bit PNG of a two-dimensional array of bytes."""
    height, width = samples.shape
    left = samples.copy()
    left[:, 1:] -= samples[:, :-1]
    up = samples.copy()
    up[1:] -= samples[:-1]
    kinds = np.stack([samples, left, up])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    lines = np.empty((height, width + 1), np.uint8)
    lines[:, 0] = best
    lines[:, 1:] = kinds[best, np.arange(height)]
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(lines: np.ndarray) -> np.ndarray:
    """Undoes the five row filters of 8-bit grey images."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    above = np.zeros(out.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = out[y]
        if kind == 1:
            np.cumsum(row, dtype=np.uint8, out=row)
        elif kind == 2:
            row += above
        elif kind == 3:
            a = 0
            for x, (value, b) in enumerate(zip(row.tolist(), above.tolist())):
                row[x] = a = (value + (a + b) // 2) & 255
        elif kind == 4:
            a = c = 0
            for x, (value, b) in enumerate(zip(row.tolist(), above.tolist())):
                pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                row[x] = a = (value + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
                c = b
        elif kind:
            raise BadPng(f"row filter {kind}")
        above = row
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG, every chunk's checksum tested."""
    if data[:8] != SIGNATURE:
        raise BadPng("no PNG signature")
    at, shape, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        content = data[at + 8 : at + 8 + length]
        if len(content) != length or data[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(content, zlib.crc32(kind))):
            raise BadPng(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", content)
            if rest != [8, 0, 0, 0, 0]:
                raise BadPng(f"only 8-bit grey, not interlaced: {rest}")
            shape = height, width + 1
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + length
    if shape is None or not ended:
        raise BadPng("cut off")
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise BadPng(str(e)) from e
    if len(raw) != shape[0] * shape[1]:
        raise BadPng("wrong number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(shape))


def _overlaps(n: int, parts: int) -> np.ndarray:
    """parts x n weights: the share of each of n unit cells in each of the equal parts, rows summing to 1."""
    edges = np.arange(parts + 1) * (n / parts)
    cells = np.arange(n)
    share = np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells)
    return np.maximum(share, 0) * (parts / n)


_COSINES = np.cos(np.pi / SIDE * (np.arange(SIDE) + 0.5) * np.arange(LOW)[:, None])
_WIDE: dict[int, np.ndarray] = {}


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the image, shrunk to 32 x 32, exceed their median."""
    height, width = samples.shape
    across = _WIDE.setdefault(width, _overlaps(width, SIDE).T)
    small = np.zeros((SIDE, SIDE))
    for top in range(0, height, 4096):  # bounds memory for very long texts
        block = samples[top : top + 4096] @ across
        edges = np.arange(SIDE + 1) * (height / SIDE)
        cells = np.arange(top, top + len(block))
        share = np.maximum(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0)
        small += share @ block
    low = np.round(_COSINES @ (small * (SIDE / height)) @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the PNG of each text in the binary column ``media``."""

    def rows(batch: pa.RecordBatch):
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            yield doc_id, len(text), encode_png(np.frombuffer(pad(text), np.uint8).reshape(-1, UNIT))

    return map_rows(bare(docs), rows, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads the column ``media`` back: digests of the samples and of the file, and the hash in ``low_hash``.

    Where media is null or damaged, ``error`` says how, and what can't be read is null.
    """

    def rows(batch: pa.RecordBatch):
        for doc_id, n_bytes, png in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_bytes", "media"))):
            try:
                if png is None:
                    raise BadPng("no media")
                samples = decode_png(png)
            except BadPng as e:
                yield (doc_id, n_bytes, None, None, None, *((None, None) if png is None else (len(png), hashlib.sha256(png).hexdigest())), None, str(e))
                continue
            payload = samples.tobytes()
            yield (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), cosine_hash(samples), None)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, low_hash binary, error string"
    return map_rows(media.select("doc_id", "n_bytes", "media"), rows, schema)
