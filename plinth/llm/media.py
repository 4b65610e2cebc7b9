"""Media columns: texts stored as grey PNG images, read back with every check, and hashed by their low frequencies.

``encode`` writes 8-bit grey PNG files of a fixed width through zlib; ``decode`` walks the chunks, tests each CRC and
the stream's Adler checksum, and undoes the five row filters with numpy. ``low_frequencies`` shrinks the samples to a
square, takes its discrete cosine transform and keeps the signs of the lowest frequencies against their median.

Defined results: a null text counts as empty; an empty text is one row of zeros; very long texts are one image, whole;
equal texts (repeated rows among them) give equal files; of filters that are equally good the first is taken; damaged
files raise ``ValueError``; an empty table gives an empty result; only the key and the text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from plinth.llm.common import map_texts

WIDTH = 64
SIDE, LOW = 32, 8
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 6


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def payload_of(text: str | None, width: int = WIDTH) -> tuple[bytes, int]:
    """(UTF-8 bytes padded with zeros to a positive multiple of ``width``, bytes before padding)."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % width or (0 if raw else width)), len(raw)


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG of ``payload`` in rows of ``width``; each row takes the filter with the least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    ways = np.stack([rows, rows - left, rows - above])  # none, sub, up; uint8 wraps
    best = np.abs(ways.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = best, ways[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and corner, what is nearest to left + above - corner; ties go in this order."""
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def unfilter(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the filters: kinds 0 to 2 by sums over runs of rows, images with others along their diagonals."""
    if len(unknown := kinds[kinds > 4]):
        raise ValueError(f"unknown filter {unknown[0]}")
    if (kinds > 2).any():
        return _by_diagonals(kinds, rows)
    out = np.empty_like(rows)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    above = np.zeros(rows.shape[1], np.uint8)
    for first, last in zip([0, *edges], [*edges, len(rows)], strict=True):
        part = rows[first:last]
        out[first:last] = part if kinds[first] == 0 else np.cumsum(part, axis=1, dtype=np.uint8) if kinds[first] == 1 else np.cumsum(part, axis=0, dtype=np.uint8) + above
        above = out[last - 1]
    return out


def _by_diagonals(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All filters at once: the samples of a diagonal need only those of the two before it."""
    height, width = rows.shape
    out = np.zeros((height + 1, width + 1), np.int64)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = np.choose(kinds[y], [np.zeros_like(left), left, above, (left + above) // 2, _paeth(left, above, corner)])
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decode(media: bytes) -> np.ndarray:
    """The samples (rows x width, uint8) of a grey 8-bit PNG without interlace."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("cut chunk")
        size, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + size]
        if len(data) < size or struct.unpack_from(">I", media.ljust(at + 12 + size, b"\0"), at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError(f"checksum of {kind!r} fails")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            body.append(data)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0) or not ended:
        raise ValueError("not a whole grey 8-bit image")
    width, height = head[:2]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError(f"the samples don't inflate: {e}") from e
    if lines.size != height * (width + 1):
        raise ValueError("wrong number of samples")
    lines = lines.reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


_AT = np.arange(SIDE)
#: Rows of the cosine transform for the lowest LOW frequencies of SIDE samples.
COSINES = np.cos(np.pi * (2 * _AT[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def _shrink(samples: np.ndarray, axis: int) -> np.ndarray:
    """Means over SIDE equal parts along an axis; an axis shorter than SIDE repeats its samples."""
    n = samples.shape[axis]
    if n < SIDE:
        return np.take(samples, _AT * n // SIDE, axis=axis)
    cuts = _AT * n // SIDE
    return np.add.reduceat(samples, cuts, axis=axis) / np.expand_dims(np.diff([*cuts, n]), 1 - axis)


def low_frequencies(samples: np.ndarray) -> bytes:
    """LOW x LOW signs: whether each low-frequency coefficient is over the median of all but the constant one."""
    small = _shrink(_shrink(samples.astype(np.float64), 1), 0)
    low = (COSINES @ small @ COSINES.T).round(6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media, payload, n_bytes, hash): each text's PNG, what reads back from it, and its frequency hash."""
    return map_texts(docs, [key], text, {"media": "binary", "payload": "binary", "n_bytes": "long", "hash": "binary"}, lambda: stored)


def stored(text: str | None) -> tuple[bytes, bytes, int, bytes]:
    """(PNG, payload read back, bytes before padding, frequency hash) of one text."""
    payload, n = payload_of(text)
    media = encode(payload)
    samples = decode(media)
    return media, samples.tobytes(), n, low_frequencies(samples)


def digests(docs: DataFrame) -> DataFrame:
    """Digests of ``media_columns``, taken where the media are, so that the files don't travel."""
    columns = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def digest(text: str | None) -> tuple:
        media, payload, n, low = stored(text)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), low.hex()

    return map_texts(docs, ["doc_id"], "text", columns, lambda: digest)
