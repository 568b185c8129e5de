"""Texts as UTF-8 bytes in numpy, straight from Arrow buffers, and hashes of the words in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time: arrays of 8 bytes for each stay small. A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a space after each text, and the texts' new offsets."""
    n = len(offsets) - 1
    new = offsets + np.arange(n + 1)
    keep = np.ones(len(raw) + n, dtype=bool)
    keep[new[1:] - 1] = False
    out = np.full(len(raw) + n, 32, dtype=np.uint8)
    out[keep] = raw
    return out, new


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd number and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            out = np.ones(size, dtype=np.uint64)
            out[1:] = np.uint64(base)
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads each bit of a 64-bit value over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each word in them, first word of each text): A-Z lower-cased, a space after each text.

    ``is_word`` says of each byte whether it belongs to words; no word crosses texts.
    """
    lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    data, new = spaced(lower, offsets)
    inside = is_word[data]
    inside[new[1:] - 1] = False
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return data, start, end, np.searchsorted(start, new)


def span_hashes(data: np.ndarray, start: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """For each of ``ends``, a 64-bit hash of the spans of bytes; equal spans have equal hashes everywhere."""
    if len(start) == 0:
        return [np.zeros(0, np.uint64) for _ in ends]
    up, down = powers(len(data))
    total = np.cumsum(_BYTE[data] * up)
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return [mix((total[end - 1] - before) * down[start] + (end - start).astype(np.uint64)) for end in ends]


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of some texts: hash with A-Z lower-cased, number of the text; of the texts: first word."""
    data, start, end, first = word_spans(raw, offsets, is_word)
    return span_hashes(data, start, end)[0], np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true within the ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out
