"""A minimal reader and writer of uncompressed grey TIFF: what the raster table needs, without native libraries."""

from __future__ import annotations

import struct

import numpy as np

# Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, SCALE, TIEPOINT = 256, 257, 258, 259, 273, 277, 278, 279, 33550, 33922
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def read(data: bytes) -> tuple[np.ndarray, list[float] | None]:
    """(bands, height, width) pixels and the pixel-to-map affine, if the file has one."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        raw = entry[8:12] if size * count <= 4 else data[(p := struct.unpack(order + "I", entry[8:12])[0]) : p + size * count]
        tags[tag] = struct.unpack(f"{order}{count}{code}", raw[: size * count]) if code != "s" else (raw[:count],)
    if tags.get(COMPRESSION, (1,))[0] != 1:
        raise ValueError("compressed TIFF")
    width, height, bits, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BITS, (8,))[0], tags.get(SAMPLES, (1,))[0]
    kind = {8: "u1", 16: "u2", 32: "f4"}[bits]
    body = b"".join(data[o : o + c] for o, c in zip(tags[OFFSETS], tags[COUNTS], strict=True))
    pixels = np.frombuffer(body, order + kind).reshape(height, width, samples).transpose(2, 0, 1)
    affine = None
    if SCALE in tags and TIEPOINT in tags:
        (sx, sy), (c, r, _, x, y) = tags[SCALE][:2], tags[TIEPOINT][:5]
        affine = [sx, 0.0, x - sx * c, 0.0, -sy, y + sy * r]
    return np.ascontiguousarray(pixels).astype(pixels.dtype.newbyteorder("=")), affine


def write(pixels: np.ndarray, affine: list[float] | None = None) -> bytes:
    """A TIFF of (bands, height, width) 8- or 16-bit pixels."""
    bands, height, width = pixels.shape
    body = np.ascontiguousarray(pixels.transpose(1, 2, 0)).astype(pixels.dtype.newbyteorder("<")).tobytes()
    doubles = struct.pack("<3d6d", affine[0], -affine[4], 0.0, 0.0, 0.0, 0.0, affine[2], affine[5], 0.0) if affine else b""
    bits = pixels.dtype.itemsize * 8
    extra = struct.pack(f"<{bands}H", *[bits] * bands) if bands > 2 else b""
    first = 8 + len(body) + len(body) % 2
    entries = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, bands, first + len(doubles) if bands > 2 else bits | (bits << 16 if bands == 2 else 0)), (COMPRESSION, 3, 1, 1), (262, 3, 1, 1), (OFFSETS, 4, 1, 8), (SAMPLES, 3, 1, bands), (ROWS, 4, 1, height), (COUNTS, 4, 1, len(body))]
    if affine:
        entries += [(SCALE, 12, 3, first), (TIEPOINT, 12, 6, first + 24)]
    at = first + len(doubles) + len(extra)
    at += at % 2
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    whole = struct.pack("<2sHI", b"II", 42, at) + body
    whole += b"\0" * (first - len(whole)) + doubles + extra
    return whole + b"\0" * (at - len(whole)) + table
