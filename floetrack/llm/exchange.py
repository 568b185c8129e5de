"""Numbers exchanged in packed runs: a row of the shuffle holds the columns of many entries as bytes.

Entries are dealt to buckets by a 48-bit hash, so that each bucket is a bounded share of them, and equal
hashes meet. What is already known within a batch is settled there, so a hash that very many rows share
sends one entry for each batch only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a bucket, about.
BUCKET = 500_000
#: What a batch sends: (None, columns) for settled entries, (ascending 48-bit hashes, columns) for the others.
Sent = Iterator[tuple[np.ndarray | None, list[np.ndarray]]]


def pack(hashes: np.ndarray) -> bytes:
    """The 48 upper bits of 64-bit hashes, six bytes each."""
    return np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unpack(data: bytes | np.ndarray) -> np.ndarray:
    """What ``pack`` packed, as numbers below 2**48."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel()


def buckets_for(entries: int) -> int:
    return max(1, -(-int(entries) // BUCKET))


def deal(rows: DataFrame, buckets: int, kinds: list[type], send: Callable[[pa.RecordBatch], Sent], settle: Callable[..., Iterator], schema: str, then: tuple[int, list[type], Callable[..., Iterator]] | None = None) -> DataFrame:
    """``settle(hashes, settled columns, other columns)`` over each bucket of what ``send`` makes of each batch.

    ``kinds`` are the numpy types of the columns. With ``then`` (buckets, kinds, settle) what the first ``settle``
    yields is sent once more, and the second makes the result. An empty table gives an empty table; nothing
    is kept in order, and equal entries stay as many as they are.
    """

    def outward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _packed(send(batch), buckets)

    def again(*bucket) -> Iterator[pa.RecordBatch]:
        yield _packed(settle(*bucket), then[0])

    out = rows.mapInArrow(outward, PACKED).repartitionById(buckets, F.col("bucket"))
    if then is not None:
        out = out.mapInArrow(_inward(kinds, again), PACKED).repartitionById(then[0], F.col("bucket"))
    return out.mapInArrow(_inward(*((kinds, settle) if then is None else then[1:])), schema)


PACKED = "bucket int, sure boolean, at binary, data binary"


def _packed(sent: Sent, buckets: int) -> pa.RecordBatch:
    """What a batch sends, a row for each bucket and kind."""
    to, sure, at, data = [], [], [], []
    for hashes, columns in sent:
        if hashes is None:
            if len(columns[0]):
                to.append(int(columns[0][0]) * 7919 % buckets)  # any bucket will do
                sure.append(True)
                at.append(b"")
                data.append(_bytes(columns))
            continue
        if not len(hashes):
            continue
        bucket = ((hashes >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
        for s, e in zip(edges, [*edges[1:], len(hashes)], strict=True):
            to.append(int(bucket[s]))
            sure.append(False)
            at.append(np.ascontiguousarray(hashes[s:e].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
            data.append(_bytes([c[s:e] for c in columns]))
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(sure, pa.bool_()), pa.array(at, pa.binary()), pa.array(data, pa.binary())], names=["bucket", "sure", "at", "data"])


def _inward(kinds: list[type], settle: Callable[..., Iterator]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for bucket, sure, at, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                known, hashes, other = held.setdefault(bucket.as_py(), ([], [], []))
                if sure.as_py():
                    known.append(data.as_py())
                else:
                    hashes.append(at.as_py())
                    other.append(data.as_py())
        while held:
            _, (known, hashes, other) = held.popitem()
            yield from settle(unpack(b"".join(hashes)), _joined(known, kinds), _joined(other, kinds))

    return run


def _bytes(columns: list[np.ndarray]) -> bytes:
    """All first bytes of a column's numbers, then all second ones: most are equal and compress well."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in map(np.ascontiguousarray, columns))


def _columns(raw: bytes, kinds: list[type]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n, out, at = len(raw) // sum(widths), [], 0
    for kind, width in zip(kinds, widths, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * width
    return out


def _joined(parts: list[bytes], kinds: list[type]) -> list[np.ndarray]:
    columns = [_columns(raw, kinds) for raw in parts]
    return [np.concatenate([np.zeros(0, kind), *(p[i] for p in columns)]) for i, kind in enumerate(kinds)]


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending hashes: which occur more than once, and which are the first of their value."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    same = hashes[1:] == hashes[:-1]
    return np.append(same, False) | np.append(False, same), np.append(True, ~same)
