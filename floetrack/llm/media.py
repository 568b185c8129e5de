"""Content-addressed media in tar shards.

A payload is stored as a lossless 8-bit grey image (PNG, 64 samples a row), named by the SHA-256 of its
samples, as a member of a tar shard in the shared folder. Rows carry digest, shard, offset and length.
Metadata columns come from range reads of the 33 header bytes only; samples are read when asked for.

Every task writes shards of its own, under names no other attempt uses, so a lost executor costs a
rerun and leaves at most an unreferenced file. A payload that several tasks meet is referenced once, at
the smallest (shard, offset).
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floetrack.llm import store

ROW, HEADER_BYTES, SHARD_BYTES = 64, 33, 1 << 30
_SIGN = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A grey PNG whose samples are the payload."""
    rows = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)  # a filter byte, 0 for none, leads each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _SIGN + part(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), level)) + part(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes of an image."""
    if data[:8] != _SIGN or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def decode(data: bytes) -> bytes:
    """The samples of an image that ``encode`` made."""
    width, height, _ = header(data)
    at, body = 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += size + 12
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the share of zeros, as text."""
    seen = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p, levels = seen / len(payload), np.arange(256)
    mean = float((p * levels).sum())
    some = p[p > 0]
    return f"mean={mean:.4f};std={float(np.sqrt((p * (levels - mean) ** 2).sum())):.4f};entropy={float(-(some * np.log2(some)).sum()):.4f};zeros={p[0]:.4f}"


def payload_digest(text: Column) -> Column:
    """The SHA-256 of a text's payload, 32 bytes, as a column expression."""
    data = F.coalesce(text.cast("binary"), F.lit(b"").cast("binary"))
    size = F.octet_length(data)
    fill = F.greatest(F.lit(ROW), F.ceil(size / ROW) * ROW).cast("int") - size
    return F.unhex(F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("00"), fill))), 256))


def write(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Stores the payloads of all texts in tar shards below ``folder``; the index (digest, shard, start, length), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        seen: set[bytes] = set()
        out = name = None
        try:
            for batch in batches:
                rows = []
                for value in batch.column(0):
                    payload = padded((value.as_py() or "").encode())
                    key = hashlib.sha256(payload).digest()
                    if key in seen:
                        continue
                    seen.add(key)
                    if out is None:
                        name = f"{uuid.uuid4().hex}.tar"
                        out = files.open_output_stream(f"{base}/{name}")
                    image = encode(payload)
                    info = tarfile.TarInfo(f"{key.hex()}.png")
                    info.size = len(image)
                    out.write(info.tobuf(tarfile.GNU_FORMAT))
                    rows.append((key, name, out.tell(), len(image)))
                    out.write(image + b"\0" * (-len(image) % tarfile.BLOCKSIZE))
                    if out.tell() >= SHARD_BYTES:
                        out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pylist([dict(zip(("digest", "shard", "start", "length"), r, strict=True)) for r in rows], schema=pa.schema([("digest", pa.binary()), ("shard", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        finally:
            if out is not None:
                out.write(b"\0" * 2 * tarfile.BLOCKSIZE)
                out.close()

    return store.materialise(docs.select(text).mapInArrow(run, "digest binary, shard string, start long, length long"), "media-index")


def unique(index: DataFrame) -> DataFrame:
    """One place for each digest."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "start", "length")).alias("at")).select("digest", "at.*")


def probe(index: DataFrame, folder: str, *, samples: bool) -> DataFrame:
    """Metadata of stored media. Only headers are read, unless ``samples`` asks for the checksums and features too."""
    schema = "digest binary, media_bytes long, width int, height int, bits int"
    if samples:
        schema += ", payload_bytes long, payload_sha256 binary, tail_crc32 long, media_sha256 binary, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["shard"] != name:
                    if file is not None:
                        file.close()
                    name, file = r["shard"], files.open_input_file(f"{base}/{r['shard']}")
                width, height, bits = header(file.read_at(HEADER_BYTES, r["start"]))
                row = {"digest": r["digest"], "media_bytes": r["length"], "width": width, "height": height, "bits": bits}
                if samples:
                    image = file.read_at(r["length"], r["start"])
                    payload = decode(image)
                    row |= {
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).digest(),
                        "tail_crc32": zlib.crc32(payload[-ROW:]),
                        "media_sha256": hashlib.sha256(image).digest(),
                        "feature": feature(payload),
                    }
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
        if file is not None:
            file.close()

    kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])
    # A shard is opened once: its members lie together and in their order.
    return index.repartition("shard").sortWithinPartitions("shard", "start").mapInArrow(run, schema)


def media_columns(docs: DataFrame, *, text: str = "text", samples: bool = True) -> DataFrame:
    """``docs`` with n_bytes, digest, shard, start, length and the media columns; columns of these names are replaced.

    A null text is an empty one, stored as 64 zero bytes; equal texts share one stored payload; payloads of
    any length are stored whole; an empty table writes nothing and gives an empty table.
    """
    spark = docs.sparkSession
    folder = store.new_folder(spark, "media")
    index = unique(write(docs, folder, text))
    facts = probe(index, folder, samples=samples).join(index, "digest")
    names = [c for c in facts.columns if c != "digest"]
    kept = docs.drop("n_bytes", "digest", *names)
    rows = kept.withColumns({"n_bytes": F.coalesce(F.octet_length(F.col(text).cast("binary")), F.lit(0)).cast("long"), "digest": payload_digest(F.col(text))})
    out = rows.drop(text).join(facts, "digest").select(*[c for c in kept.columns if c != text], "n_bytes", "digest", *names)
    # Digests are bytes until here, half the size of their text in every exchange.
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("digest", "payload_sha256", "media_sha256") if c in out.columns})
