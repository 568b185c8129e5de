"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (language, bucket) are gathered over all labelled rows by one distributed sum; the matrix of
log probabilities (languages x buckets, a bounded size) is broadcast; batches of texts are scored in
numpy from the sparse buckets of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floetrack.llm import bytesview

BUCKETS, ORDERS, MAX_LANGS, SMOOTHING = 1 << 14, (1, 2, 3), 256, 0.1
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or 32 for what is no letter."""
    if "letters" not in _tables:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                out[i] = ord(low) if len(low) == 1 else i
        _tables["letters"] = out
    return _tables["letters"]


def grams(raw: np.ndarray, offsets: np.ndarray, orders=ORDERS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, (bucket of each n-gram, first n-gram of each text with any, that text's number).

    Letters are lower-cased, all else is a space; an n-gram stays within its text.
    """
    data, new = bytesview.spaced(raw, offsets)
    # A byte that does not continue a character starts one.
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    points = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)]
    first = starts[new]
    for n in orders:
        if len(points) < n:
            continue
        h = points[: len(points) - n + 1].astype(np.uint32) * np.uint32(0x9E3779B1)
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[k : len(points) - n + 1 + k] * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(16)
        h = h * np.uint32(0xC2B2AE35)
        bucket = (h >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int32)
        count = np.maximum(np.diff(first) - n + 1, 0)  # the text's own space counts as its last character
        inside = np.repeat(np.arange(len(count)), count)
        begin = np.concatenate([[0], np.cumsum(count)[:-1]])
        spot = np.arange(len(inside)) - begin[inside] + first[:-1][inside]
        has = count > 0
        yield bucket[spot], begin[has], np.flatnonzero(has)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", buckets: int = BUCKETS, max_langs: int = MAX_LANGS) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities of shape (buckets + 1, languages); the last row has the priors).

    Rows with null text or language are passed over; no such row at all gives an empty model. More than
    ``max_langs`` languages raise an error: the model's size is bounded by that parameter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for a, b, raw, offsets in bytesview.text_chunks(batch.column(1)):
                names, which = np.unique(langs[a:b].astype(str), return_inverse=True)
                for name in names:
                    seen.setdefault(str(name), np.zeros(buckets + 1, np.int64))
                for bucket, begin, rows in grams(raw, offsets, buckets=buckets):
                    size = np.diff(np.append(begin, len(bucket)))
                    own = np.repeat(which[rows], size)
                    both = np.bincount(own * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
                    for i, name in enumerate(names):
                        seen[str(name)][:buckets] += both[i]
                for i, name in enumerate(names):
                    seen[str(name)][buckets] += int((which == i).sum())
        for name, total in seen.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some.astype(np.int32)), pa.array(total[some])], names=["lang", "bucket", "n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    held = counts.limit((max_langs + 1) * (buckets + 1)).toArrow()
    langs = sorted(set(held.column("lang").to_pylist()))
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    where = {name: i for i, name in enumerate(langs)}
    matrix = np.zeros((buckets + 1, len(langs)))
    matrix[held.column("bucket").to_numpy(), [where[x] for x in held.column("lang").to_pylist()]] = held.column("n").to_numpy()
    prior = np.log(matrix[buckets:] / max(matrix[buckets].sum(), 1.0)) if langs else matrix[buckets:]
    grown = matrix[:buckets] + SMOOTHING
    return langs, np.vstack([np.log(grown / grown.sum(axis=0)), prior]) if langs else matrix


def score(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language's number, its posterior, whether the text has a letter) of each text."""
    n, (rows, langs) = len(offsets) - 1, model.shape
    total = np.repeat(model[rows - 1 :], n, axis=0)
    data, new = bytesview.spaced(raw, offsets)
    for bucket, begin, which in grams(raw, offsets, buckets=rows - 1):
        for k in range(langs):
            total[which, k] += np.add.reduceat(model[bucket, k], begin)
    points = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)] != 32
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[new]
    letter = np.add.reduceat(points, at[:-1]) > 0 if n else np.zeros(0, bool)
    best = total.argmax(axis=1)
    share = np.exp(total - total.max(axis=1, keepdims=True))
    return best, 1.0 / share.sum(axis=1), letter


def predict(docs: DataFrame, fitted: tuple[list[str], np.ndarray], *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names are replaced.

    Null texts, texts without a letter, and any text under an empty model give ``und`` with score 0. Texts
    are read whole whatever their length; equal texts get equal results; ties go to the first language.
    """
    langs, matrix = fitted
    kept = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast((langs, np.asfortranarray(matrix)))
    schema = kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, model = held.value
        for batch in batches:
            found, sure = [], []
            for a, b, raw, offsets in bytesview.text_chunks(batch.column(place)):
                if not names:
                    found += ["und"] * (b - a)
                    sure.append(np.zeros(b - a))
                    continue
                best, p, letter = score(raw, offsets, model)
                found += [names[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                sure.append(np.where(letter, np.minimum(p, 1.0), 0.0))
            values = np.concatenate(sure) if sure else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(values)], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
