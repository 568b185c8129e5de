"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents: each segment holds the postings (positions of every term) of
a run of texts and is stored as one row. Segments are searched alone, without a shuffle. For each
window of a test item the shortest posting list, that of its rarest term in the segment, gives the
candidates; the other lists, shifted by their offsets, are intersected with them from rare to common.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floetrack.llm import bytesview, store
from floetrack.llm.store import text_keys

WINDOW = 13
#: Words: digits, letters and everything beyond ASCII.
WORD_BYTES = bytesview.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Words of test items held at once by a task and by the driver; a larger set is searched for in blocks.
BLOCK_WORDS = 250_000
#: Bytes of the texts of a segment, about, and places that a search follows at a time.
SEGMENT_BYTES, PLACES = 1 << 20, 1 << 20
SEGMENT = ("segment", "ids", "th1", "th2", "first", "n_words", "terms", "begin", "places")


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The stored index of ``docs``, of all their words: one row for each segment.

    Positions within a segment leave a gap of ``window`` after each text, so no shifted list crosses texts.
    Null and empty texts have no words but keep their place; ids may be of any type, null or repeated; an
    empty table gives an empty index. Other columns, whatever their names, play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in bytesview.text_chunks(batch.column(3), SEGMENT_BYTES):
                terms, which, first = bytesview.words(raw, offsets, WORD_BYTES)
                start = first[:-1] + np.arange(b - a) * window
                place = (np.arange(len(terms)) + which * window).astype(np.uint32)
                order = np.argsort(terms, kind="stable")
                terms, place = terms[order], place[order]
                begin = np.flatnonzero(np.diff(terms, prepend=terms[:1] ^ np.uint64(1))) if len(terms) else np.zeros(0, np.int64)
                lists = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), c.slice(a, b - a)) for c in batch.columns[:3]]
                packed = [start.astype(np.uint32), np.diff(first).astype(np.uint32), terms[begin], begin.astype(np.uint32), place]
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=list(SEGMENT))

    rows = docs.select(F.col(key).alias("id"), *text_keys(text), F.col(text).alias("text"))
    kinds = [T.StringType(), *(T.ArrayType(f.dataType) for f in rows.schema.fields[:3]), *[T.BinaryType()] * 5]
    return store.materialise(rows.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in zip(SEGMENT, kinds, strict=True)])), "postings")


class Query:
    """The windows of a set of test items: hashes of their terms, their lengths and their items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = [i or "" for i, _ in items]
        grids, lengths, owner = [np.zeros((0, window), np.uint64)], [], []
        for k, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words, _, _ = bytesview.words(raw, np.array([0, len(raw)]), WORD_BYTES)
            size = min(window, len(words))
            if size:
                own = np.lib.stride_tricks.sliding_window_view(words, size)
                grids.append(np.pad(own, ((0, 0), (0, window - size))))
                lengths += [size] * len(own)
                owner += [k] * len(own)
        grid = np.concatenate(grids)
        self.length, self.owner = np.array(lengths, np.int64), np.array(owner, np.int64)
        inside = np.arange(window)[None, :] < self.length[:, None]
        self.vocabulary = np.unique(grid[inside])
        self.grid = np.where(inside, np.searchsorted(self.vocabulary, grid), -1).astype(np.int32)


def _lists(row: dict, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment: the size and begin of each vocabulary term's list, and all lists."""
    terms, begin = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["begin"], np.uint32).astype(np.int64)
    places = np.frombuffer(row["places"], np.uint32).astype(np.int64)
    size = np.diff(np.append(begin, len(places)))
    spot = np.searchsorted(terms, vocabulary)
    there = spot < len(terms)
    there[there] = terms[spot[there]] == vocabulary[there]
    safe = np.where(there, spot, 0)
    if not len(terms):
        return np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64), places
    return np.where(there, size[safe], 0), np.where(there, begin[safe], 0), places


def search(row: dict, query: Query, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of each match in a segment: exact phrases, or with ``slop`` every term within that many places of its own.

    Place is that of the window's first word, as the rarest term's offset gives it.
    """
    size, begin, places = _lists(row, query.vocabulary)
    if not len(query.grid) or not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = query.grid >= 0
    count = np.where(inside, size[query.grid], np.iinfo(np.int64).max)
    some = np.flatnonzero(count.min(axis=1) > 0)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # (term, place) in one ascending list: a shifted list is intersected by looking its sums up there.
    used = np.flatnonzero(size)
    term = np.repeat(used, size[used])
    at = np.repeat(begin[used], size[used]) + np.arange(len(term)) - np.repeat(np.cumsum(size[used]) - size[used], size[used])
    keys = (term << 33) + places[at]  # ascending, as terms are and the places within a term
    order = np.argsort(count[some], axis=1, kind="stable")
    many = size[query.grid[some, order[:, 0]]]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    turn = np.cumsum(many) // PLACES  # so many candidates are followed at a time, or those of one window
    for t in np.unique(turn):
        out.append(_follow(query, some[turn == t], order[turn == t], size, begin, places, keys, slop))
    return np.concatenate([w for w, _ in out]), np.concatenate([f for _, f in out])


def _follow(query: Query, some: np.ndarray, order: np.ndarray, size: np.ndarray, begin: np.ndarray, places: np.ndarray, keys: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """The matches of some windows, from each one's rarest term on."""
    rare = query.grid[some, order[:, 0]]
    many = size[rare]
    which = np.repeat(np.arange(len(some)), many)
    at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    found = places[begin[rare][which] + at] - order[which, 0]
    ok = found >= 0
    which, found = which[ok], found[ok]
    for r in range(1, query.grid.shape[1]):
        offset = order[which, r]
        live = query.length[some[which]] > r
        wanted = (query.grid[some[which], offset].astype(np.int64) << 33) + found + offset
        spot = np.searchsorted(keys, np.where(live, wanted - slop, 0))
        near = keys[np.minimum(spot, len(keys) - 1)]
        hit = ~live | ((spot < len(keys)) & (near <= wanted + slop))
        which, found = which[hit], found[hit]
    return some[which], found


def _matches(index: DataFrame, query: Query, slop: int) -> DataFrame:
    """For each document of the index: n_words, covered runs of its words [start, end), and the items found."""
    held = index.sparkSession.sparkContext.broadcast(query)
    runs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kind = T.StructType([T.StructField("segment", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("doc_id", index.schema["ids"].dataType.elementType), T.StructField("th1", T.LongType()), T.StructField("th2", T.LongType()), T.StructField("n_words", T.LongType())])
    kind = T.StructType([*kind.fields, *T._parse_datatype_string("runs array<struct<start:int,end:int>>, items array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(i)[k].as_buffer() for i, c in enumerate(SEGMENT) if i > 3}
                ids, one, two = (batch.column(i)[k].values for i in (1, 2, 3))
                first, n_words = np.frombuffer(row["first"], np.uint32), np.frombuffer(row["n_words"], np.uint32)
                window, place = search(row, query, slop)
                doc = np.searchsorted(first, place, side="right") - 1
                start = place - first[doc].astype(np.int64)
                end = np.minimum(start + query.length[window], n_words[doc].astype(np.int64))
                covered: list[list[dict]] = [[] for _ in ids]
                for i in np.lexsort((start, doc)).tolist():
                    own, s, e = covered[doc[i]], int(start[i]), int(end[i])
                    if own and s <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], e)
                    else:
                        own.append({"start": s, "end": e})
                items: list[list[str]] = [[] for _ in ids]
                for d, o in np.unique(np.stack([doc, query.owner[window]], axis=1), axis=0).tolist():
                    items[d].append(query.names[o])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * len(ids)), pa.array(range(len(ids)), pa.int32()), ids, one, two, pa.array(n_words.astype(np.int64)), pa.array(covered, runs), pa.array(items, pa.list_(pa.string()))],
                    names=kind.names,
                )

    return index.mapInArrow(run, kind)


def find(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``search_index`` over a new index of ``docs``."""
    return search_index(build_index(docs, key=key, text=text, window=window), benchmark, text=text, item=item, window=window, slop=slop, block_words=block_words)


def search_index(index: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For each row of the indexed table: doc_id, th1 and th2 (of its text), n_words, runs (covered words) and items (found test items, sorted).

    Items with fewer words than a window are a window whole, those without words are never found; a null
    item id is the empty text, equal ids are one item. A null text has no words. Repeated rows each get a
    result. Test items beyond ``block_words`` are searched for in blocks of about that size, so that no task
    or broadcast holds more; their results are united. The index serves any test set of its window.
    """
    total = benchmark.select(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // (4 * block_words)))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    out = None
    for b in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        found = _matches(index, Query([(r["item"], r["text"]) for r in own.toArrow().to_pylist()], window), slop)
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        once = [F.first(c).alias(c) for c in ("doc_id", "th1", "th2", "n_words")]
        out = out.groupBy("segment", "n").agg(*once, F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))
        step = "(done, r) -> if(size(done) > 0 and r.start <= element_at(done, -1).end, concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, r.end)))), concat(done, array(r)))"
        out = out.withColumn("runs", F.expr(f"aggregate(runs, cast(array() as array<struct<start:int,end:int>>), {step})"))
    return out.select("doc_id", "th1", "th2", "n_words", "runs", F.array_sort(F.array_distinct("items")).alias("items"))


def report(found: DataFrame, *extra: str) -> DataFrame:
    """The digest columns: n_words, n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more is hit), and ``extra`` ones of ``found``.

    A row without words has no hits and is not contaminated; an empty table gives an empty table.
    """
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + (r["end"] - r["start"]))
    rows = found.withColumn("n_hit", hit)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *extra,
    )
