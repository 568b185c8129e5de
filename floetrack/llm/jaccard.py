"""N-gram Jaccard join in metric space: pivots, Voronoi cells, triangle-inequality windows.

The distance 1 - J between shingle sets is a metric. Almost all pairs of texts are at distance 1, where a
pivot drawn at large says nothing and its window would hold everything. So pivots are taken where texts are
dense, cells end at the threshold, and exact bounds tell which texts can have a neighbour at all:

1. Equal sets become one node. No pair of equal texts is ever made.
2. Nodes that can link: a link leaves at most H shingles that only one of its sets has, so of H + 1 or more
   parts of a set, cut by a hash of the shingles, one is the same in both. Nodes without a part that another
   node has link with nothing and are cells of their own; all that follows is over the other nodes.
3. Two sets with J >= t share a shingle among the first n - ceil(t n) + 1 of each in any one order. Here shingles
   of one node come first, then rare before frequent ones, all by counts over all nodes that can link.
4. Pivots: of the nodes that share such a shingle, the one with the least share of shingles of its own. A
   node goes to the Voronoi cell of its nearest pivot, if that is within the threshold; a pivot may lie in
   the cell of another, recursively. r(a) bounds a node's distance from the pivot of its cell.
5. Cells join in turn, by their pivots: two whose members share a shingle of step 3, at places that leave
   room for a link, have their pivots compared. Within the threshold the cells are one.
6. Windows: of other cells P and Q only nodes a and b with d(P, Q) <= 1 - t + r(a) + r(b) can link, by the
   triangle inequality. These boundary nodes of each are put beside the other's and compared.

Every link lies within a cell or joins two cells by step 5 or 6; each join is by an exact comparison. So the
components are exact.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floetrack.llm import bytesview, components, exchange, store

SHINGLE, NUMERATOR, DENOMINATOR = 4, 85, 100
#: Counters of shingles by hash, which order frequent ones; a fixed number.
COUNTERS = 1 << 18
#: Bits of the filter over texts: for each text wanted, and at most. Where it is full, more texts are shuffled; the join decides.
FILTER_PER_TEXT, FILTER_MOST = 16, 1 << 29
#: Comparisons that one copy of a pivot's set serves.
SERVED = 256
WORD_BYTES = ~bytesview.byte_class((0x20, 0x20), (0x09, 0x0D))
_SALTS = tuple(np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x6C62272E07BB0142, 0x27D4EB2F165667C5))


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct hashes of the word shingles) of every text; fewer than k words are one shingle."""
    for a, b, raw, offsets in bytesview.text_chunks(column):
        words, _, first = bytesview.words(raw, offsets, WORD_BYTES)
        if len(words) >= k:
            mixed = words[: len(words) - k + 1].copy()
            for i in range(1, k):
                mixed = mixed * np.uint64(0x9DDFEA08EB382D69) + words[i : len(words) - k + 1 + i]
            mixed = bytesview.mix(mixed)
        for row in range(a, b):
            s, e = int(first[row - a]), int(first[row - a + 1])
            if e - s >= k:
                yield row, np.unique(mixed[s : e - k + 1])
            elif e > s:
                whole = np.array([e - s], np.uint64)
                for w in words[s:e]:
                    whole = bytesview.mix(whole ^ w) * np.uint64(0xD6E8FEB86659FD93)
                yield row, whole
            else:
                yield row, np.zeros(0, np.uint64)


def set_key(values: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that equal sets share."""
    return bytesview.mix(values + _SALTS[0]).sum(dtype=np.uint64), bytesview.mix(values ^ _SALTS[1]).sum(dtype=np.uint64)


class Parts:
    """How sets are cut, by classes of their size, so that two that link have a part in common.

    A class's sizes lie within the threshold of each other, so a set's partners are in its own class or one
    beside it. A pair uses the cut of the smaller one's class: parts enough that, beside those with a
    difference and ``slack`` empty ones, one is left. A set with more empty parts adds a mark that all such
    sets of the class share; no pair depends on an empty part unless both have the mark.
    """

    def __init__(self, numerator: int, denominator: int):
        self.ratio = (numerator, denominator)
        self.low, self.high, self.parts, self.slack = [], [], [], []
        low = 1
        while low < 1 << 40:
            high = low * denominator // numerator
            differ = high * (denominator - numerator) // numerator
            empty = 1.3 * (differ + 1) * math.exp(-low / (differ + 1))
            slack = int(empty + 2 * math.sqrt(empty))
            self.low.append(low)
            self.high.append(high)
            self.slack.append(slack)
            self.parts.append(differ + 1 + slack if differ else 0)  # without a difference only equal sets link
            low = high + 1
        self._lows = np.array(self.low)

    def marks(self, values: np.ndarray) -> np.ndarray:
        """64-bit hashes of the parts of a set of ascending values, under its own class's cut and that of the class below."""
        numerator, denominator = self.ratio
        n = len(values)
        own = int(np.searchsorted(self._lows, n, side="right")) - 1
        cuts = [own] if own == 0 or -(-numerator * n // denominator) > self.high[own - 1] else [own, own - 1]
        out, mixed = [], None
        for cut in cuts:
            m = self.parts[cut]
            if not m:
                continue
            if mixed is None:
                mixed = bytesview.mix(values ^ _SALTS[2])
            part = ((values >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            name = part[edge] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(cut * 0x1000193 + 1)
            out.append(bytesview.mix(np.add.reduceat(mixed, edge) + name))
            if m - len(edge) > self.slack[cut]:
                out.append(bytesview.mix(np.array([cut + 1], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


@functools.lru_cache(8)
def parts_for(numerator: int, denominator: int) -> Parts:
    return Parts(numerator, denominator)


def features(docs: DataFrame, key: str, text: str, k: int, numerator: int, denominator: int) -> DataFrame:
    """For each row: id, th1, th2 (of its text), n, key1, key2 (of its set), marks (of its parts, packed) and a uid; written."""
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = parts_for(numerator, denominator)
        for batch in batches:
            n, one, two, marks = [], [], [], []
            for _, values in shingle_sets(batch.column(3), k):
                n.append(len(values))
                own = np.array(set_key(values)).view(np.int64)
                one.append(int(own[0]))
                two.append(int(own[1]))
                marks.append(exchange.pack(cut.marks(values)) if len(values) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(marks, pa.binary())], names=["id", "th1", "th2", "n", "key1", "key2", "marks"])

    schema = T.StructType([T.StructField("id", kind)])
    for name, of in (("th1", T.LongType()), ("th2", T.LongType()), ("n", T.IntegerType()), ("key1", T.LongType()), ("key2", T.LongType()), ("marks", T.BinaryType())):
        schema = schema.add(name, of)
    rows = docs.select(F.col(key).alias("id"), *store.text_keys(text), F.col(text).alias("text")).mapInArrow(run, schema)
    return store.materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "shingles")


def not_alone(rows: DataFrame) -> DataFrame:
    """(uid) of the rows of ``features`` with a part that another row has; all that link with another set are among them.

    Rows of equal sets may be among them as well.
    """
    total = rows.agg(F.sum(F.octet_length("marks"))).first()[0] or 0

    def send(batch: pa.RecordBatch) -> exchange.Sent:
        uid, key, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
        first = np.zeros(len(uid), bool)
        first[np.unique(key, return_index=True)[1]] = True  # of equal sets within a batch one is enough
        ends = np.frombuffer(marks.buffers()[1], np.int32)[marks.offset : marks.offset + len(uid) + 1].astype(np.int64)
        size = np.diff(ends) // 6
        hashes = exchange.unpack(np.frombuffer(marks.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]])
        owner = np.repeat(np.arange(len(uid)), size)
        keep = first[owner]
        hashes, owner = hashes[keep], owner[keep]
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        many, lead = exchange.repeated(hashes)
        yield None, [uid[np.unique(owner[many])]]
        yield hashes[lead], [uid[owner[lead]]]

    def settle(hashes: np.ndarray, known: list[np.ndarray], other: list[np.ndarray]) -> exchange.Sent:
        order = np.argsort(hashes, kind="stable")
        many, _ = exchange.repeated(hashes[order])
        uid = np.unique(np.concatenate([known[0], other[0][order][many]]))
        to = bytesview.mix(uid.view(np.uint64)) >> np.uint64(16)
        order = np.argsort(to, kind="stable")
        yield to[order], [uid[order]]

    def gather(hashes: np.ndarray, known: list[np.ndarray], other: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(other[0]))], names=["uid"])

    buckets = exchange.buckets_for(total // 6)
    return exchange.deal(rows.where("octet_length(marks) > 0").select("uid", "key1", "marks"), buckets, [np.int64], send, settle, "uid long", (max(1, buckets // 8), [np.int64], gather))


def bit_table(values: DataFrame, column: str) -> np.ndarray:
    """A filter with a bit set for each value of a long column, by its lowest bits; of a size that follows their number, up to a bound."""
    count = values.count()
    size = min(max(1 << 16, 1 << (FILTER_PER_TEXT * count).bit_length()), FILTER_MOST)
    spot = F.pmod(F.col(column), F.lit(size))
    bits = values.select(F.floor(spot / 64).cast("int").alias("word"), F.pmod(spot, F.lit(64)).cast("int").alias("bit"))
    words = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    table = np.zeros(size // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.view(np.uint64)


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which unsigned values have their bit set."""
    at = values & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def sets_of(docs: DataFrame, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """(uid, n, body) of the wanted nodes (uid, th1, th2): each one's ascending shingles as bytes, written.

    A filter of bounded size spares most other texts the shuffle; the join decides. Equal texts are combined
    before it.
    """
    held = docs.sparkSession.sparkContext.broadcast(bit_table(wanted, "th1"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = held.value, {}
        for batch in batches:
            one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keep = passes(table, one.view(np.uint64))
            for i in np.flatnonzero(keep):
                own = (int(one[i]), int(two[i]))
                if own in seen:
                    keep[i] = False
                else:
                    seen[own] = None
                    if len(seen) > 1 << 16:
                        del seen[next(iter(seen))]  # the oldest; a later copy is combined by the shuffle
            yield batch.filter(pa.array(keep))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [values for _, values in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in found], pa.int32()), pa.array([v.tobytes() for v in found], pa.binary())], names=["uid", "n", "body"])

    texts = docs.select(*store.text_keys(text), F.col(text).alias("text")).mapInArrow(chosen, "th1 long, th2 long, text string")
    once = texts.groupBy("th1", "th2").agg(F.first("text").alias("text"))
    out = store.materialise(once.join(wanted, ["th1", "th2"]).select("uid", "text").mapInArrow(cut, "uid long, n int, body binary"), "sets")
    held.destroy()
    return out


def counters(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall on each of COUNTERS hashes; summed by tasks, then by part."""
    parts, width = 64, COUNTERS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            lists = [np.frombuffer(b.as_buffer(), np.uint64) for b in batch.column(0)]
            for a, b in _runs([len(x) for x in lists]):
                total += np.bincount((np.concatenate(lists[a:b]) >> np.uint64(46)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.astype(np.uint32).tobytes() for x in total.reshape(parts, width)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "counts"])

    got = sets.select("body").mapInArrow(count, "part int, counts binary").repartition(parts, "part").mapInArrow(add, "part int, counts binary").toArrow()
    out = np.zeros((parts, width), np.int64)
    for part, counts in zip(got.column("part").to_pylist(), got.column("counts").to_pylist(), strict=True):
        out[part] += np.frombuffer(counts, np.int64)
    return out.ravel()


def entries(sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(uid, n, own, s, rest) of each set's first shingles that another set has, written.

    The order: shingles of one set only, then by the logarithm of the counter, then by hash. ``own`` is the number
    of the first kind; ``rest`` is how many shingles of the set come from this one on. Sets whose first shingles are
    all their own have no rows.
    """
    spark = sets.sparkSession
    held = spark.sparkContext.broadcast(np.log2(counters(sets) + 1).astype(np.uint8))
    total = sets.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    late = np.uint32(0xFFFFFFFF)

    def send(batch: pa.RecordBatch) -> exchange.Sent:
        level = held.value
        uid, lists = batch.column(0).to_numpy(), [np.frombuffer(b.as_buffer(), np.uint64) for b in batch.column(1)]
        for a, b in _runs([len(x) for x in lists]):
            values = np.concatenate(lists[a:b])
            size = np.array([len(x) for x in lists[a:b]])
            owner = np.repeat(np.arange(b - a), size)
            # Each shingle's place in its set's order, as far as it is known; only the first can be wanted back.
            order = np.lexsort((values, level[(values >> np.uint64(46)).astype(np.int64)], owner))
            place = np.empty(len(values), np.uint32)
            place[order] = (np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32)
            place[place >= (size + (-numerator * size) // denominator + 1)[owner]] = late
            short = values >> np.uint64(16)
            order = np.argsort(short, kind="stable")
            short, owner, place = short[order], owner[order], place[order]
            many, lead = exchange.repeated(short)
            yield None, [uid[a:b][owner[many]], short[many], place[many], np.ones(int(many.sum()), np.uint8)]
            # One entry of each shingle meets the other batches'; it says whether it has been counted already.
            yield short[lead], [uid[a:b][owner[lead]], np.zeros(int(lead.sum()), np.uint64), place[lead], many[lead].astype(np.uint8)]

    def settle(hashes: np.ndarray, known: list[np.ndarray], other: list[np.ndarray]) -> exchange.Sent:
        order = np.argsort(hashes, kind="stable")
        many = order[exchange.repeated(hashes[order])[0]]
        many = many[other[3][many] == 0]
        uid, s, place = np.concatenate([known[0], other[0][many]]), np.concatenate([known[1], hashes[many]]), np.concatenate([known[2], other[2][many]])
        # For each set the number found here, and those that can be wanted.
        own, count = np.unique(uid, return_counts=True)
        first = place != late
        uid, s, place = np.concatenate([own, uid[first]]), np.concatenate([np.zeros(len(own), np.uint64), s[first]]), np.concatenate([np.full(len(own), late), place[first]])
        count = np.concatenate([count, np.zeros(int(first.sum()), np.int64)]).astype(np.uint32)
        to = bytesview.mix(uid.view(np.uint64)) >> np.uint64(16)
        order = np.argsort(to, kind="stable")
        yield to[order], [uid[order], s[order], place[order], count[order]]

    def gather(hashes: np.ndarray, known: list[np.ndarray], other: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        uid, s, place, count = other
        order = np.argsort(uid, kind="stable")
        uid, s, place, count = uid[order], s[order], place[order], count[order]
        start = np.flatnonzero(np.append(True, uid[1:] != uid[:-1])) if len(uid) else np.zeros(0, np.int64)
        first = place != late
        ends = np.append(0, np.cumsum(first))[np.append(start, len(uid))]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[first].astype(np.int64))) for x in (place, s)]
        shared = np.add.reduceat(count.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(uid[start]), pa.array(shared), *lists], names=["uid", "shared", "place", "s"])

    buckets = exchange.buckets_for(total)
    then = (buckets, [np.int64, np.uint64, np.uint32, np.uint32], gather)
    whole = exchange.deal(sets.select("uid", "body"), buckets, [np.int64, np.uint64, np.uint32, np.uint8], send, settle, "uid long, shared long, place array<long>, s array<long>", then)
    whole = whole.select("uid", "shared", F.arrays_zip("place", "s").alias("some"))
    size = F.expr(f"n - ({numerator} * n + {denominator - 1}) div {denominator} + 1")
    firsts = whole.join(sets.select("uid", F.col("n").cast("long").alias("n")), "uid").withColumns({"own": F.col("n") - F.col("shared"), "size": size}).where("own < size")
    firsts = firsts.withColumn("some", F.slice(F.array_sort("some"), F.lit(1), F.greatest(F.col("size") - F.col("own"), F.lit(0)).cast("int")))
    rows = firsts.select("uid", "n", "own", F.posexplode("some").alias("at", "one"))
    out = store.materialise(rows.select("uid", "n", "own", F.col("one.s").alias("s"), (F.col("n") - F.col("own") - F.col("at")).alias("rest")), "entries")
    held.destroy()
    return out


def _runs(sizes: list[int], most: int = 200_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``most`` values, or of one row."""
    a, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield a, i
            a, total = i, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


def compare(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of uids with the sizes of their sets' intersection and union, written.

    A pivot b may be in very many pairs: its set is sent once for SERVED of them, to tasks that then read
    the other sets one by one.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(SERVED)).cast("int").alias("turns"))
    left = pairs.join(many, "b").select("b", F.pmod(F.xxhash64("a"), F.col("turns")).cast("int").alias("turn"), "a")
    left = left.join(sets.select(F.col("uid").alias("a"), "body"), "a").select("b", "turn", "a", "body")
    right = many.select("b", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn")).join(sets.select(F.col("uid").alias("b"), "body"), "b")
    both = right.select("b", "turn", F.lit(None).cast("long").alias("a"), "body").unionByName(left)
    both = both.repartition("b", "turn").sortWithinPartitions("b", "turn", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.uint64)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for b, a, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                values = np.frombuffer(body.as_buffer(), np.uint64)
                if a is None:
                    pivot = np.array(values)
                    continue
                common = len(np.intersect1d(values, pivot, assume_unique=True))
                for column, value in zip(out, (a, b, common, len(values) + len(pivot) - common), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["a", "b", "common", "united"])

    return store.materialise(both.mapInArrow(run, "a long, b long, common int, united int"), "compared")


def _linked(numerator: int, denominator: int) -> Column:
    return denominator * F.col("common").cast("long") >= numerator * F.col("united").cast("long")


def cells(sets: DataFrame, firsts: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(uid, root, r) of the nodes that lie in the cell of another node."""
    groups = firsts.groupBy("s").agg(F.count("*").alias("many"), F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "uid", "n")).alias("pivot"))
    groups = groups.where("many > 1").select("s", F.col("pivot.uid").alias("b"), F.col("pivot.n").alias("size"))
    near = (denominator * F.least("n", "size") >= numerator * F.greatest("n", "size")) & (F.col("uid") != F.col("b"))
    pairs = store.materialise(firsts.join(groups, "s").where(near).select(F.col("uid").alias("a"), "b").distinct(), "pivot-pairs")
    close = compare(sets, pairs).where(_linked(numerator, denominator))
    # The nearest pivot. A pivot is less than its node by (share of its own, uid), so there are no cycles.
    home = close.groupBy("a").agg(F.min(F.struct((1 - F.col("common") / F.col("united")).alias("d"), F.col("b"))).alias("home"))
    home = store.materialise(home.select(F.col("a").alias("uid"), F.col("home.b").alias("root"), F.col("home.d").alias("r")), "cells")
    while True:
        up = home.select(F.col("uid").alias("root"), F.col("root").alias("_root"), F.col("r").alias("_r"))
        if home.join(up, "root", "left_semi").isEmpty():
            return home
        home = store.materialise(
            home.join(up, "root", "left").select("uid", F.coalesce("_root", "root").alias("root"), (F.col("r") + F.coalesce("_r", F.lit(0.0))).alias("r")),
            "cells",
        )


def _may_link(numerator: int, denominator: int) -> Column:
    """Whether sizes and the places of a shared shingle leave room for a link; exact for the first shingle shared."""
    total = denominator + numerator
    return (
        (F.col("x.root") < F.col("y.root"))
        & (denominator * F.col("x.hi") >= numerator * F.col("y.lo"))
        & (denominator * F.col("y.hi") >= numerator * F.col("x.lo"))
        & (total * F.least("x.rest", "y.rest") >= numerator * (F.col("x.lo") + F.col("y.lo")))
    )


def links(sets: DataFrame, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(cells as of ``cells``, pairs (a, b) of cells that a link joins)."""
    firsts = entries(sets, numerator, denominator)
    home = cells(sets, firsts, numerator, denominator)
    placed = firsts.join(home, "uid", "left").withColumns({"root": F.coalesce("root", "uid"), "r": F.coalesce("r", F.lit(0.0))})
    spread = placed.groupBy("s", "root").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest"))
    spread = store.materialise(spread, "spread")
    shared = spread.groupBy("s").agg(F.count("*").alias("many")).where("many > 1").select("s")
    meeting = store.materialise(spread.join(shared, "s", "left_semi"), "meeting")
    pairs = meeting.alias("x").join(meeting.alias("y"), (F.col("x.s") == F.col("y.s")) & _may_link(numerator, denominator))
    pairs = store.materialise(pairs.select(F.col("x.root").alias("a"), F.col("y.root").alias("b")).distinct(), "cell-pairs")
    measured = compare(sets, pairs)
    joined = measured.where(_linked(numerator, denominator)).select("a", "b")

    # Cell pairs that their members' distances from the pivots leave open.
    reach = home.groupBy("root").agg(F.max("r").alias("reach"))
    width = 1 - numerator / denominator + 1e-9
    open_pairs = (
        measured.where(~_linked(numerator, denominator))
        .join(reach.select(F.col("root").alias("a"), F.col("reach").alias("_a")), "a", "left")
        .join(reach.select(F.col("root").alias("b"), F.col("reach").alias("_b")), "b", "left")
        .withColumn("d", 1 - F.col("common") / F.col("united"))
        .where("coalesce(_a, _b) IS NOT NULL")
        .where(F.col("d") <= width + F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0)))
        .select("a", "b", "d")
    )
    open_pairs = store.materialise(open_pairs, "open-pairs")
    if not open_pairs.isEmpty():
        at_edge = open_pairs.select(F.explode(F.array("a", "b")).alias("root")).distinct()
        edge = placed.join(at_edge, "root", "left_semi").select("uid", "root", "r", "s", "rest", F.col("n").alias("lo"), F.col("n").alias("hi"))
        edge = store.materialise(edge, "edge-entries")
        window = open_pairs.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "d")
        inner = edge.alias("x").join(edge.alias("y"), (F.col("x.s") == F.col("y.s")) & _may_link(numerator, denominator))
        inner = inner.select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b"), F.col("x.root").alias("ra"), F.col("y.root").alias("rb"), (F.col("x.r") + F.col("y.r")).alias("r")).distinct()
        inner = store.materialise(inner.join(window, ["ra", "rb"]).where(F.col("d") <= width + F.col("r")).select("a", "b"), "edge-pairs")
        found = compare(sets, inner).where(_linked(numerator, denominator)).select("a", "b")
        roots = home.select("uid", "root")
        found = found.join(roots.select(F.col("uid").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("uid").alias("b"), F.col("root").alias("rb")), "b", "left")
        joined = joined.union(found.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    return home, joined


def near_duplicates(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
) -> DataFrame:
    """(id, n_shingles, component_id, th1, th2, kept, repeats) for each row of ``docs``: two texts link when their
    distinct word shingles have a Jaccard similarity of numerator / denominator or more.

    component_id is the least id among the rows reachable by links, itself included; ids may be of any
    ordered type. Words are what lies between ASCII white space, A-Z lower-cased. Texts without words, and
    null texts, have 0 shingles, link with nothing and keep their own id. Repeated rows are equal texts. A
    null id is never a component's id; a component without any id has null. An empty table gives an empty
    table. Other columns of ``docs``, whatever their names, play no part.

    th1 and th2 identify a row's text. ``kept`` marks the rows of one id and text in each component, the least
    (rows with an id first), and every row without words; ``repeats`` counts the rows with that id and text.
    """
    spark = docs.sparkSession
    with store.scratch(spark):
        rows = features(docs, key, text, shingle, numerator, denominator)
        with store.files_for(spark, rows.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0):
            found = _near_duplicates(docs, rows, text, shingle, numerator, denominator)
            return store.materialise(found, "near-duplicates", keep=True)


def _near_duplicates(docs: DataFrame, rows: DataFrame, text: str, shingle: int, numerator: int, denominator: int) -> DataFrame:
    facts = rows.where("n > 0").select("uid", "id", "th1", "th2", "n", "key1", "key2")
    some = facts.join(not_alone(rows).withColumn("met", F.lit(1)), "uid", "left")
    nodes = some.groupBy("key1", "key2").agg(F.min(F.struct("uid", "th1", "th2")).alias("first"), F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull(), "id", "th1", "th2")).alias("keeps"), F.max("met").alias("met"))
    nodes = store.materialise(nodes.select("key1", "key2", F.col("first.uid").alias("uid"), F.col("first.th1").alias("th1"), F.col("first.th2").alias("th2"), "least", "keeps", "met"), "nodes")
    sets = sets_of(docs, text, shingle, nodes.where("met = 1").select("uid", "th1", "th2"))
    home, joined = links(sets, numerator, denominator)

    final = components.components(joined).select(F.col("id").alias("root"), "component")
    inside = nodes.select("key1", "key2", "uid", "least", "keeps").join(home.select("uid", "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    inside = inside.join(final, "root", "left").withColumn("component", F.coalesce("component", "root"))
    least = inside.groupBy("component").agg(F.min("least").alias("component_id"), F.min("keeps").alias("keeps"))
    named = inside.select("key1", "key2", "component").join(least, "component").select("key1", "key2", "component_id", "keeps")
    again = rows.groupBy("id", "th1", "th2").agg(F.count("*").alias("repeats")).where("repeats > 1").withColumnRenamed("id", "_id")
    out = rows.select("id", "th1", "th2", "n", "key1", "key2").join(named, ["key1", "key2"], "left")
    out = out.join(again, out["id"].eqNullSafe(again["_id"]) & (out["th1"] == again["th1"]) & (out["th2"] == again["th2"]), "left").select(out["*"], F.coalesce("repeats", F.lit(1)).alias("repeats"))
    own = F.struct(F.col("id").isNull(), "id", "th1", "th2")
    none = F.col("n") == 0
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(none, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), "th1", "th2", (none | own.eqNullSafe(F.col("keeps"))).alias("kept"), F.col("repeats").cast("long").alias("repeats"))
