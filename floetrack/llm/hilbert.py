"""Sharding by a Hilbert curve over metadata columns, with DataFrame functions only.

Each metadata dimension is quantised to ``bits`` bits, the cells are put in the order of the Hilbert
curve through them, and the ordered rows are cut into runs. A run covers a compact box of every
dimension, so a reader can skip files by the minimum and maximum of several columns at once.

Ranks are found without a global sort and without a window over more than a small group: rows are
counted by (cell, text bucket, spread bucket), a table of bounded size, whose running sums give every
bucket's first rank; only rows of the same bucket are then put in order. A third of all rows in one
cell, or in one group of equal texts, is dealt out over SPREAD buckets by its ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floetrack.llm import store

#: Buckets of a cell by the text's checksum, and of those by the row's id.
GROUPS, SPREAD = 16, 64
#: Bits of an order's values that rows of one bucket may differ in.
RUN_BITS = 12


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.transform(F.array(value), lambda x: then(x))[0]


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell, from its coordinates of ``bits`` bits each.

    Gray-code form of the curve: from the highest bit down, a set bit inverts the lower bits of the
    first coordinate, a clear one exchanges them with the first coordinate's; a Gray decoding of the
    interleaved bits follows. All of it is bit arithmetic on columns.
    """
    n, x = len(coordinates), [c.cast("long") for c in coordinates]
    frame = F.array(*x)

    def turned(state: Column, *, level: int, i: int) -> Column:
        low = (1 << level) - 1
        mine, first = state[i], state[0]
        swap = (first.bitwiseXOR(mine)).bitwiseAND(F.lit(low))
        bit_set = mine.bitwiseAND(F.lit(1 << level)) != 0
        new_first = F.when(bit_set, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))
        new_mine = F.when(bit_set, mine).otherwise(mine.bitwiseXOR(swap))
        if i == 0:
            return F.array(F.when(bit_set, first.bitwiseXOR(F.lit(low))).otherwise(first), *[state[k] for k in range(1, n)])
        return F.array(new_first, *[new_mine if k == i else state[k] for k in range(1, n)])

    steps = [(level, i) for level in range(bits - 1, 0, -1) for i in range(n)]
    for level, i in steps:
        frame = let(frame, partial(turned, level=level, i=i))

    def decoded(state: Column) -> Column:
        gray = [state[0]]
        for k in range(1, n):
            gray.append(state[k].bitwiseXOR(gray[k - 1]))
        flip = reduce(
            lambda acc, level: F.when(
                gray[-1].bitwiseAND(F.lit(1 << level)) != 0, acc.bitwiseXOR(F.lit((1 << level) - 1))
            ).otherwise(acc),
            range(bits - 1, 0, -1),
            F.lit(0).cast("long"),
        )
        return let(flip, lambda t: F.array(*[g.bitwiseXOR(t) for g in gray]))

    frame = let(frame, decoded)
    return let(
        frame,
        lambda s: reduce(
            lambda a, b: a.bitwiseOR(b),
            [
                F.shiftleft(F.shiftright(s[i], level).bitwiseAND(F.lit(1)), level * n + (n - 1 - i))
                for level in range(bits)
                for i in range(n)
            ],
        ),
    )


def quantised(column: Column, kind: str, bits: int) -> Column:
    """A coordinate of ``bits`` bits. kind ``size``: base-2 logarithm, two steps each; ``label``: by checksum. Null is 0."""
    top = (1 << bits) - 1
    if kind == "size":
        step = F.floor(F.log2(F.greatest(column.cast("double"), F.lit(1.0))) * 2) - 8
        return F.when(column.isNull(), F.lit(0)).otherwise(F.least(F.greatest(step, F.lit(0)), F.lit(top))).cast("long")
    return F.when(column.isNull(), F.lit(0)).otherwise(F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(top)) + 1).cast("long")


def shard(
    docs: DataFrame,
    *,
    dimensions: list[tuple[str, str]],
    n_shards: int = 8,
    law: str = "rows",
    bits: int = 4,
    key: str = "doc_id",
    text: str = "text",
    keep_text: bool = True,
    order: str | None = None,
) -> DataFrame:
    """``docs`` with size, text_crc32, cell, law, shard and slot; columns of these names are replaced.

    Without ``keep_text`` the text column is left out, and what remains of the rows is written once, so
    that the texts are read a single time.

    ``dimensions``: (column or ``size``, ``size`` or ``label``). law ``rows``: the counts of the shards
    are at most one apart. law ``bytes``: a row goes to the shard that holds the middle of its bytes, so
    sizes differ from an equal share by less than the largest row. Slots count from 0 in each shard
    without gaps, in the order of the curve; within a cell, rows with equal texts lie together. With ``order``, a
    column of distinct longs such as row numbers, the curve decides on the shard and ``order`` on the slots in it.

    Null or empty texts have size 1 and checksum 0; null metadata has coordinate 0; rows repeated with
    all their columns, null keys included, each get a slot of their own; rows with one key go by a hash of
    the whole row. An empty table gives an empty table. Other columns may have any names.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    made = ("size", "text_crc32", "cell", "law", "shard", "slot")
    kept = docs.drop(*made, *([] if keep_text else [text]))
    # The row stays whole in one column, so no name of its own can clash.
    size = (F.octet_length(data) + 1).cast("long")
    spots = [quantised(size if name == "size" else F.col(name), kind, bits) for name, kind in dimensions]
    own = [F.col(c) for c in kept.columns]
    rows = docs.select(F.struct(*own).alias("row"), size.alias("size"), F.crc32(data).cast("long").alias("text_crc32"), hilbert_index(spots, bits).alias("cell"), F.col(key).alias("key"), F.xxhash64(*own).alias("tie"))
    rows = rows.withColumn("_g", F.pmod(F.col("text_crc32"), F.lit(GROUPS))).withColumn("_d", F.pmod(F.xxhash64("key", "tie"), F.lit(SPREAD)))
    if not keep_text:
        rows = store.materialise(rows, "shard-rows")
    parts = ["cell", "_g", "_d"]

    counts = rows.groupBy(*parts).agg(F.count("*").alias("_rows"), F.sum("size").alias("_bytes"))
    cells = counts.groupBy("cell").agg(F.sum("_rows").alias("_cell_rows"), F.sum("_bytes").alias("_cell_bytes"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 2**(bits * dimensions) rows
    every = Window.partitionBy()
    cells = cells.select(
        "cell",
        F.coalesce(F.sum("_cell_rows").over(before), F.lit(0)).alias("_rows0"),
        F.coalesce(F.sum("_cell_bytes").over(before), F.lit(0)).alias("_bytes0"),
        F.sum("_cell_rows").over(every).alias("_n"),
        F.sum("_cell_bytes").over(every).alias("_size"),
    )
    inner = Window.partitionBy("cell").orderBy("_g", "_d").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(cells, "cell").select(
        *parts,
        (F.col("_rows0") + F.coalesce(F.sum("_rows").over(inner), F.lit(0))).alias("_rows0"),
        (F.col("_bytes0") + F.coalesce(F.sum("_bytes").over(inner), F.lit(0))).alias("_bytes0"),
        "_n",
        "_size",
    )
    own = Window.partitionBy(*parts).orderBy("text_crc32", "key", "tie")
    rows = rows.withColumn("_at", F.row_number().over(own).cast("long"))
    if law == "bytes":
        rows = rows.withColumn("_before", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # A bucket's rows and its start meet by the exchange that the window has made already.
    rows = rows.join(starts, parts)
    rank = F.col("_rows0") + F.col("_at") - 1
    if law == "rows":
        number = F.expr(f"(_rows0 + _at - 1) * {n_shards} div _n")
        first = F.expr(f"(shard * _n + {n_shards} - 1) div {n_shards}")
        rows = rows.withColumn("shard", number.cast("int")).withColumn("slot", rank - first)
    else:
        number = F.expr(f"least((2 * (_bytes0 + _before) + size) * {n_shards} div (2 * _size), {n_shards - 1})")
        rows = rows.withColumn("_rank", rank).withColumn("shard", number.cast("int"))
        firsts = rows.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows
        rows = rows.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_rank") - F.col("_first"))
    if order is not None:
        rows = _in_order(rows, F.col("row")[order])
    return rows.withColumn("law", F.lit(law)).select("row.*", *made)


def _in_order(rows: DataFrame, value: Column) -> DataFrame:
    """``rows`` with the slots of each shard by ``value``: counted by its runs of values, put in order within them only."""
    rows = rows.withColumn("_value", value).withColumn("_run", F.shiftright("_value", RUN_BITS))
    counts = rows.groupBy("shard", "_run").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # a row for each run
    starts = counts.select("shard", "_run", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_value")).cast("long") - 1
    return rows.withColumn("_in_run", at).join(starts, ["shard", "_run"]).withColumn("slot", F.col("_start") + F.col("_in_run"))
