"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's rows, in a pseudo-random but fixed order, are cut into blocks. With a target weight a / M
(a: the source's quota, M: the sum of all quotas), block k of the source may not run before slot
floor(k M / a) and has to run before slot ceil((k + 1) M / a). At each slot the earliest deadline among
the released blocks runs. The quotas fill every slot, so all deadlines are met, and while no source has
run out, every source is within less than one block of its weight at every slot.

Release times and deadlines repeat after M slots. One period is therefore found once, by a fold over M
slots and the sources (both bounded, whatever the number of rows), and every block is looked up in it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Leading hexadecimal digits of the ordering hash by which the rows of one source are dealt out.
SPREAD_DIGITS = 3
#: More sources than this raise an error: the timetable, which is broadcast, grows with them.
MAX_SOURCES = 20_000


def quotas(docs: DataFrame, weights: Mapping[str | None, int] | None, period: int, source: str = "source") -> DataFrame:
    """(source, quota): whole shares of a period. Without weights, in proportion to the root of each source's rows.

    One row for each source, of which there are MAX_SOURCES at most; the number of rows is not bounded.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))
    if weights is not None:
        named = F.create_map(*[x for k, v in weights.items() if k is not None for x in (F.lit(k), F.lit(int(v)))]) if any(k is not None for k in weights) else F.lit(None).cast("map<string,int>")
        share = F.when(F.col("source").isNull(), F.lit(int(weights.get(None, 1)))).otherwise(F.coalesce(named[F.col("source")], F.lit(1)))
        return sizes.select("source", F.greatest(share, F.lit(1)).cast("long").alias("quota"))
    total = F.sum(F.sqrt(F.col("n").cast("double"))).over(Window.partitionBy())
    return sizes.select("source", F.greatest(F.round(F.lit(float(period)) * F.sqrt(F.col("n").cast("double")) / total), F.lit(1)).cast("long").alias("quota"))


def timetable(shares: DataFrame) -> DataFrame:
    """(source, quota, period, turn, pick): the slots, within a period, of a source's blocks; earliest deadline first."""
    one = shares.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source"), F.col("quota")))).alias("all")).where(F.size("all") > 0)
    checked = F.when(F.size("all") > MAX_SOURCES, F.raise_error(F.lit(f"more than {MAX_SOURCES} sources"))).otherwise(F.col("all"))
    one = one.withColumn("all", checked)
    one = one.withColumn("quotas", F.col("all.quota")).withColumn("period", F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q))
    # Within the fold: served[i] blocks of source i have run before slot t.
    fold = """
        aggregate(
          sequence(0L, period - 1),
          named_struct('served', transform(quotas, q -> 0L), 'picks', cast(array() as array<int>)),
          (s, t) -> transform(array(array_min(filter(transform(quotas, (q, i) ->
              if(s.served[i] * period div q <= t,
                 named_struct('deadline', ((s.served[i] + 1) * period + q - 1) div q, 'who', i), null)),
              x -> x is not null)).who),
            who -> named_struct('served', transform(s.served, (n, i) -> if(i = who, n + 1, n)), 'picks', concat(s.picks, array(who))))[0],
          s -> s.picks)"""
    slots = one.select("all", "period", F.posexplode(F.expr(fold)).alias("pick", "who"))
    slots = slots.select(F.expr("all[who].source").alias("source"), F.expr("all[who].quota").alias("quota"), "period", F.col("pick").cast("long").alias("pick"), "who")
    return slots.withColumn("turn", F.row_number().over(Window.partitionBy("who").orderBy("pick")).cast("long") - 1).drop("who")


def mix(
    docs: DataFrame,
    *,
    weights: Mapping[str | None, int] | None = None,
    period: int = 1000,
    block_rows: int = 4,
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``docs`` with quota, block, release, deadline, slot and place; columns of these names are replaced.

    Sorting by place gives the mix. No row is dropped or repeated: when a source has run out its slots
    stay empty and the others go on in their own slots. weights: quotas by source, 1 for those not named.

    A null source is a source of its own; null keys order as an empty text; rows with one key go by a hash of
    the whole row; repeated rows each get a place; an empty table gives an empty table. Other columns may
    have any names.
    """
    made = ("quota", "block", "release", "deadline", "slot", "place")
    kept = docs.drop(*made)
    # The row stays whole in one column, so no name of its own can clash. Window and join share one dealing of the rows.
    named = F.concat(F.lit("="), F.col(source).cast("string"))
    rows = kept.select(F.struct(*[F.col(c) for c in kept.columns]).alias("row"), F.col(source).alias("source"), F.coalesce(named, F.lit("")).alias("s"), F.col(key).alias("key"), F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")).alias("hash"), F.xxhash64(*[F.col(c) for c in kept.columns]).alias("tie"))
    rows = rows.withColumn("bucket", F.substring("hash", 1, SPREAD_DIGITS))
    sizes = rows.groupBy("s", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4096 rows at most
    starts = sizes.select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("s", "bucket").orderBy("hash", "key", "tie")
    rows = rows.withColumn("at", F.row_number().over(own).cast("long") - 1)
    rows = rows.join(starts, ["s", "bucket"]).withColumn("rank", F.col("first") + F.col("at"))
    rows = rows.withColumn("block", F.expr(f"rank div {int(block_rows)}"))

    # One row for each slot of a period: its size is set by the parameter and the number of sources.
    times = timetable(quotas(docs, weights, period, source)).withColumnRenamed("source", "of")
    per_source = times.groupBy("of").agg(F.first("quota").alias("quota"), F.first("period").alias("period"), F.array_sort(F.collect_list("pick")).alias("picks"))
    rows = rows.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumns(
        {
            "release": F.expr("block * period div quota"),
            "deadline": F.expr("((block + 1) * period + quota - 1) div quota"),
            "slot": F.expr("(block div quota) * period + element_at(picks, cast(block % quota as int) + 1)"),
        }
    ).withColumn("place", F.expr(f"slot * {int(block_rows)} + rank % {int(block_rows)}"))
    return rows.select("row.*", *made)


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows dealt out by ranges of their place and sorted within them: files in the order of the mix.

    Places differ, so there are no ties; an empty table stays empty; all columns are kept as they are.
    """
    return mixed.repartitionByRange("place").sortWithinPartitions("place")
