"""The point history: an append-only table with a current-version flag for each trajectory.

Every operation is keyed by trajectory, never by position. Per-trajectory reductions are aggregates
with map-side combination, so a trajectory with very many rows does not land in one task whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floetrack.functions import geo

TEMPORAL_WINDOW_DAYS = 4


def last(points: DataFrame) -> DataFrame:
    """The current point of every trajectory."""
    return points.where("is_last")


def recent(points: DataFrame, now: Column, days: int = TEMPORAL_WINDOW_DAYS) -> DataFrame:
    """Points younger than ``days`` days at a time; a point of exactly that age is out, one from the future is in."""
    return points.where(now - F.col("time") < F.expr(f"INTERVAL {int(days)} DAYS"))


def in_footprint(points: DataFrame, footprint: Column) -> DataFrame:
    """Points strictly within a ring."""
    return points.where(geo.within(F.col("x"), F.col("y"), footprint))


def candidates(points: DataFrame, now: Column, footprint: Column | None = None, days: int = TEMPORAL_WINDOW_DAYS) -> DataFrame:
    """The points an image is matched against: heads, recent, and within the footprint where one is given."""
    out = recent(last(points), now, days)
    return out if footprint is None else in_footprint(out, footprint)


def last_image_id(points: DataFrame) -> DataFrame:
    """One row: the greatest image_id, 0 of an empty table."""
    return points.agg(F.coalesce(F.max("image_id"), F.lit(0)).cast("long").alias("last_image_id"))


def ranked(rows: DataFrame, key: str, *ties: str, name: str = "rank", buckets: int = 256) -> DataFrame:
    """``rows`` with their rank from 0 in the order of a numeric key and the ties.

    Rows are dealt out by approximate quantiles of the key, buckets are counted, and rows are ordered
    within a bucket only: no task sorts the whole table.
    """
    cuts = rows.agg(F.expr(f"approx_percentile(cast({key} as double), array({', '.join(f'{i / buckets!r}D' for i in range(1, buckets))}), 10000)").alias("_cuts"))
    dealt = rows.join(F.broadcast(cuts)).withColumn("_bucket", F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c < F.col(key).cast("double")))).drop("_cuts")
    sizes = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # ``buckets`` rows
    starts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = Window.partitionBy("_bucket").orderBy(key, *ties)
    return dealt.withColumn("_at", F.row_number().over(own)).join(F.broadcast(starts), "_bucket").withColumn(name, F.col("_first") + F.col("_at") - 1).drop("_bucket", "_at", "_first")


def append(points: DataFrame, new: DataFrame, key: str, *ties: str) -> DataFrame:
    """The union, the new rows with the next trajectory ids in the order of a numeric key; missing columns are null."""
    start = points.agg(F.coalesce(F.max("trajectory_id") + 1, F.lit(0)).cast("long").alias("_start"))
    numbered = ranked(new.drop("trajectory_id"), key, *ties, name="_rank").join(F.broadcast(start)).withColumn("trajectory_id", F.col("_start") + F.col("_rank"))
    extra = [c for c in numbered.columns if c not in points.columns]
    return points.unionByName(numbered.drop(*extra), allowMissingColumns=True)


def update(points: DataFrame, new: DataFrame) -> DataFrame:
    """The union, with the old rows of the new rows' trajectories no longer heads."""
    touched = new.select("trajectory_id").distinct().withColumn("_new", F.lit(True))
    closed = points.join(touched, "trajectory_id", "left").withColumn("is_last", F.col("is_last") & F.col("_new").isNull()).drop("_new")
    return closed.select(*points.columns).unionByName(new, allowMissingColumns=True)


def heads(points: DataFrame, *ties: str) -> DataFrame:
    """The latest row of each trajectory, by time and then the ties; combined before the shuffle."""
    order = ["time", *ties]
    rest = [c for c in points.columns if c not in (*order, "trajectory_id")]
    best = points.groupBy("trajectory_id").agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select("trajectory_id", "_row.*").select(*points.columns)


def lengths(points: DataFrame) -> DataFrame:
    """The number of rows of each trajectory."""
    return points.groupBy("trajectory_id").agg(F.count("*").alias("n_points"))


def with_lengths(points: DataFrame) -> DataFrame:
    """Every row with its trajectory's number of rows."""
    return points.join(lengths(points), "trajectory_id")


def trajectory_ids(points: DataFrame) -> DataFrame:
    """The distinct trajectories."""
    return points.select("trajectory_id").distinct()


def only(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose trajectory is in ``ids``."""
    return points.join(ids.select("trajectory_id"), "trajectory_id", "left_semi")


def without(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose trajectory is not in ``ids``."""
    return points.join(ids.select("trajectory_id"), "trajectory_id", "left_anti")


def sample_fraction(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Each row with a probability."""
    return rows.sample(fraction, seed)


def sample_exact(rows: DataFrame, fraction: float, *keys: str) -> DataFrame:
    """Exactly the fraction of the rows, rounded half to even, the first by a hash of the keys."""
    mark = rows.withColumn("_at", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).cast("binary")))
    mark = mark.withColumn("_key", F.conv(F.substring("_at", 1, 12), 16, 10).cast("double"))
    total = rows.agg(F.bround(F.count("*") * F.lit(fraction), 0).cast("long").alias("_take"))
    return ranked(mark, "_key", "_at", *keys, name="_rank").join(F.broadcast(total)).where("_rank < _take").select(*rows.columns)


def interpolation_share(points: DataFrame, *by: str) -> DataFrame:
    """Of groups of rows: n, interpolated ones, and their share."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("interpolated").cast("long")).alias("n_interpolated"), F.avg(F.col("interpolated").cast("double")).alias("share"))


def quality(points: DataFrame, *by: str) -> DataFrame:
    """Of groups of rows: mean, population deviation and greatest size of the rotation; mean and least correlation."""
    return points.groupBy(*by).agg(
        F.avg("angle").alias("mean_angle"), F.stddev_pop("angle").alias("std_angle"), F.max(F.abs("angle")).alias("max_angle"), F.avg("corr").alias("mean_corr"), F.min("corr").alias("min_corr")
    )


def colour_limits(vectors: DataFrame, column: str = "speed") -> DataFrame:
    """The 1st and 99th percentiles, interpolated."""
    return vectors.agg(F.percentile(column, F.lit(0.01)).alias("p01"), F.percentile(column, F.lit(0.99)).alias("p99"))


def points_from(keypoints: DataFrame, image_id: int, angle: Column, time: Column) -> DataFrame:
    """History rows of new points: heads, not interpolated, correlation 0."""
    made = {"image_id": F.lit(image_id).cast("long"), "is_last": F.lit(True), "angle": angle, "corr": F.lit(0.0), "time": time, "interpolated": F.lit(False)}
    return reduce(lambda d, kv: d.withColumn(*kv), made.items(), keypoints)
