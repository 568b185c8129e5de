"""The template table: one square of pixels for each trajectory, merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(templates: DataFrame, new: DataFrame) -> DataFrame:
    """The union with the new templates of trajectories that have none."""
    return templates.unionByName(new.join(templates, "trajectory_id", "left_anti").select(*templates.columns))


def update(templates: DataFrame, new: DataFrame) -> DataFrame:
    """The templates, those of trajectories with a new one replaced; new ones of other trajectories are passed over."""
    rest = [c for c in templates.columns if c != "trajectory_id"]
    fresh = new.select("trajectory_id", F.struct(*rest).alias("_new"))
    both = templates.join(fresh, "trajectory_id", "left")
    return both.select("trajectory_id", *[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in rest]).select(*templates.columns)


def merge(templates: DataFrame, new: DataFrame) -> DataFrame:
    """Both in one full outer join: replaced where present, inserted where absent."""
    rest = [c for c in templates.columns if c != "trajectory_id"]
    old = templates.select("trajectory_id", F.struct(*rest).alias("_old"))
    fresh = new.select("trajectory_id", F.struct(*rest).alias("_new"))
    return old.join(fresh, "trajectory_id", "full").select("trajectory_id", F.coalesce("_new", "_old").alias("_t")).select("trajectory_id", "_t.*").select(*templates.columns)


def having(points: DataFrame, templates: DataFrame) -> DataFrame:
    """Points whose trajectory has a template."""
    return points.join(templates.select("trajectory_id"), "trajectory_id", "left_semi")


def missing(points: DataFrame, templates: DataFrame) -> DataFrame:
    """One row: the number of points without a template."""
    return points.join(templates.select("trajectory_id").withColumn("_t", F.lit(1)), "trajectory_id", "left").agg(F.count_if(F.col("_t").isNull()).alias("n_missing"))


def lookup(points: DataFrame, templates: DataFrame) -> DataFrame:
    """Points with their template's pixels."""
    return points.join(templates.select("trajectory_id", "pixels"), "trajectory_id")
