"""Positions of unmatched points, from the affine motion of the matched ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floetrack.functions import geo
from floetrack.operators import grid, history, matching


def unmatched(points: DataFrame, matched: DataFrame) -> DataFrame:
    """Points whose trajectory was not matched."""
    return history.without(points, matched)


def interpolate(
    points: DataFrame, matched: DataFrame, *, footprint: Column | None, affine: list[float], height: int, width: int, edge: int = grid.EDGE
) -> DataFrame:
    """(trajectory_id, x, y, interpolated) of matched and of moved points.

    ``matched``: (trajectory_id, x0, y0, x1, y1). Unmatched points whose old position lies within the
    footprint move by the least-squares affine of the matches; those that leave the image, less its
    edge, are dropped. ``affine``: pixel to map. Without a model (fewer than three matches, or all on a
    line) nothing is interpolated.
    """
    model = matching.affine_fit(matched).where("a11 IS NOT NULL AND n >= 3")
    rest = unmatched(points, matched)
    if footprint is not None:
        rest = history.in_footprint(rest, footprint)
    moved = rest.join(F.broadcast(model.drop("n")))
    px, py = matching.moved(F.col("x"), F.col("y"))
    moved = moved.select("trajectory_id", px.alias("x"), py.alias("y"))
    col, row = geo.affine_inverse(F.col("x"), F.col("y"), affine)
    moved = moved.where(grid.inside(col, row, height, width, edge))
    kept = matched.select("trajectory_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return kept.withColumn("interpolated", F.lit(False)).unionByName(moved.withColumn("interpolated", F.lit(True)))
