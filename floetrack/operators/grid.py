"""Grids, windows and cells of an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WINDOW, BORDER, STRIDE, EDGE = 64, 256, 10, 16


def bordered(rows: DataFrame, height: int, width: int, border: int = BORDER) -> DataFrame:
    """Rows whose (col, row) lie within a border, both ends included."""
    return rows.where(F.col("col").between(border, width - border) & F.col("row").between(border, height - border))


def grid_points(spark: SparkSession, height: int, width: int, stride: int = STRIDE, border: int = BORDER, mode: str = "xy") -> DataFrame:
    """(col, row) at every stride. mode ``reference`` takes steps along rows as columns, as square images do not show."""
    a, b = (height, width) if mode == "reference" else (width, height)
    cols = spark.range(0, a, stride).select(F.col("id").alias("col"))
    out = cols.select("col", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long"), F.lit(stride).cast("long"))).alias("row"))
    return bordered(out, height, width, border)


def windows(spark: SparkSession, height: int, width: int, window: int = WINDOW, step: int | None = None) -> DataFrame:
    """(cell_row, cell_col, row0, col0) of the whole windows; partial ones at the edges are left out."""
    step = step or window
    rows, cols = (height - window) // step + 1, (width - window) // step + 1
    out = spark.range(max(0, rows)).select(F.col("id").alias("cell_row"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, cols - 1)).cast("long"))).alias("cell_col"))
    return out.where(F.lit(cols > 0)).select("cell_row", "cell_col", (F.col("cell_row") * step).alias("row0"), (F.col("cell_col") * step).alias("col0"))


def cells(points: DataFrame, window: int = WINDOW) -> DataFrame:
    """Points with the cell that holds them (half-open; step equal to the window)."""
    return points.withColumn("cell_row", F.floor(F.col("row") / window)).withColumn("cell_col", F.floor(F.col("col") / window))


def cell_counts(points: DataFrame, window: int = WINDOW) -> DataFrame:
    """The number of points in each occupied cell."""
    return cells(points, window).groupBy("cell_row", "cell_col").agg(F.count("*").alias("n"))


def empty_windows(windows: DataFrame, points: DataFrame, window: int = WINDOW, step: int | None = None) -> DataFrame:
    """Windows that hold no point. Windows that overlap are matched by every window of a point."""
    if (step or window) == window:
        return windows.join(cells(points, window).select("cell_row", "cell_col").distinct(), ["cell_row", "cell_col"], "left_anti")
    many = lambda c: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - window + 1) / step)).cast("long"), F.floor(F.col(c) / step).cast("long"))
    taken = points.select(F.explode(many("row")).alias("cell_row"), "col").select("cell_row", F.explode(many("col")).alias("cell_col")).distinct()
    return windows.join(taken, ["cell_row", "cell_col"], "left_anti")


def best_per_cell(points: DataFrame, response: str, order: str, window: int = WINDOW) -> DataFrame:
    """The point of the greatest response in each cell; ties go to the least ``order``. One aggregate, combined early."""
    rows = cells(points, window)
    rest = [c for c in rows.columns if c not in ("cell_row", "cell_col", response, order)]
    best = rows.groupBy("cell_row", "cell_col").agg(F.max(F.struct(F.col(response), (-F.col(order)).alias("_o"), *rest)).alias("_b"))
    return best.select("cell_row", "cell_col", *[F.col(f"_b.{c}") for c in (response, *rest)], (-F.col("_b._o")).alias(order))


def fits(col: Column, row: Column, height: Column | int, width: Column | int, half: int = 16) -> Column:
    """Whether a square of 2 half + 1 around a place lies within the image."""
    return (row - half >= 0) & (row + half + 1 <= height) & (col - half >= 0) & (col + half + 1 <= width)


def inside(col: Column, row: Column, height: Column | int, width: Column | int, edge: int = EDGE) -> Column:
    """Whether a place is at least ``edge`` from the borders, the far ends excluded."""
    return (col >= edge) & (col < width - edge) & (row >= edge) & (row < height - edge)


def ordinals(rows: DataFrame, *order: str, name: str = "image_id") -> DataFrame:
    """Rows of a catalogue numbered from 1 in an order. The catalogue is small; large tables use ``history.ranked``."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
