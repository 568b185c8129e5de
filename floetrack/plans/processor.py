"""The fold over images: state in, one image, state out."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floetrack import schema
from floetrack.functions import geo
from floetrack.operators import grid, history, interpolate, matching, raster, templates
from floetrack.plans.logs import timed
from floetrack.sources import catalog
from floetrack.sources.shared import shared_root
from floetrack.sources.snapshots import Snapshots

log = logging.getLogger("floetrack")


@dataclass
class Config:
    """Parameters of a run."""

    window_size: int = 64
    border_size: int = 256
    stride: int = 10
    min_correlation: float = 0.35
    half: int = 16
    temporal_window: int = 4
    interpolate: bool = True
    spatial_prefilter: bool = False
    grid_mode: str = "xy"
    use_model: bool = True
    persist_interval: int = 100
    band: str = "s0_HV"
    polarisations: tuple[str, ...] = ("s0_HH", "s0_HV")
    model: raster.Model = field(default_factory=raster.CornerModel)


@dataclass
class Image:
    """An image's metadata; the pixels stay in the raster table until bands are asked for."""

    image_id: int
    filename: str
    time: datetime
    angle: float
    height: int
    width: int
    affine: list[float]
    footprint: list[tuple[float, float]]

    def ring(self):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in self.footprint])


class Processor:
    """Keeps the point history and the templates, and takes images in ascending order.

    After each image the state is written below ``work`` (shared by all executors), which cuts its
    lineage: the plan of image k does not hold those of the images before it.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, *, work: str | None = None, snapshots: Snapshots | None = None, insitu: DataFrame | None = None, persist: bool = False):
        if persist and snapshots is None:
            raise ValueError("persistence needs a snapshot store")
        self.spark, self.config = spark, config or Config()
        self.work = (work or shared_root(spark)).rstrip("/")
        self.snapshots, self.insitu, self.persist = snapshots, insitu, persist
        held = snapshots.load() if persist else None
        self.points, self.templates = held or (schema.empty(spark, schema.POINTS), schema.empty(spark, schema.TEMPLATES))
        self.last_image_id = int(history.last_image_id(self.points).first()[0])
        self.last_persisted = self.last_image_id

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.work}/floetrack-state/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    @timed
    def process_image(self, image: Image, rasters: DataFrame) -> bool:
        """Takes one image; False, and no change, if its id is not beyond the last."""
        if image.image_id <= self.last_image_id:
            log.info("image %s is already processed", image.image_id)
            return False
        c = self.config
        bands = raster.bands(rasters, image.image_id, c.polarisations)
        now = F.lit(image.time).cast("timestamp")
        old = history.candidates(self.points, now, image.ring() if c.spatial_prefilter else None, c.temporal_window)
        old = self._kept(old, "candidates")
        matched = schema.empty(self.spark, schema.POINTS) if old.isEmpty() else self.match_existing(old, image, bands)
        matched = self._kept(schema.conform(matched, schema.POINTS), "matched")
        fresh = self._kept(schema.conform(self.new_points(matched, image, bands), schema.POINTS), "fresh")
        points = history.append(history.update(self.points, matched), fresh.withColumn("_order", F.col("y")), "_order", "x")
        self.points = self._kept(schema.conform(points, schema.POINTS), "points")
        placed = self.pixel(history.last(self.points).where(F.col("image_id") == image.image_id), image)
        cuts = raster.extract_templates(placed.select("trajectory_id", "image_id", "col", "row"), bands[c.band], c.half)
        self.templates = self._kept(templates.merge(self.templates, cuts.select("trajectory_id", "image_id", "pixels")), "templates")
        self.last_image_id = image.image_id
        if self.persist and image.image_id - self.last_persisted >= c.persist_interval:
            self.flush()
        return True

    def pixel(self, points: DataFrame, image: Image) -> DataFrame:
        """Points with their col and row in an image."""
        col, row = geo.affine_inverse(F.col("x"), F.col("y"), image.affine)
        return points.withColumn("col", col).withColumn("row", row)

    def match_existing(self, old: DataFrame, image: Image, bands: dict) -> DataFrame:
        """The old points found in an image: matched on the grid, others moved along, both corrected by their templates."""
        c = self.config
        places = grid.grid_points(self.spark, image.height, image.width, c.stride, c.border_size, c.grid_mode)
        described = raster.describe(places.withColumn("id", F.col("row") * image.width + F.col("col")), bands, c.model, image.angle, c.polarisations)
        x, y = geo.affine(F.col("col"), F.col("row"), image.affine)
        on_grid = self._kept(described.select("id", "descriptors", x.cast("double").alias("x"), y.cast("double").alias("y")), "grid")
        left = old.select(F.col("trajectory_id").alias("id"), "descriptors", "x", "y")
        found = self._kept(matching.match(left, on_grid, use_model=c.use_model, keep=self._kept), "matches").withColumnRenamed("q", "trajectory_id")
        if c.interpolate:
            placed = interpolate.interpolate(old, found, footprint=image.ring(), affine=image.affine, height=image.height, width=image.width)
        else:
            placed = found.select("trajectory_id", F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(False).alias("interpolated"))
        placed = placed.join(old.select("trajectory_id", "angle"), "trajectory_id")
        ready = templates.lookup(self.pixel(placed, image), self.templates)
        corrected = raster.match_templates(ready, bands[c.band], image.angle, c.half).where(F.col("corr") >= c.min_correlation)
        nx, ny = geo.affine(F.col("new_col"), F.col("new_row"), image.affine)
        rows = corrected.select("trajectory_id", "interpolated", "corr", F.col("new_col").alias("col"), F.col("new_row").alias("row"), nx.alias("x"), ny.alias("y"))
        # Descriptors are taken anew at the corrected pixel.
        rows = raster.describe(rows, bands, c.model, image.angle, c.polarisations)
        return rows.withColumns({"image_id": F.lit(image.image_id).cast("long"), "is_last": F.lit(True), "angle": F.lit(float(image.angle)), "time": F.lit(image.time).cast("timestamp")})

    def new_points(self, matched: DataFrame, image: Image, bands: dict) -> DataFrame:
        """The best feature of each window without a point, and the image's in-situ points."""
        c = self.config
        taken = self.pixel(matched, image)
        free = grid.empty_windows(grid.windows(self.spark, image.height, image.width, c.window_size), taken, c.window_size)
        found = grid.bordered(raster.detect(free, bands[c.band], c.model, c.window_size), image.height, image.width, c.border_size).select("col", "row")
        if self.insitu is not None:
            own = catalog.insitu_keypoints(catalog.insitu_of(image.filename, self.insitu), image.affine)
            found = found.union(own.select(F.col("col").cast("double"), F.col("row").cast("double")))
        rows = raster.describe(found, bands, c.model, image.angle, c.polarisations)
        x, y = geo.affine(F.col("col"), F.col("row"), image.affine)
        return history.points_from(rows.withColumn("x", x).withColumn("y", y), image.image_id, F.lit(float(image.angle)), F.lit(image.time).cast("timestamp"))

    @timed
    def flush(self) -> None:
        """Saves the state now, if the run persists and anything is new."""
        if self.persist and self.last_image_id > self.last_persisted:
            self.snapshots.save(self.points, self.templates, self.insitu)
            self.last_persisted = self.last_image_id

    def run(self, images: list[Image], rasters: DataFrame) -> DataFrame:
        """All images in ascending order; the state is saved at the end whatever happens."""
        try:
            for image in sorted(images, key=lambda i: i.image_id):
                self.process_image(image, rasters)
        finally:
            self.flush()
        return self.points
