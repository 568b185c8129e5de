"""Batch preprocessing: scenes in a folder to 8-bit rasters, those done before passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floetrack.operators import raster
from floetrack.plans.logs import timed
from floetrack.sources import catalog

# Factors by band with and without equalisation.
FACTORS = {False: {"s0_HH": 2.0, "s0_HV": 5.0}, True: {"s0_HH": 2.2, "s0_HV": 5.5}}
NAMES = ("s0_HH", "s0_HV")


@timed
def preprocess_folder(spark: SparkSession, folder: str, out: str, *, pattern: str = "*.tiff", calibration: float | DataFrame = 255.0, equalise: bool = True, clip: float = 1.25, tiles: int = 16) -> DataFrame:
    """Appends (filename, band, height, width, data, affine, error) of the files not yet done below ``out``; returns what it holds.

    ``calibration``: a level for all, or a table (filename, band, calibration: a number or a look-up table of which
    the mean counts). The affine is that of the halved image. A file that fails keeps a row with its error, the
    others go on, and it is tried again the next time; once it succeeds, its error is no longer shown.
    Files are numbered within a run only, to carry them through the kernel.
    """
    decoded = catalog.decode(spark, folder, pattern).where("bits = 16 OR error IS NOT NULL")
    if catalog.exists(spark, out):
        decoded = catalog.unprocessed(decoded, spark.read.parquet(out).where("error IS NULL").select("filename").distinct())
    named = decoded.withColumn("band", F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("band_no") + 1)).withColumn("image_id", F.xxhash64("filename"))
    good = named.where("error IS NULL").drop("error")
    level = good.withColumn("calibration", F.lit(calibration)) if not isinstance(calibration, DataFrame) else good.join(calibration, ["filename", "band"], "left")
    done = raster.preprocess(level, factors=FACTORS[equalise], equalise=equalise, clip=clip, tiles=tiles)
    halved = F.transform("affine", lambda v, i: F.when(i % 3 == 2, v).otherwise(v * 2))
    files = good.select("image_id", "band", "filename", halved.alias("affine"))
    columns = ["filename", "band", "height", "width", "data", "affine", "error"]
    failed = named.where("error IS NOT NULL").select("filename", "band", "height", "width", "data", "affine", "error")
    done.join(files, ["image_id", "band"]).select(*columns).unionByName(failed).write.mode("append").parquet(out)
    held = spark.read.parquet(out)
    fine = held.where("error IS NULL").select("filename").distinct()
    return held.where("error IS NULL").unionByName(held.where("error IS NOT NULL").join(fine, "filename", "left_anti").dropDuplicates(["filename", "band"]).select(*held.columns))
