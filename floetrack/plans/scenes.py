"""Synthetic scenes: a textured surface that drifts, cut into images of two bands. For tests and demonstrations."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from floetrack import schema
from floetrack.operators import raster
from floetrack.plans.processor import Image

EXTENT = 200_000.0


def surface(size: int, seed: int = 3) -> np.ndarray:
    """Smoothed noise stretched to 8 bits."""
    img = raster.gaussian(np.random.default_rng(seed).normal(0, 1, (size, size)), 2.0)
    return np.clip(128 + 60 * img / img.std(), 0, 255).astype(np.uint8)


def scenes(spark: SparkSession, n: int = 3, size: int = 256, step: tuple[int, int] = (3, 2), seed: int = 3) -> tuple[list[Image], DataFrame]:
    """(images, rasters): the surface moved by ``step`` (columns, rows) from image to image, six hours apart."""
    whole, images, rows = surface(size + n * 8 + 16, seed), [], []
    scale = 2 * EXTENT / size
    affine = [scale, 0.0, -EXTENT, 0.0, -scale, EXTENT]
    ring = [(-EXTENT, EXTENT), (EXTENT, EXTENT), (EXTENT, -EXTENT), (-EXTENT, -EXTENT)]
    for k in range(n):
        c, r = n * 4 + 8 - step[0] * k, n * 4 + 8 - step[1] * k
        hv = whole[r : r + size, c : c + size]
        hh = (255 - hv // 2).astype(np.uint8)
        images.append(Image(k + 1, f"scene_{k + 1}.tiff", datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=6 * k), 0.0, size, size, affine, ring))
        rows += [(k + 1, name, size, size, bytearray(b.tobytes())) for name, b in (("s0_HV", hv), ("s0_HH", hh))]
    return images, spark.createDataFrame(rows, schema.RASTER)
