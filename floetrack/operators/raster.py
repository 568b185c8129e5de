"""Pixel kernels in numpy and the Arrow operators that run them.

An image travels once to each task, as a broadcast of its few bands; points stream past it in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF, REACH, OFFSETS, GOOD = 16, 16, (0.0, -15.0, 15.0, -30.0, 30.0), 0.65
PATCH, BYTES, SMOOTH = 31, 32, 5


# ---- preprocessing -------------------------------------------------------------------------------
def mean_filter2(img: np.ndarray) -> np.ndarray:
    """The mean of each pixel and its neighbours below and to the right, edges repeated."""
    p = np.pad(img.astype(np.float64), ((0, 1), (0, 1)), mode="symmetric")
    return (p[1:, 1:] + p[:-1, 1:] + p[1:, :-1] + p[:-1, :-1]) / 4


def calibrate(dn: np.ndarray, lut: np.ndarray | float, factor: float) -> np.ndarray:
    """Digital numbers to 8-bit grey: divided by the mean calibration, scaled, clipped, at half the size."""
    scaled = mean_filter2(dn) / float(np.mean(lut)) * 255.0 * factor
    return np.clip(np.nan_to_num(scaled), 0, 255)[::2, ::2].astype(np.uint8)


def gaussian(img: np.ndarray, sigma: float = 0.5) -> np.ndarray:
    """Separable Gaussian smoothing to four deviations, edges mirrored."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = img.astype(np.float64)
    for axis in (0, 1):
        p = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        out = sum(w * np.take(p, range(i, i + out.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def clahe(img: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalisation of an 8-bit image: clipped histograms of tiles, blended bilinearly."""
    h, w = img.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    p = np.pad(img, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect" if h > 1 and w > 1 else "edge")
    boxes = p.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    hist = np.zeros((tiles * tiles, 256))
    for i, b in enumerate(boxes):
        hist[i] = np.bincount(b, minlength=256)
    limit = max(1.0, clip * boxes.shape[1] / 256)
    over = np.maximum(hist - limit, 0).sum(axis=1, keepdims=True)
    hist = np.minimum(hist, limit) + over / 256
    maps = np.clip(np.cumsum(hist, axis=1) * 255.0 / boxes.shape[1], 0, 255).reshape(tiles, tiles, 256)
    fy, fx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    wy, wx = (fy - y0)[:, None], (fx - x0)[None, :]
    ya, yb = (np.clip(v, 0, tiles - 1)[:, None] for v in (y0, y0 + 1))
    xa, xb = (np.clip(v, 0, tiles - 1)[None, :] for v in (x0, x0 + 1))
    top = maps[ya, xa, img] * (1 - wx) + maps[ya, xb, img] * wx
    low = maps[yb, xa, img] * (1 - wx) + maps[yb, xb, img] * wx
    return np.rint(top * (1 - wy) + low * wy).astype(np.uint8)


def calibrate_clahe(dn: np.ndarray, lut: np.ndarray | float, factor: float, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """As ``calibrate``, equalised and smoothed; clipped before the cast to 8 bits."""
    return np.clip(gaussian(clahe(calibrate(dn, lut, factor), clip, tiles), 0.5), 0, 255).astype(np.uint8)


# ---- detection and description ---------------------------------------------------------------------
class Model(Protocol):
    """What finds and describes features: detect gives (col, row, response), compute gives descriptors."""

    def detect(self, img: np.ndarray) -> np.ndarray: ...

    def compute(self, img: np.ndarray, places: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]: ...


class CornerModel:
    """Corners by the structure tensor; binary descriptors by intensity tests on a patch turned with the image."""

    def __init__(self, n_features: int = 100, edge: int = 15, seed: int = 0):
        self.n_features, self.edge = n_features, edge
        self._last: tuple[np.ndarray, np.ndarray] | None = None
        rng = np.random.default_rng(seed)
        self.tests = np.clip(rng.normal(0, PATCH / 5, (BYTES * 8, 4)), -(PATCH // 2), PATCH // 2)

    def detect(self, img: np.ndarray) -> np.ndarray:
        if min(img.shape) <= 2 * self.edge:
            return np.zeros((0, 3))
        g = gaussian(img, 1.0)
        gy, gx = np.gradient(g)
        a, b, c = (gaussian(v, 1.5) for v in (gx * gx, gx * gy, gy * gy))
        r = a * c - b * b - 0.04 * (a + c) ** 2
        peak = np.pad(r, 1, constant_values=-np.inf)
        local = r >= sliding_window_view(peak, (3, 3)).max(axis=(2, 3))
        local[: self.edge] = local[-self.edge :] = False
        local[:, : self.edge] = local[:, -self.edge :] = False
        rows, cols = np.nonzero(local & (r > 0))
        order = np.lexsort((cols, rows, -r[rows, cols]))[: self.n_features]
        return np.column_stack([cols[order], rows[order], r[rows[order], cols[order]]])

    def _smoothed(self, img: np.ndarray) -> np.ndarray:
        """The image smoothed, once for all batches that ask for the same one."""
        if self._last is None or self._last[0] is not img:
            self._last = (img, gaussian(img, SMOOTH / 2.5))
        return self._last[1]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_last": None}  # tasks smooth for themselves

    def compute(self, img: np.ndarray, places: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
        h, w = img.shape
        margin = int(PATCH * 0.75) + 1
        col, row = places[:, 0], places[:, 1]
        ok = (col >= margin) & (col < w - margin) & (row >= margin) & (row < h - margin)
        smooth = self._smoothed(img)
        t = np.radians(angle)
        turn = np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        p, q = self.tests[:, :2] @ turn.T, self.tests[:, 2:] @ turn.T
        at = lambda o: smooth[np.rint(row[ok, None] + o[:, 1]).astype(int), np.rint(col[ok, None] + o[:, 0]).astype(int)]
        return ok, np.packbits(at(p) < at(q), axis=1)


# ---- templates -------------------------------------------------------------------------------------
def cut(img: np.ndarray, col: int, row: int, half: int) -> np.ndarray | None:
    """The square around a place, None where it leaves the image."""
    if row - half < 0 or col - half < 0 or row + half + 1 > img.shape[0] or col + half + 1 > img.shape[1]:
        return None
    return img[row - half : row + half + 1, col - half : col + half + 1]


def rotated(t: np.ndarray, degrees: float) -> np.ndarray:
    """A square turned counter-clockwise about its centre, bilinear, 0 outside."""
    n, c = t.shape[0], (t.shape[0] - 1) / 2
    a = np.radians(degrees)
    y, x = np.mgrid[0:n, 0:n] - c
    sx, sy = np.cos(a) * x - np.sin(a) * y + c, np.sin(a) * x + np.cos(a) * y + c
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    p = np.pad(t.astype(np.float64), 1)
    out = np.zeros((n, n))
    for dy in (0, 1):
        for dx in (0, 1):
            xi, yi = np.clip(x0 + dx + 1, 0, n + 1), np.clip(y0 + dy + 1, 0, n + 1)
            ok = (x0 + dx >= -1) & (x0 + dx <= n) & (y0 + dy >= -1) & (y0 + dy <= n)
            out += np.where(ok, p[yi, xi], 0.0) * np.abs(1 - dx - (sx - x0)) * np.abs(1 - dy - (sy - y0))
    return out


def correlate(search: np.ndarray, template: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """The (weighted) correlation of a template with every window of its size; 0 where either has no variance."""
    m = np.ones(template.shape) if mask is None else mask.astype(np.float64)
    total = m.sum()
    views = sliding_window_view(search.astype(np.float64), template.shape)
    if total == 0:
        return np.zeros(views.shape[:2])
    t = (template - (template * m).sum() / total) * m
    mean = np.tensordot(views, m, axes=2) / total
    cross = np.tensordot(views, t, axes=2)
    var = np.tensordot(views**2, m, axes=2) - total * mean**2
    norm = np.sqrt(np.maximum(var, 0) * (t * (template - (template * m).sum() / total)).sum())
    return np.where(norm > 1e-9, cross / np.where(norm > 1e-9, norm, 1), 0.0)


def search(img: np.ndarray, template: np.ndarray, col: float, row: float, turn: float, half: int = HALF, reach: int = REACH) -> tuple[float, float, float, float]:
    """(col, row, correlation, offset) of a template near a place: offsets in turn until one is good enough; (col, row, 0, 0) if it cannot be.

    At offset 0 the template stays as it is; at others it is turned by ``turn`` and the offset, and only
    its set pixels count. The best so far wins, the earliest on ties.
    """
    size = 2 * half + 1
    area = cut(img, int(col), int(row), half + reach)
    if area is None or template.shape != (size, size):
        return col, row, 0.0, 0.0
    best, shift, turned = -1.0, (0, 0), 0.0
    for offset in OFFSETS:
        if best >= GOOD:
            break
        if offset == 0:
            r = correlate(area, template)
        else:
            t = rotated(template, turn + offset)
            r = correlate(area, t, t > 0)
        at = np.unravel_index(np.argmax(r), r.shape)
        if r[at] > best:
            best, shift, turned = float(r[at]), (int(at[1]) - reach, int(at[0]) - reach), offset
    return col + shift[0], row + shift[1], best, turned


# ---- operators -------------------------------------------------------------------------------------
def bands(raster: DataFrame, image_id: int, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """The pixels of an image's bands. One image is a bounded size; the filter prunes all others."""
    rows = raster.where(F.col("image_id") == image_id).where(F.col("band").isin(*names)).select("band", "height", "width", "data").toArrow().to_pylist()
    return {r["band"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]) for r in rows}


def _mapped(points: DataFrame, extra: str, fn) -> DataFrame:
    """Points through a function from (table as columns) to new columns and a mask of the rows that stay."""
    schema = points.schema.simpleString()[7:-1] + "," + extra
    names = [x.split(":")[0] for x in extra.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, made = fn(batch)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(c.filter(keep) for c in batch.columns), *made], names=[*batch.schema.names, *names])

    return points.mapInArrow(run, schema)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).to_numpy(zero_copy_only=False)


def describe(points: DataFrame, images: dict[str, np.ndarray], model: Model, angle: float, polarisations: tuple[str, ...]) -> DataFrame:
    """Points (col, row, ...) with descriptors, those of several bands one after the other; points that no band can describe go."""
    held = points.sparkSession.sparkContext.broadcast((images, model))

    def fn(batch):
        imgs, m = held.value
        places = np.column_stack([_column(batch, "col"), _column(batch, "row")]).astype(float)
        ok = np.ones(len(places), bool)
        parts = []
        for b in polarisations:
            fine, d = m.compute(imgs[b], places, angle)
            whole = np.zeros((len(places), d.shape[1] if d.ndim == 2 else BYTES), np.uint8)
            whole[fine] = d
            parts.append(whole)
            ok &= fine
        joined = np.concatenate(parts, axis=1)[ok]
        return ok, [pa.array([r.tobytes() for r in joined], pa.binary())]

    return _mapped(points, "descriptors:binary", fn)


def extract_templates(points: DataFrame, img: np.ndarray, half: int = HALF) -> DataFrame:
    """Points (col, row, ...) with the pixels around their truncated place; those whose square leaves the image go."""
    held = points.sparkSession.sparkContext.broadcast(img)

    def fn(batch):
        cuts = [cut(held.value, int(c), int(r), half) for c, r in zip(_column(batch, "col"), _column(batch, "row"), strict=True)]
        return [c is not None for c in cuts], [pa.array([c.tobytes() for c in cuts if c is not None], pa.binary())]

    return _mapped(points, "pixels:binary", fn)


def match_templates(points: DataFrame, img: np.ndarray, angle: float, half: int = HALF, reach: int = REACH) -> DataFrame:
    """Points (col, row, angle, pixels, ...) with new_col, new_row, corr and rotation (the offset that won, degrees)."""
    held = points.sparkSession.sparkContext.broadcast(img)

    def fn(batch):
        size = 2 * half + 1
        out = [
            search(held.value, np.frombuffer(p, np.uint8).reshape(size, size), c, r, a - angle, half, reach)
            for c, r, a, p in zip(_column(batch, "col"), _column(batch, "row"), _column(batch, "angle"), batch.column(batch.schema.names.index("pixels")).to_pylist(), strict=True)
        ]
        return [True] * len(out), [pa.array([o[k] for o in out], pa.float64()) for k in range(4)]

    return _mapped(points, "new_col:double,new_row:double,corr:double,rotation:double", fn)


def detect(windows: DataFrame, img: np.ndarray, model: Model, window: int) -> DataFrame:
    """Of each window (row0, col0, ...) the feature with the greatest response, as (col, row, response); windows without any go."""
    held = windows.sparkSession.sparkContext.broadcast((img, model))

    def fn(batch):
        image, m = held.value
        found = []
        for r, c in zip(_column(batch, "row0"), _column(batch, "col0"), strict=True):
            f = m.detect(image[r : r + window, c : c + window])
            found.append((c + f[f[:, 2].argmax(), 0], r + f[f[:, 2].argmax(), 1], f[:, 2].max()) if len(f) else None)
        return [f is not None for f in found], [pa.array([float(f[k]) for f in found if f is not None], pa.float64()) for k in range(3)]

    return _mapped(windows, "col:double,row:double,response:double", fn)


def preprocess(rasters: DataFrame, *, factors: dict[str, float], equalise: bool = True, clip: float = 1.25, tiles: int = 16) -> DataFrame:
    """8-bit rasters from digital numbers (image_id, band, height, width, data as 16-bit, calibration); one row at a time.

    ``calibration`` is a number, or a look-up table as an array, of which the mean counts. A row that fails keeps its key with null data and the error, and does not stop the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    dn = np.frombuffer(r["data"], np.uint16).reshape(r["height"], r["width"])
                    f = factors.get(r["band"], 1.0)
                    img = calibrate_clahe(dn, r["calibration"], f, clip, tiles) if equalise else calibrate(dn, r["calibration"], f)
                    rows.append({"image_id": r["image_id"], "band": r["band"], "height": img.shape[0], "width": img.shape[1], "data": img.tobytes(), "error": None})
                except Exception as e:  # noqa: BLE001 - kept as a column, as the batch goes on
                    rows.append({"image_id": r["image_id"], "band": r["band"], "height": None, "width": None, "data": None, "error": str(e)[:500]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("image_id", pa.int64()), ("band", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary()), ("error", pa.string())]))

    level = F.col("calibration")
    if isinstance(rasters.schema["calibration"].dataType, T.ArrayType):
        level = F.aggregate(level, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(level)
    picked = rasters.select("image_id", "band", "height", "width", "data", level.cast("double").alias("calibration"))
    return picked.mapInArrow(run, "image_id long, band string, height int, width int, data binary, error string")
