"""Geometry and projection as column expressions, inside code generation throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 ellipsoid; north polar stereographic, true scale at 70 N, longitude 45 W down.
AXIS, FLATTENING, TRUE_LATITUDE, CENTRAL_LONGITUDE = 6378137.0, 1 / 298.257223563, 70.0, -45.0
ECCENTRICITY = math.sqrt(2 * FLATTENING - FLATTENING**2)


def _isometric(phi: float) -> float:
    e, s = ECCENTRICITY, math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2)


_T = _isometric(math.radians(TRUE_LATITUDE))
_M = math.cos(math.radians(TRUE_LATITUDE)) / math.sqrt(1 - (ECCENTRICITY * math.sin(math.radians(TRUE_LATITUDE))) ** 2)


def polar_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Map metres from degrees."""
    phi, lam = F.radians(lat), F.radians(lon - F.lit(CENTRAL_LONGITUDE))
    es = F.sin(phi) * ECCENTRICITY
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((F.lit(1.0) - es) / (es + 1.0), F.lit(ECCENTRICITY / 2))
    rho = t * (AXIS * _M / _T)
    return rho * F.sin(lam), -rho * F.cos(lam)


def polar_inverse(x: Column, y: Column, meridian: Column | None = None) -> tuple[Column, Column]:
    """Degrees from map metres, by five rounds of the fixed point for the latitude.

    A place has two names, (lon, lat) and, counted on past the pole, (lon + 180, 180 - lat). ``meridian``, a longitude
    known of it, chooses the one nearer to it, and is the longitude of the pole and of places that are null or NaN.
    Without it latitudes end at 90.
    """
    t = F.hypot(x, y) * (_T / (AXIS * _M))
    phi = F.lit(math.pi / 2) - F.atan(t) * 2
    for _ in range(5):
        es = F.sin(phi) * ECCENTRICITY
        phi = F.lit(math.pi / 2) - F.atan(t * F.pow((F.lit(1.0) - es) / (es + 1.0), F.lit(ECCENTRICITY / 2))) * 2
    lon, lat = F.degrees(F.atan2(x, -y)) + CENTRAL_LONGITUDE, F.degrees(phi)
    if meridian is not None:
        beyond = F.cos(F.radians(lon - meridian)) < 0
        lon, lat = F.when((t > 0) & ~F.isnan(t), F.when(beyond, lon + 180).otherwise(lon)).otherwise(meridian), F.when(beyond & (t > 0), F.lit(180.0) - lat).otherwise(lat)
    return F.when(lon < -180, lon + 360).otherwise(lon), lat


def rotation_angle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Degrees of the edge from the first to the second corner, from the y axis."""
    return F.degrees(F.atan2(x1 - x0, y1 - y0))


def ring(*corners: tuple[Column, Column]) -> Column:
    """A footprint from its corners."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def bounds(footprint: Column) -> dict[str, Column]:
    """minx, miny, maxx and maxy of a footprint."""
    xs, ys = F.transform(footprint, lambda p: p["x"]), F.transform(footprint, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def within(x: Column, y: Column, footprint: Column) -> Column:
    """Whether a point lies strictly within a ring; points on its edges do not. The bounding box is tested first."""
    box = bounds(footprint)
    edges = F.zip_with(
        footprint, F.concat(F.slice(footprint, 2, F.size(footprint) - 1), F.slice(footprint, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    )

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        return spans & (x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"])

    def touches(e: Column) -> Column:
        p, q = e["p"], e["q"]
        flat = (q["x"] - p["x"]) * (y - p["y"]) == (x - p["x"]) * (q["y"] - p["y"])
        return flat & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    inside = F.size(F.filter(edges, crosses)) % 2 == 1
    return (
        (x > box["minx"]) & (x < box["maxx"]) & (y > box["miny"]) & (y < box["maxy"]) & inside & (F.size(F.filter(edges, touches)) == 0)
    )


def affine(col: Column, row: Column, m: Column | list[float]) -> tuple[Column, Column]:
    """(x, y) = (m0 col + m1 row + m2, m3 col + m4 row + m5)."""
    at = lambda i: m[i] if isinstance(m, Column) else F.lit(float(m[i]))
    return at(0) * col + at(1) * row + at(2), at(3) * col + at(4) * row + at(5)


def affine_inverse(x: Column, y: Column, m: Column | list[float]) -> tuple[Column, Column]:
    """The place that ``affine`` takes to (x, y)."""
    at = lambda i: m[i] if isinstance(m, Column) else F.lit(float(m[i]))
    det = at(0) * at(4) - at(1) * at(3)
    u, v = x - at(2), y - at(5)
    return (at(4) * u - at(1) * v) / det, (at(0) * v - at(3) * u) / det


def displacement(x0: Column, y0: Column, x1: Column, y1: Column) -> dict[str, Column]:
    """u, v and their length."""
    u, v = x1 - x0, y1 - y0
    return {"u": u, "v": v, "speed": F.hypot(u, v)}


def truncated(c: Column) -> Column:
    """Toward zero."""
    return c.cast("int")


def nearest(c: Column) -> Column:
    """To the nearest integer, halves to even."""
    return F.bround(c, 0).cast("int")
