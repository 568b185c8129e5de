"""Thin-plate splines through control points: solved once in numpy, applied as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _kernel(r2: np.ndarray) -> np.ndarray:
    return np.where(r2 > 0, r2 * np.log(np.maximum(r2, 1e-300)), 0.0) / 2


def solve(src: np.ndarray, dst: np.ndarray) -> dict[str, np.ndarray]:
    """The spline that takes ``src`` to ``dst`` exactly; at least three control points, not all on a line.

    Coordinates are scaled to the control points' extent first, for conditioning.
    """
    src, dst = np.asarray(src, float), np.asarray(dst, float)
    centre, scale = src.mean(axis=0), float(np.abs(src - src.mean(axis=0)).max()) or 1.0
    p = (src - centre) / scale
    n = len(p)
    base = np.column_stack([np.ones(n), p])
    if n < 3 or np.linalg.matrix_rank(base) < 3:
        raise ValueError("control points do not span the plane")
    system = np.zeros((n + 3, n + 3))
    system[:n, :n] = _kernel(((p[:, None] - p[None]) ** 2).sum(axis=2))
    system[:n, n:], system[n:, :n] = base, base.T
    solved = np.linalg.solve(system, np.vstack([dst, np.zeros((3, 2))]))
    return {"points": p, "weights": solved[:n], "affine": solved[n:], "centre": centre, "scale": np.array([scale])}


def apply(spline: dict[str, np.ndarray], a: Column, b: Column) -> tuple[Column, Column]:
    """The place that a spline takes (a, b) to. The control points are a literal in the plan: tens to hundreds of them."""
    u, v = (a - float(spline["centre"][0])) / float(spline["scale"][0]), (b - float(spline["centre"][1])) / float(spline["scale"][0])
    rows = F.array(*[F.struct(*[F.lit(float(x)).alias(k) for k, x in zip("pqst", (*p, *w), strict=True)]) for p, w in zip(spline["points"], spline["weights"], strict=True)])

    def bend(r: Column) -> Column:
        r2 = (u - r["p"]) * (u - r["p"]) + (v - r["q"]) * (v - r["q"])
        return F.when(r2 > 0, r2 * F.log(r2) / 2).otherwise(0.0)

    out = []
    for k, weight in enumerate(("s", "t")):
        c = [float(x) for x in spline["affine"][:, k]]
        out.append(F.aggregate(rows, F.lit(0.0), _adder(bend, weight)) + c[0] + u * c[1] + v * c[2])
    return out[0], out[1]


def _adder(bend, weight: str):
    return lambda total, r: total + bend(r) * r[weight]


def halved(control: Column, factor: float = 0.5) -> Column:
    """Control points (col, row, x, y) of an image resized by a factor."""
    return F.transform(control, lambda g: F.struct((g["col"] * factor).alias("col"), (g["row"] * factor).alias("row"), g["x"].alias("x"), g["y"].alias("y")))
