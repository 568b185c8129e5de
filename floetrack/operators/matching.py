"""Descriptor matching: nearest neighbours, ratio test, filter cascade and motion models.

Distances of all pairs of two point sets are computed blockwise in numpy: both sides are dealt into blocks of
bounded size, each pair of blocks is a task's, and only each block's best survive, to be reduced by aggregates
with map-side combination. Nothing is collected or broadcast, and no pair is shuffled that cannot win.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DISTANCE, MAX_SHIFT, RATIO, NEIGHBOURS, WEAK = 130, 100_000.0, 0.9, 4, 0.1
RESIDUAL, LEAST = 13_000.0, 4
#: Descriptors of the right side in one block; of the left side in a block for its own core; distances held at a time.
BLOCK_ROWS, LEAST_ROWS, CELLS = 65_536, 256, 1 << 22


def packed(descriptors: list[bytes]) -> np.ndarray:
    """Descriptors of one length as rows of 32-bit words."""
    if not descriptors:
        return np.zeros((0, 1), np.uint32)
    size = len(descriptors[0])
    raw = np.frombuffer(b"".join(d + b"\0" * (-size % 4) for d in descriptors), np.uint32)
    return raw.reshape(len(descriptors), -1)


def hamming2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix of the numbers of differing 2-bit cells between packed rows."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1] if len(a) and len(b) else 0):
        x = a[:, k, None] ^ b[None, :, k]
        out += np.bitwise_count((x | (x >> np.uint32(1))) & np.uint32(0x55555555))
    return out


def _dealt(side: DataFrame, blocks: int) -> DataFrame:
    return side.where("descriptors IS NOT NULL").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"), "id", "descriptors")


def _grid(left: DataFrame, right: DataFrame, rows: int) -> tuple[int, int]:
    """Blocks of the left and of the right side: of ``rows`` rows on the right, a sixteenth on the left, less where cores would idle."""
    n, m = left.count(), right.count()
    across = max(1, -(-m // rows))
    busy = min(-(-left.sparkSession.sparkContext.defaultParallelism // across), -(-n // LEAST_ROWS))
    return max(1, -(-n // max(1, rows // 16)), busy), across


def _per_block(left: DataFrame, right: DataFrame, k: int, both: bool, rows: int) -> DataFrame:
    """(side, id, other, dist): of each left row its k nearest in each right block; with ``both``, of each right row its nearest in each left block.

    Blocks meet by a key, one pair of blocks a task; a task keeps running minima and sends each once. So the rows
    that move are those of each side, once for each block of the other.
    """
    down, across = _grid(left, right, rows)

    def facing(side: DataFrame, own: int, other: int, pair) -> DataFrame:
        spread = _dealt(side, own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        return spread.select(pair.alias("pair"), "id", "descriptors").repartition(down * across, "pair")

    a = facing(left, down, across, F.col("own") * across + F.col("other"))
    b = facing(right, across, down, F.col("other") * across + F.col("own"))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        (ids, words), (others, held) = _ordered(one), _ordered(two)
        out = [[], [], [], []]
        if len(ids) and len(others):
            least, nearest = np.full(len(others), np.iinfo(np.int32).max, np.int32), np.zeros(len(others), np.int64)
            step = max(1, CELLS // len(others))
            for at in range(0, len(ids), step):
                own, dist = ids[at : at + step], hamming2(words[at : at + step], held)
                near = _nearest(dist, k)
                _add(out, "l", np.repeat(own, near.shape[1]), others[near].ravel(), np.take_along_axis(dist, near, 1).ravel())
                if both:  # ids ascend, so the lesser one keeps a tie
                    best = dist.argmin(axis=0)
                    value = dist[best, np.arange(len(others))]
                    closer = value < least
                    least[closer], nearest[closer] = value[closer], own[best[closer]]
            if both:
                _add(out, "r", others, nearest, least)
        side, own, other, dist = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
        return pa.table([pa.array(side.astype(str), pa.string()), pa.array(own, pa.int64()), pa.array(other, pa.int64()), pa.array(dist.astype(np.int32), pa.int32())], names=["side", "id", "other", "dist"])

    return a.groupBy("pair").cogroup(b.groupBy("pair")).applyInArrow(run, "side string, id long, other long, dist int")


def _ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids, ascending, and their packed descriptors."""
    ids = rows.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], packed(rows.column("descriptors").take(pa.array(order)).to_pylist())


def _nearest(dist: np.ndarray, k: int) -> np.ndarray:
    """Of each row the columns of its k least values, ascending; the lesser column on ties."""
    if k == 1:
        return dist.argmin(axis=1)[:, None]
    size = dist.shape[1]
    keys = dist.astype(np.int64) * size + np.arange(size)
    if k < size:
        keys = np.partition(keys, k - 1, axis=1)[:, :k]
    return np.sort(keys, axis=1) % size


def _add(out: list[list], side: str, *columns: np.ndarray) -> None:
    out[0].append(np.repeat(side, len(columns[0])))
    for held, column in zip(out[1:], columns, strict=True):
        held.append(column)


def crosscheck(left: DataFrame, right: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, t, dist): pairs that are each other's nearest; both sides (id, descriptors). Ties go to the lesser id."""
    best = _per_block(left, right, 1, True, rows).groupBy("side", "id").agg(F.min(F.struct("dist", "other")).alias("m")).select("side", "id", "m.*")
    a = best.where("side = 'l'").select(F.col("id").alias("q"), F.col("other").alias("t"), "dist")
    b = best.where("side = 'r'").select(F.col("other").alias("q"), F.col("id").alias("t"))
    return a.join(b, ["q", "t"])


def nearest(left: DataFrame, right: DataFrame, k: int = NEIGHBOURS, rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, t, dist, rank): the k nearest of each left row, exactly; ranks from 1."""
    found = _per_block(left, right, k, False, rows).select(F.col("id").alias("q"), F.col("other").alias("t"), "dist")
    w = Window.partitionBy("q").orderBy("dist", "t")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ratio_test(neighbours: DataFrame, max_distance: int = MAX_DISTANCE, ratio: float = RATIO, near: Column | None = None) -> DataFrame:
    """(q, t, dist): of each query the first neighbour below the limit, near enough, and below ``ratio`` times the next one's distance."""
    w = Window.partitionBy("q").orderBy("rank")
    ok = neighbours.withColumn("_next", F.lead("dist").over(w)).where((F.col("dist") < max_distance) & (F.col("dist") < F.lit(ratio) * F.col("_next")))
    if near is not None:
        ok = ok.where(near)
    first = ok.groupBy("q").agg(F.min(F.struct("rank", "t", "dist")).alias("m"))
    return first.select("q", "m.t", "m.dist")


def united(mutual: DataFrame, ratio: DataFrame) -> DataFrame:
    """Mutual matches, and ratio matches of other queries."""
    return mutual.select("q", "t", "dist").unionByName(ratio.join(mutual, "q", "left_anti").select("q", "t", "dist"))


def close_enough(matches: DataFrame, max_distance: int = MAX_DISTANCE, max_shift: float = MAX_SHIFT) -> DataFrame:
    """Matches (with x0, y0, x1, y1) below the limits of descriptor distance and of shift."""
    return matches.where(F.col("dist") < max_distance).where(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < max_shift)


def affine_fit(pairs: DataFrame, *by: str) -> DataFrame:
    """(n, a11, a12, b1, a21, a22, b2): least squares of (x1, y1) on (x0, y0), by groups; null where points are collinear.

    Centred co-moments only: one aggregate with map-side combination, well conditioned for large coordinates.
    """
    pair = lambda u, v: F.covar_pop(F.col(u), F.col(v))
    sums = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"_m{c}") for c in ("x0", "y0", "x1", "y1")],
        *[pair(u, v).alias(f"_{u}{v}") for u, v in (("x0", "x0"), ("x0", "y0"), ("y0", "y0"), ("x0", "x1"), ("y0", "x1"), ("x0", "y1"), ("y0", "y1"))],
    )
    det = F.col("_x0x0") * F.col("_y0y0") - F.col("_x0y0") * F.col("_x0y0")
    det = F.when(F.abs(det) > 1e-12 * F.col("_x0x0") * F.col("_y0y0"), det)
    out = sums
    for i, t in ((1, "x1"), (2, "y1")):
        out = out.withColumn(f"a{i}1", (F.col(f"_x0{t}") * F.col("_y0y0") - F.col(f"_y0{t}") * F.col("_x0y0")) / det)
        out = out.withColumn(f"a{i}2", (F.col(f"_y0{t}") * F.col("_x0x0") - F.col(f"_x0{t}") * F.col("_x0y0")) / det)
        out = out.withColumn(f"b{i}", F.col(f"_m{t}") - F.col(f"a{i}1") * F.col("_mx0") - F.col(f"a{i}2") * F.col("_my0"))
    return out.select(*by, "n", "a11", "a12", "b1", "a21", "a22", "b2")


def moved(x: Column, y: Column) -> tuple[Column, Column]:
    """The place an affine model's columns give."""
    return F.col("a11") * x + F.col("a12") * y + F.col("b1"), F.col("a21") * x + F.col("a22") * y + F.col("b2")


def residuals(pairs: DataFrame, model: DataFrame, *by: str) -> DataFrame:
    """``pairs`` with the distance of (x1, y1) from the model's place; one model, or one for each group."""
    joined = pairs.join(F.broadcast(model.drop("n")), list(by)) if by else pairs.join(F.broadcast(model.drop("n")))
    px, py = moved(F.col("x0"), F.col("y0"))
    return joined.withColumn("residual", F.hypot(F.col("x1") - px, F.col("y1") - py)).select(*pairs.columns, "residual")


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix that takes ``src`` to ``dst`` in the least-squares sense, with normalised coordinates."""

    def scaled(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, size = p.mean(axis=0), np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1).mean() / 2) or 1.0
        t = np.array([[1 / size, 0, -mean[0] / size], [0, 1 / size, -mean[1] / size], [0, 0, 1]])
        return (p - mean) / size, t

    a, ta = scaled(src)
    b, tb = scaled(dst)
    one, zero = np.ones(len(a)), np.zeros(len(a))
    rows = np.empty((2 * len(a), 9))
    rows[0::2] = np.stack([a[:, 0], a[:, 1], one, zero, zero, zero, -b[:, 0] * a[:, 0], -b[:, 0] * a[:, 1], -b[:, 0]], axis=1)
    rows[1::2] = np.stack([zero, zero, zero, a[:, 0], a[:, 1], one, -b[:, 1] * a[:, 0], -b[:, 1] * a[:, 1], -b[:, 1]], axis=1)
    h = np.linalg.inv(tb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def project(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Places of points under a homography."""
    q = np.column_stack([p, np.ones(len(p))]) @ h.T
    return q[:, :2] / np.where(np.abs(q[:, 2:]) < 1e-12, 1e-12, q[:, 2:])


def robust_homography(src: np.ndarray, dst: np.ndarray, threshold: float = RESIDUAL, seed: int = 1, tries: int = 500) -> tuple[np.ndarray | None, np.ndarray]:
    """(matrix, inliers) by random samples of four with a truncated squared cost, refined on the inliers; seeded."""
    none = np.zeros(len(src), bool)
    if len(src) < LEAST:
        return None, none
    rng, best, cost = np.random.default_rng(seed), None, np.inf
    for _ in range(tries):
        pick = rng.choice(len(src), 4, replace=False)
        h = homography(src[pick], dst[pick])
        if h is None or not np.isfinite(h).all():
            continue
        r = np.hypot(*(project(h, src) - dst).T)
        c = np.minimum(r * r, threshold**2).sum()
        if c < cost:
            best, cost = h, c
    if best is None:
        return None, none
    for _ in range(3):
        inside = np.hypot(*(project(best, src) - dst).T) < threshold
        if inside.sum() < LEAST:
            break
        finer = homography(src[inside], dst[inside])
        if finer is None:
            break
        best = finer
    return best, np.hypot(*(project(best, src) - dst).T) < threshold


def robust_fit(pairs: DataFrame, by: str, *, threshold: float = RESIDUAL, seed: int = 1) -> DataFrame:
    """``pairs`` (with x0, y0, x1, y1) with inlier and residual from a robust homography for each group; null residual without a model."""
    schema = pairs.schema.simpleString()[7:-1] + ",inlier:boolean,residual:double"

    def run(group):
        src, dst = group[["x0", "y0"]].to_numpy(), group[["x1", "y1"]].to_numpy()
        h, inside = robust_homography(src, dst, threshold, seed)
        return group.assign(inlier=inside, residual=np.hypot(*(project(h, src) - dst).T) if h is not None else None)

    return pairs.groupBy(by).applyInPandas(run, schema)


def cascade(matches: DataFrame, by: str | None = None, *, use_model: bool = True, threshold: float = RESIDUAL, max_distance: int = MAX_DISTANCE, max_shift: float = MAX_SHIFT) -> DataFrame:
    """Matches within the limits and, unless ``use_model`` is off, inliers of a robust model, with their residuals."""
    near = close_enough(matches, max_distance, max_shift)
    if not use_model:
        return near
    keyed = near.withColumn("_all", F.lit(0)) if by is None else near
    return robust_fit(keyed, by or "_all", threshold=threshold).where("inlier").drop("inlier", "_all")


def match(left: DataFrame, right: DataFrame, *, use_model: bool = True, fallback: bool = True, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """(q, t, dist, x0, y0, x1, y1[, residual]): points (id, descriptors, x, y) of ``left`` found in ``right``.

    Mutual matches through the cascade; if fewer than a tenth of the left points remain, ratio matches
    are added before the cascade. ``keep`` writes what is used twice, so that it is found once.
    """

    def placed(m: DataFrame) -> DataFrame:
        a = left.select(F.col("id").alias("q"), F.col("x").alias("x0"), F.col("y").alias("y0"))
        b = right.select(F.col("id").alias("t"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        return m.join(a, "q").join(b, "t")

    mutual = keep(crosscheck(left, right), "mutual")
    found = cascade(placed(mutual), use_model=use_model)
    if not fallback:
        return found
    found = keep(found, "found")
    if found.count() >= WEAK * left.count():
        return found
    # The shift limit is part of the ratio test, so places are joined before it.
    near = placed(nearest(left, right))
    lowe = ratio_test(near, near=F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < MAX_SHIFT)
    return cascade(placed(united(mutual, lowe)), use_model=use_model)
