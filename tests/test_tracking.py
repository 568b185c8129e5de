"""History, geometry, matching, grids, templates: fixed cases and boundaries."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from floetrack import schema
from floetrack.functions import geo, names, spline
from floetrack.operators import grid, history, interpolate, matching, raster, templates
from floetrack.plans import logs, preprocessing, scenes
from floetrack.plans.processor import Config, Processor
from floetrack.sources import catalog, tiff
from floetrack.sources.snapshots import Snapshots
from floetrack.streaming import fold

NOW = datetime(2024, 1, 10)


def pts(spark, rows):
    cols = "trajectory_id long, image_id long, is_last boolean, x double, y double, time timestamp"
    return spark.createDataFrame([(t, i, l, float(x), float(y), w) for t, i, l, x, y, w in rows], cols)


def test_empty_layout(spark):
    assert schema.empty(spark, schema.POINTS).columns == ["image_id", "is_last", "trajectory_id", "x", "y", "descriptors", "angle", "corr", "time", "interpolated"]


def test_last_and_polygon(spark):
    p = pts(spark, [(0, 1, True, 0, 0, NOW), (1, 1, False, 10, 10, NOW), (2, 1, True, 20, 20, NOW)])
    assert {r.trajectory_id for r in history.last(p).collect()} == {0, 2}
    ring = geo.ring(*[(F.lit(float(a)), F.lit(float(b))) for a, b in ((5, 5), (15, 5), (15, 15), (5, 15))])
    assert [r.trajectory_id for r in history.in_footprint(p, ring).collect()] == [1]
    edge = pts(spark, [(0, 1, True, 5, 10, NOW), (1, 1, True, 15, 15, NOW), (2, 1, True, 5.001, 10, NOW)])
    assert [r.trajectory_id for r in history.in_footprint(edge, ring).collect()] == [2]


def test_recency_is_strict(spark):
    p = pts(spark, [(0, 1, True, 0, 0, NOW - timedelta(days=4)), (1, 1, True, 0, 0, NOW - timedelta(days=4) + timedelta(seconds=1)), (2, 1, True, 0, 0, NOW + timedelta(days=1))])
    assert {r.trajectory_id for r in history.recent(p, F.lit(NOW)).collect()} == {1, 2}


def test_append_and_update(spark):
    old = pts(spark, [(0, 1, True, 0, 0, NOW), (5, 1, True, 1, 1, NOW)])
    new = pts(spark, [(0, 2, True, 9, 7, NOW), (0, 2, True, 8, 6, NOW)])
    got = history.append(old, new, "x", "y").orderBy("trajectory_id").collect()
    assert [(r.trajectory_id, r.x) for r in got] == [(0, 0.0), (5, 1.0), (6, 8.0), (7, 9.0)]
    assert history.append(schema.empty(spark, old.schema), new, "x").agg(F.min("trajectory_id")).first()[0] == 0
    up = history.update(old, pts(spark, [(5, 2, True, 3, 3, NOW)]))
    assert {(r.trajectory_id, r.image_id, r.is_last) for r in up.collect()} == {(0, 1, True), (5, 1, False), (5, 2, True)}
    assert history.last_image_id(schema.empty(spark, old.schema)).first()[0] == 0


def test_ranks_cover_ties_and_empty(spark):
    rows = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("k"))
    got = history.ranked(rows, "k", "id", buckets=8).collect()
    want = sorted(((r.k, r.id) for r in got))
    assert [want.index((r.k, r.id)) for r in got] == [r["rank"] for r in got]
    assert history.ranked(rows.where("id < 0"), "k", "id").count() == 0


def test_projection(spark):
    rows = spark.createDataFrame([(-45.0, 70.0), (0.0, 80.0), (120.0, 88.0)], "lon double, lat double")
    x, y = geo.polar_forward(F.col("lon"), F.col("lat"))
    got = rows.select("*", x.alias("x"), y.alias("y")).collect()
    assert (got[0].x, got[0].y) == pytest.approx((0, -2187927.649), abs=1e-3)
    assert (got[1].x, got[1].y) == pytest.approx((767861.606, -767861.606), abs=1e-3)
    lon, lat = geo.polar_inverse(F.col("x"), F.col("y"))
    for r in spark.createDataFrame(got).select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-9)


def test_names(spark):
    good = "S1A_EW_GRDM_1SDH_20200101T101112_20200101T101212_030614_03824D_9E1C.tiff"
    rows = spark.createDataFrame([("/a/" + good,), ("/a/notes.txt",), ("x_20209901T101112",)], "path string").withColumn("filename", names.basename(F.col("path")))
    got = catalog.products(rows).collect()
    assert len(got) == 1 and got[0].orbit_num == "030614" and got[0].timestamp == datetime(2020, 1, 1, 10, 11, 12)
    dates = [r[0] for r in rows.select(names.date_in(F.col("path"))).collect()]
    assert dates == [datetime(2020, 1, 1, 10, 11, 12), None, None]
    row = spark.createDataFrame([(bytearray([0, 7, 255]),), (bytearray(),), (None,)], "d binary").select("d", names.descriptor_json(F.col("d")).alias("j"))
    back = row.select("d", "j", names.descriptor_from_json(F.col("j")).alias("b")).collect()
    assert [r.j for r in back] == ["[0,7,255]", "[]", None] and [r.b for r in back] == [r.d for r in back]


def test_hamming2_counts_cells(spark):
    one, both = bytes([0b01, 0, 0, 0]), bytes([0b11, 0, 0, 0])
    zero = bytes(4)
    assert matching.hamming2(matching.packed([zero]), matching.packed([one, both])).tolist() == [[1, 1]]
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 256, (5, 64), dtype=np.uint8) for _ in range(2))
    want = [sum(any((x >> s) & 3 for x in [p ^ q]) for p, q in zip(u.tolist(), v.tolist()) for s in (0, 2, 4, 6)) for u, v in zip(a, b)]
    rows = spark.createDataFrame([(bytearray(u.tobytes()), bytearray(v.tobytes())) for u, v in zip(a, b)], "a binary, b binary")
    assert [r[0] for r in rows.select(names.hamming2(F.col("a"), F.col("b"), 64)).collect()] == want


def described(spark, values, places=None):
    places = places or [(0.0, 0.0)] * len(values)
    return spark.createDataFrame([(i, bytearray(v), *p) for i, (v, p) in enumerate(zip(values, places))], "id long, descriptors binary, x double, y double")


def test_crosscheck_blocks_and_ties(spark):
    rng = np.random.default_rng(2)
    a, b = ([rng.integers(0, 256, 8, dtype=np.uint8).tobytes() for _ in range(n)] for n in (40, 30))
    b[3] = b[9] = a[5]
    dist = matching.hamming2(matching.packed(a), matching.packed(b))
    want = {(q, int(dist[q].argmin())) for q in range(40) if dist[:, dist[q].argmin()].argmin() == q}
    for rows in (65_536, 7):
        assert {(r.q, r.t) for r in matching.crosscheck(described(spark, a), described(spark, b), rows).collect()} == want
    near = matching.nearest(described(spark, a), described(spark, b), 4, 7)
    for q, group in near.toPandas().groupby("q"):
        assert group.sort_values("rank").t.tolist() == np.argsort(dist[q], kind="stable")[:4].tolist()
    assert matching.crosscheck(described(spark, a).where("id < 0"), described(spark, b)).count() == 0
    assert matching.crosscheck(described(spark, a), described(spark, b).where("id < 0")).count() == 0


def test_limits_are_strict(spark):
    n = spark.createDataFrame([(0, 0, 9, 1), (0, 1, 10, 2), (1, 0, 8, 1), (1, 1, 10, 2), (2, 0, 130, 1), (2, 1, 200, 2)], "q long, t long, dist int, rank int")
    assert [(r.q, r.t) for r in matching.ratio_test(n).collect()] == [(1, 0)]
    m = spark.createDataFrame([(0, 129, 0.0, 0.0, 99_999.0, 0.0), (1, 130, 0.0, 0.0, 1.0, 0.0), (2, 1, 0.0, 0.0, 100_000.0, 0.0)], "q long, dist int, x0 double, y0 double, x1 double, y1 double")
    assert [r.q for r in matching.close_enough(m).collect()] == [0]


def test_models(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(-1e6, 1e6, (100, 2))
    q = p @ np.array([[1.01, 0.02], [-0.03, 0.98]]).T + [500.0, -200.0]
    rows = spark.createDataFrame([(0, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(p, q))], "g int, i int, x0 double, y0 double, x1 double, y1 double")
    f = matching.affine_fit(rows).first()
    assert (f.a11, f.a12, f.a21, f.a22) == pytest.approx((1.01, 0.02, -0.03, 0.98), abs=1e-9) and (f.b1, f.b2) == pytest.approx((500, -200), abs=1e-3)
    assert matching.residuals(rows, matching.affine_fit(rows)).agg(F.max("residual")).first()[0] < 1e-3
    wild = rows.withColumn("x1", F.when(F.col("i") % 5 == 0, F.col("x1") + 90_000).otherwise(F.col("x1")))
    got = {r.i: r.inlier for r in matching.robust_fit(wild, "g").collect()}
    assert all(got[i] == (i % 5 != 0) for i in got)
    few = matching.robust_fit(rows.where("i < 3"), "g").collect()
    assert [r.inlier for r in few] == [False] * 3
    line = rows.withColumn("y0", F.col("x0"))
    assert matching.affine_fit(line).first().a11 is None


def test_interpolation(spark):
    old = pts(spark, [(i, 1, True, 1000.0 * i, 500.0 * i * i % 7000, NOW) for i in range(12)])
    found = old.where("trajectory_id < 8").select("trajectory_id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 300).alias("x1"), (F.col("y") - 100).alias("y1"))
    got = interpolate.interpolate(old, found, footprint=None, affine=[100.0, 0, -5000.0, 0, -100.0, 10_000.0], height=200, width=200).collect()
    moved = {r.trajectory_id: (r.x, r.y) for r in got if r.interpolated}
    assert set(moved) == {8, 9, 10, 11} and moved[8][0] == pytest.approx(8300, abs=1e-6)
    assert all(not r.interpolated for r in interpolate.interpolate(old, found.where("trajectory_id < 2"), footprint=None, affine=[100.0, 0, -5000.0, 0, -100.0, 10_000.0], height=200, width=200).collect())


def test_grid_and_cells(spark):
    assert grid.grid_points(spark, 100, 60, 10, 20).count() == 7 * 3
    assert grid.windows(spark, 130, 200, 64).count() == 2 * 3 and grid.windows(spark, 30, 200, 64).count() == 0
    p = spark.createDataFrame([(0, 10, 1.0, 1), (63, 10, 2.0, 2), (64, 10, 2.0, 3), (65, 12, 2.0, 4)], "col long, row long, response double, o long")
    assert {(r.cell_col, r.o) for r in grid.best_per_cell(p, "response", "o").collect()} == {(0, 2), (1, 3)}
    assert grid.empty_windows(grid.windows(spark, 128, 192, 64), p).count() == 4
    step = grid.empty_windows(grid.windows(spark, 64, 192, 64, 32), p, 64, 32)
    assert {r.cell_col for r in step.collect()} == {3, 4}
    fit = spark.createDataFrame([(16, 16), (15, 16), (83, 83), (84, 83)], "col int, row int").select(grid.fits(F.col("col"), F.col("row"), 100, 100)).collect()
    assert [r[0] for r in fit] == [True, False, True, False]


def test_templates(spark):
    old = spark.createDataFrame([(0, 1, bytearray(b"a")), (1, 1, bytearray(b"b"))], schema.TEMPLATES)
    new = spark.createDataFrame([(1, 2, bytearray(b"B")), (2, 2, bytearray(b"C"))], schema.TEMPLATES)
    as_set = lambda d: {(r.trajectory_id, bytes(r.pixels)) for r in d.collect()}
    assert as_set(templates.append(old, new)) == {(0, b"a"), (1, b"b"), (2, b"C")}
    assert as_set(templates.update(old, new)) == {(0, b"a"), (1, b"B")}
    assert as_set(templates.merge(old, new)) == {(0, b"a"), (1, b"B"), (2, b"C")}
    p = pts(spark, [(0, 1, True, 0, 0, NOW), (9, 1, True, 0, 0, NOW)])
    assert templates.having(p, old).count() == 1 and templates.missing(p, old).first()[0] == 1


def test_correlation_finds_shift_and_turn():
    img = scenes.surface(200)
    t = raster.cut(img, 100, 90, 16)
    moved = np.roll(img, (5, -7), (0, 1))
    assert raster.search(moved, t, 100.4, 90.9, 0.0) == pytest.approx((93.4, 95.9, 1.0, 0.0))
    for turn in (15.0, -30.0):
        big = raster.rotated(img[40:151, 40:151], turn).astype(np.uint8)
        c, r, corr, won = raster.search(big, raster.cut(img, 95, 95, 16), 55.0, 55.0, 0.0)
        assert abs(c - 55) <= 1 and abs(r - 55) <= 1 and corr > 0.6
    assert raster.search(img, t, 20, 20, 0.0) == (20, 20, 0.0, 0.0)
    assert not raster.correlate(np.zeros((9, 9)), np.ones((3, 3))).any()


def test_preprocessing():
    dn = np.full((8, 6), 100, np.uint16)
    assert (raster.calibrate(dn, np.array([200.0]), 1.0) == 127).all() and raster.calibrate(dn, 200.0, 1.0).shape == (4, 3)
    # Halving takes the means of blocks.
    assert (raster.calibrate(np.arange(16, dtype=np.uint16).reshape(4, 4) * 2, 255.0, 1.0) == [[5, 9], [21, 25]]).all()
    img = scenes.surface(128) // 4
    out = raster.clahe(img.astype(np.uint8), 2.0, 8)
    assert out.shape == img.shape and out.std() > img.std()
    pixels = np.arange(24, dtype=np.uint8).reshape(2, 3, 4)
    back, affine = tiff.read(tiff.write(pixels, [10.0, 0, 5.0, 0, -10.0, 7.0]))
    assert (back == pixels).all() and affine == [10.0, 0, 5.0, 0, -10.0, 7.0]


def test_sources(spark, tmp_path):
    name = "S1B_EW_GRDM_1SDH_202001{:02d}T101112_20200101T101212_030614_03824D_9E1C.tiff"
    for d in (2, 1):
        (tmp_path / name.format(d)).write_bytes(tiff.write(np.zeros((2, 5, 4), np.uint8), [100.0, 0, 0.0, 0, -100.0, 500.0]))
    (tmp_path / "bad.tiff").write_bytes(tiff.write(np.zeros((1, 2, 2), np.uint8)))
    files = catalog.scan(spark, str(tmp_path))
    made = catalog.build(files, catalog.footprints(catalog.decode(spark, str(tmp_path))))
    rows = made.orderBy("image_id").collect()
    assert [r.image_id for r in rows] == [1, 2] and rows[0].filename == name.format(1) and (rows[0].maxx, rows[0].maxy) == (400.0, 500.0)
    assert rows[0].angle == pytest.approx(90.0)
    out = str(tmp_path / "cat.geojson")
    catalog.write_geojson(made, out, ["image_id", "filename", "timestamp"])
    back = catalog.read_geojson(spark, out).orderBy("image_id").collect()
    assert [r.filename for r in back] == [r.filename for r in rows] and back[0].footprint == rows[0].footprint
    calls = []
    kept = [catalog.load_or_build(spark, str(tmp_path / "kept"), lambda: calls.append(1) or made).count() for _ in range(2)]
    assert kept == [2, 2] and len(calls) == 1
    (tmp_path / "a_20200102T000000.SAFE").mkdir()
    (tmp_path / "z_20200101T000000.SAFE").mkdir()
    assert [r.filename[0] for r in catalog.scan_folders(spark, str(tmp_path)).collect()] == ["z", "a"]


def test_fold_over_images(spark, tmp_path):
    images, rasters = scenes.scenes(spark, 2, 224, (3, 2))
    store = Snapshots(spark, str(tmp_path), "run")
    config = Config(border_size=32, stride=1, persist_interval=100)
    p = Processor(spark, config, snapshots=store, persist=True, work=str(tmp_path / "work"))
    rows = p.run(images, rasters).toPandas()
    moved = rows.pivot(index="trajectory_id", columns="image_id", values=["x", "y", "corr"]).dropna()
    scale = 2 * scenes.EXTENT / 224
    assert len(moved) >= 3
    assert np.allclose(moved["x"][2] - moved["x"][1], 3 * scale, atol=scale) and np.allclose(moved["y"][1] - moved["y"][2], 2 * scale, atol=scale)
    assert (moved["corr"][2] >= config.min_correlation).all()
    assert rows[rows.is_last].trajectory_id.is_unique and rows.groupby("trajectory_id").is_last.sum().eq(1).all()
    again = Processor(spark, config, snapshots=store, persist=True, work=str(tmp_path / "work"))
    assert again.last_image_id == 2 and again.points.count() == len(rows) and not again.process_image(images[0], rasters)
    with pytest.raises(ValueError):
        Processor(spark, persist=True)


def test_stream_is_idempotent(spark, tmp_path):
    state = fold.HeadsFold(str(tmp_path))
    first = pts(spark, [(0, 1, True, 0, 0, NOW), (1, 1, True, 0, 0, NOW)])
    state(first, 0)
    state(first, 0)
    state(pts(spark, [(0, 2, True, 5, 5, NOW + timedelta(hours=1))]), 1)
    got = {(r.trajectory_id, r.image_id, r.is_last) for r in state.state(spark).collect()}
    assert got == {(0, 1, False), (1, 1, True), (0, 2, True)}
    # Started again, it goes on; a late row is kept without becoming a head, and rows of one image all stay.
    again = fold.HeadsFold(str(tmp_path))
    again(pts(spark, [(0, 1, True, 9, 9, NOW), (2, 3, True, 1, 1, NOW), (2, 3, True, 2, 2, NOW)]), 2)
    got = sorted((r.trajectory_id, r.image_id, r.is_last) for r in again.state(spark).collect())
    assert got == [(0, 1, False), (0, 1, False), (0, 2, True), (1, 1, True), (2, 3, False), (2, 3, True)]
    assert again.heads(spark).count() == 3 and fold.HeadsFold(str(tmp_path / "none")).state(spark) is None


def test_logging(tmp_path):
    logger = logs.setup_logging(str(tmp_path), "floetrack-test")
    assert len(logger.handlers) == 2 and logs.setup_logging(str(tmp_path), "floetrack-test") is logger and len(logger.handlers) == 2
    assert logs.timed(lambda: math.pi)() == math.pi


def test_spline(spark):
    rng = np.random.default_rng(6)
    src = rng.uniform(0, 1000, (25, 2))
    flat = src @ np.array([[2.0, 0.3], [-0.1, 4.0]]).T + [10.0, -20.0]
    bent = flat + np.column_stack([np.sin(src[:, 0] / 300), np.cos(src[:, 1] / 300)]) * 50
    rows = spark.createDataFrame([tuple(map(float, (*s, *f, *b))) for s, f, b in zip(src, flat, bent)], "c double, r double, fx double, fy double, bx double, by double")
    for names_, dst in ((("fx", "fy"), flat), (("bx", "by"), bent)):
        x, y = spline.apply(spline.solve(src, dst), F.col("c"), F.col("r"))
        worst = rows.select(F.max(F.abs(x - F.col(names_[0]))), F.max(F.abs(y - F.col(names_[1])))).first()
        assert max(worst) < 1e-6
    elsewhere = spark.createDataFrame([(123.0, 456.0)], "c double, r double")
    x, y = spline.apply(spline.solve(src, flat), F.col("c"), F.col("r"))
    assert tuple(elsewhere.select(x, y).first()) == pytest.approx((2 * 123 + 0.3 * 456 + 10, -0.1 * 123 + 4 * 456 - 20), abs=1e-6)
    with pytest.raises(ValueError):
        spline.solve(np.array([[0, 0], [1, 1], [2, 2]]), np.zeros((3, 2)))


def test_preprocessing_passes_over_what_is_done(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    rng = np.random.default_rng(1)
    for name in ("a.tiff", "b.tiff"):
        (folder / name).write_bytes(tiff.write(rng.integers(0, 200, (2, 64, 48), dtype=np.uint16)))
        got = preprocessing.preprocess_folder(spark, str(folder), out, tiles=4)
    assert sorted((r.filename, r.band, r.height, r.width) for r in got.collect()) == [(f, b, 32, 24) for f in ("a.tiff", "b.tiff") for b in ("s0_HH", "s0_HV")]
    assert got.where("error IS NOT NULL").count() == 0
    assert got.first().affine is None or len(got.first().affine) == 6
    # A broken file has its error, stops no other, and is tried again.
    (folder / "c.tiff").write_bytes(b"no image")
    got = preprocessing.preprocess_folder(spark, str(folder), out, tiles=4)
    assert [r.filename for r in got.where("error IS NOT NULL").collect()] == ["c.tiff"] and got.count() == 5
    (folder / "c.tiff").write_bytes(tiff.write(rng.integers(0, 200, (2, 64, 48), dtype=np.uint16), [10.0, 0, 5.0, 0, -10.0, 7.0]))
    got = preprocessing.preprocess_folder(spark, str(folder), out, tiles=4, calibration=spark.createDataFrame([("c.tiff", b, [100.0, 300.0]) for b in preprocessing.NAMES], "filename string, band string, calibration array<double>"))
    assert got.where("error IS NOT NULL").count() == 0 and got.count() == 6
    assert got.where("filename = 'c.tiff'").first().affine == [20.0, 0, 5.0, 0, -20.0, 7.0]
