"""Scenes: listing, decoding and the catalogue, with GeoJSON in and out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floetrack.functions import geo, names
from floetrack.operators import grid


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scan(spark: SparkSession, folder: str, pattern: str = "*.tiff") -> DataFrame:
    """(path, filename, length) of a folder's files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", names.basename(F.col("path")).alias("filename"), "length")


def scan_folders(spark: SparkSession, folder: str, suffix: str = ".SAFE") -> DataFrame:
    """(path, filename, time) of the product folders below a folder, by the time in their names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    paths = [(f.getPath().toString(),) for f in found if f.isDirectory() and f.getPath().getName().endswith(suffix)]
    rows = spark.createDataFrame(paths, "path string").withColumn("filename", names.basename(F.col("path")))
    return rows.withColumn("time", names.date_in(F.col("filename"))).orderBy(names.by_date(F.col("filename")), "filename")


def products(files: DataFrame, name: str = "filename") -> DataFrame:
    """Files whose names are product names, with the parts and the time; others are dropped."""
    parts = names.product(F.col(name))
    rows = files.withColumns(parts).withColumn("timestamp", names.stamp(F.col("start")))
    return rows.where(F.col("start").isNotNull() & F.col("timestamp").isNotNull())


def decode(spark: SparkSession, folder: str, pattern: str = "*.tiff") -> DataFrame:
    """(filename, band_no, height, width, bits, affine, data, error) of every band; one file is one row of a task.

    A file that cannot be read has one row, with its error and nulls.
    """
    shape = "filename string, band_no int, height int, width int, bits int, affine array<double>, data binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from floetrack.sources import tiff

        kinds = pa.schema([("filename", pa.string()), ("band_no", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("bits", pa.int32()), ("affine", pa.list_(pa.float64())), ("data", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    pixels, affine = tiff.read(batch.column(1)[i].as_py())
                except Exception as e:  # noqa: BLE001 - kept as a column, as the other files go on
                    yield pa.RecordBatch.from_pylist([{"filename": batch.column(0)[i].as_py(), "error": (str(e) or type(e).__name__)[:500]}], schema=kinds)
                    continue
                yield pa.RecordBatch.from_pylist(
                    [{"filename": batch.column(0)[i].as_py(), "band_no": k, "height": b.shape[0], "width": b.shape[1], "bits": b.dtype.itemsize * 8, "affine": affine, "data": b.tobytes()} for k, b in enumerate(pixels)],
                    schema=kinds,
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(names.basename(F.col("path")).alias("filename"), "content").mapInArrow(run, shape)


def footprints(decoded: DataFrame) -> DataFrame:
    """(filename, footprint, angle): the corners in map metres, upper left first and clockwise, and the rotation of the upper edge."""
    m, w, h = F.col("affine"), F.col("width").cast("double"), F.col("height").cast("double")
    corners = [geo.affine(c, r, m) for c, r in ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h), (F.lit(0.0), h))]
    angle = geo.rotation_angle(*corners[0], *corners[1])
    return decoded.where("band_no = 0").select("filename", geo.ring(*corners).alias("footprint"), angle.alias("angle"))


def build(files: DataFrame, shapes: DataFrame) -> DataFrame:
    """The catalogue: products with footprint and bounds, in the order of time, numbered from 1."""
    rows = products(files).join(shapes, "filename").withColumns(geo.bounds(F.col("footprint")))
    rows = rows.select("filename", "timestamp", "minx", "miny", "maxx", "maxy", "orbit_num", "footprint", *(["angle"] if "angle" in shapes.columns else []))
    return grid.ordinals(rows, "timestamp", "filename")


def projected(shapes: DataFrame) -> DataFrame:
    """Footprints from degrees to map metres."""

    def moved(p):
        x, y = geo.polar_forward(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return shapes.withColumn("footprint", F.transform("footprint", moved))


def feature_json(rows: DataFrame, properties: list[str], geometry: str = "footprint", kind: str = "Polygon") -> DataFrame:
    """One GeoJSON feature a row, as text."""
    if kind == "Polygon":
        points = F.transform(geometry, lambda p: F.array(p["x"], p["y"]))
        coordinates = F.array(F.concat(points, F.slice(points, 1, 1)))
    else:
        coordinates = F.array(F.col("x"), F.col("y"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return rows.select(F.to_json(feature).alias("value"))


def write_geojson(rows: DataFrame, path: str, properties: list[str], geometry: str = "footprint", kind: str = "Polygon", crs: str = "EPSG:3413") -> None:
    """A folder of feature collections, one in each part file, written where the rows are."""
    opened = '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"' + crs + '"}},"features":['

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = opened
        for batch in batches:
            values = []
            for v in batch.column(0).to_pylist():
                values.append(lead + v)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([(lead if lead != "," else "") + "]}"], pa.string())], names=["value"])

    feature_json(rows, properties, geometry, kind).mapInArrow(run, "value string").write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str, time: str | None = "timestamp") -> DataFrame:
    """The features of a folder or file of feature collections: properties, and footprint or x and y."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    point = rows.schema["f"].dataType["geometry"].dataType["coordinates"].dataType.simpleString() == "array<double>"
    if point:
        shape = [F.col("f.geometry.coordinates")[0].alias("x"), F.col("f.geometry.coordinates")[1].alias("y")]
    else:
        outer = F.col("f.geometry.coordinates")[0]
        shape = [F.transform(F.slice(outer, 1, F.size(outer) - 1), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("footprint")]
    out = rows.select("f.properties.*", *shape)
    return out.withColumn(time, F.to_timestamp(time)) if time and time in out.columns else out


def load_or_build(spark: SparkSession, path: str, make) -> DataFrame:
    """The catalogue kept at a path, or made by ``make`` and kept there first."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def insitu_of(image: str, insitu: DataFrame) -> DataFrame:
    """The in-situ points (image_filepath, x, y) of an image, matched by the last step of the path."""
    return insitu.where(names.basename(F.col("image_filepath")) == image.rsplit("/", 1)[-1])


def insitu_join(images: DataFrame, insitu: DataFrame) -> DataFrame:
    """In-situ points with the image_id of their image, matched by the last step of the path."""
    left = images.select("image_id", names.basename(F.col("filename")).alias("_name"))
    return insitu.withColumn("_name", names.basename(F.col("image_filepath"))).join(left, "_name").drop("_name")


def insitu_keypoints(points: DataFrame, affine: list[float]) -> DataFrame:
    """In-situ points as keypoints at the nearest pixel."""
    col, row = geo.affine_inverse(F.col("x"), F.col("y"), affine)
    return points.select("*", geo.nearest(col).alias("col"), geo.nearest(row).alias("row"))


def unprocessed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files without an output of the same name yet."""
    return files.join(done.select("filename"), "filename", "left_anti")


