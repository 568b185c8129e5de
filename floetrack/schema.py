"""Table layouts: point history, templates, rasters, image metadata, catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Column order and types of the point history.
POINTS = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("is_last", T.BooleanType()),
        T.StructField("trajectory_id", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("descriptors", T.BinaryType()),
        T.StructField("angle", T.DoubleType()),
        T.StructField("corr", T.DoubleType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("interpolated", T.BooleanType()),
    ]
)
TEMPLATES = T.StructType(
    [T.StructField("trajectory_id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("pixels", T.BinaryType())]
)
RASTER = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("band", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)
XY = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
IMAGE_META = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("filename", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("angle", T.DoubleType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("affine", T.ArrayType(T.DoubleType())),
        T.StructField("footprint", XY),
    ]
)
BANDS = ("s0_HV", "s0_HH")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], schema)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns, in its order and types; missing ones are null."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
