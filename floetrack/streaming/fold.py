"""The fold over images as a stream: micro-batches of scenes, taken in ascending order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class HeadsFold:
    """History and heads of trajectories from batches of points (trajectory_id, image_id, ...).

    All state is below ``path``: each batch's points are appended as a part of their own, and the heads, one row for
    each trajectory, are a small table by batch number, written last. So a run that starts again goes on
    from the last complete batch, and a batch that is delivered again replaces what it wrote before.
    Every row is kept; the head is the row of the greatest image, of the later batch on ties. No batch
    rewrites the history.
    """

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _versions(self, spark: SparkSession) -> list[int]:
        """The numbers of the batches whose heads are complete, ascending."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads/*/_SUCCESS")
        found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def _points(self, spark: SparkSession, last: int) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/points").parquet(f"{self.path}/points/batch=*").where(F.col("batch") <= last)

    def heads(self, spark: SparkSession) -> DataFrame | None:
        """The newest row of every trajectory; None before the first batch."""
        done = self._versions(spark)
        return spark.read.parquet(f"{self.path}/heads/{done[-1]}").select("top.row.*").withColumn("is_last", F.lit(True)) if done else None

    def state(self, spark: SparkSession) -> DataFrame | None:
        """All points, with is_last; None before the first batch."""
        done = self._versions(spark)
        if not done:
            return None
        tops = spark.read.parquet(f"{self.path}/heads/{done[-1]}").select("trajectory_id", "top.batch", "top.tie", F.lit(True).alias("_top"))
        points = self._points(spark, done[-1]).withColumn("batch", F.col("batch").cast("long"))
        return points.join(tops, ["trajectory_id", "batch", "tie"], "left").withColumn("is_last", F.coalesce("_top", F.lit(False))).drop("_top", "batch", "tie")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, place = batch.sparkSession, f"{self.path}/points/batch={batch_id}"
        batch.drop("is_last").withColumn("tie", F.monotonically_increasing_id()).write.mode("overwrite").parquet(place)
        rows = spark.read.parquet(place)
        own = [F.col(c) for c in rows.columns if c != "tie"]
        new = rows.select("trajectory_id", F.struct("image_id", F.lit(batch_id).cast("long").alias("batch"), "tie", F.struct(*own).alias("row")).alias("top"))
        before = [v for v in self._versions(spark) if v < batch_id]
        if before:
            new = new.unionByName(spark.read.parquet(f"{self.path}/heads/{before[-1]}"))
        new.groupBy("trajectory_id").agg(F.max("top").alias("top")).write.mode("overwrite").parquet(f"{self.path}/heads/{batch_id}")
        for old in before[:-1]:  # the one before this stays, in case this batch comes again
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads/{old}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def run(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts the fold over a stream, taking what is available and then stopping."""
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift_windows(points: DataFrame, *, window: str = "1 day", late: str = "4 days") -> DataFrame:
    """Counts and mean correlation by event-time windows, with a watermark; works on streams and tables alike."""
    timed = points.withWatermark("time", late) if points.isStreaming else points
    return timed.groupBy(F.window("time", window)).agg(F.count("*").alias("n"), F.avg("corr").alias("mean_corr"))
