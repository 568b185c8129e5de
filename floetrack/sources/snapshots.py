"""Versioned snapshots of the state, committed by one small pointer file written last."""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floetrack.functions import names
from floetrack.sources import catalog

log = logging.getLogger("floetrack")


class Snapshots:
    """Saves and loads points, templates and in-situ points of a run below a base path on any file system.

    A save writes a new version and then a pointer file with the next number; the greatest number counts, so
    a reader, or a run that starts again after a failure, sees the last complete version at any time.
    The version before it stays until the next save, for those that are reading it.
    """

    def __init__(self, spark: SparkSession, base: str, run: str):
        if not base or not run:
            raise ValueError("a base path and a run name are needed")
        self.spark, self.root = spark, f"{base.rstrip('/')}/{run}"
        self.run = run

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        """The names of the pointer files, ascending."""
        where, fs = self._fs(f"{self.root}/CURRENT-*")
        return sorted(f.getPath().getName() for f in fs.globStatus(where) or [])

    def _version(self, pointer: str) -> str:
        where, fs = self._fs(f"{self.root}/{pointer}")
        stream = fs.open(where)
        try:
            return f"{self.root}/{stream.readLine()}"
        finally:
            stream.close()

    def current(self) -> str | None:
        """The last complete version's folder."""
        pointers = self._pointers()
        return self._version(pointers[-1]) if pointers else None

    def save(self, points: DataFrame, templates: DataFrame, insitu: DataFrame | None = None, *, descriptors_as_json: bool = False) -> bool:
        """Writes a version and makes it current; those before the last one go."""
        before, version = self._pointers(), uuid.uuid4().hex
        path = f"{self.root}/{version}"
        rows = points.withColumn("descriptors", names.descriptor_json(F.col("descriptors"))) if descriptors_as_json else points
        rows.write.parquet(f"{path}/points")
        templates.write.parquet(f"{path}/templates")
        if insitu is not None:
            keep = [c for c in insitu.columns if c not in ("x", "y")]
            catalog.write_geojson(insitu, f"{path}/validation/{self.run}_validation", keep, kind="Point")
        number = int(before[-1].rpartition("-")[2]) + 1 if before else 1
        fresh, fs = self._fs(f"{self.root}/_NEXT.{version}")
        stream = fs.create(fresh, True)
        stream.writeBytes(version + "\n")
        stream.close()
        where, _ = self._fs(f"{self.root}/CURRENT-{number:012d}")
        if not fs.rename(fresh, where):
            raise OSError(f"{where.toString()} is there already: another run saves to the same place")
        for pointer in before[:-1]:
            for gone in (self._version(pointer), f"{self.root}/{pointer}"):
                old, fs = self._fs(gone)
                fs.delete(old, True)
        log.info("saved %s", path)
        return True

    def load(self) -> tuple[DataFrame, DataFrame] | None:
        """(points, templates) of the current version, None before the first; descriptors are bytes again."""
        path = self.current()
        if path is None:
            return None
        points = self.spark.read.parquet(f"{path}/points")
        if points.schema["descriptors"].dataType.simpleString() == "string":
            points = points.withColumn("descriptors", names.descriptor_from_json(F.col("descriptors")))
        return points, self.spark.read.parquet(f"{path}/templates")
