"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; a temporary folder where that is unset and everything runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
    return _local.setdefault("root", _local.get("root") or "file://" + tempfile.mkdtemp(prefix="floetrack-"))
