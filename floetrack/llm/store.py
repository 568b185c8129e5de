"""Intermediate tables that survive lost executors.

Lineage is cut by writing Parquet into the folder that ``spark.checkpoint.dir`` names, which all
executors share, and reading it back. Where the setting is absent (tests, a laptop) a temporary
folder stands in for it.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables; from ``spark.checkpoint.dir`` where that is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if "root" not in _local:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        _local["root"] = "file://" + tempfile.mkdtemp(prefix="floetrack-")
    return _local["root"]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses; it goes when the driver ends."""
    path = f"{shared_root(spark)}/floetrack/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # noqa: BLE001 - the session has already stopped
        return


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes of an Arrow batch while an intermediate table is written; both sides of the pipe hold a few of them.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``materialise`` has written within it, but for those to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop(spark, path)


#: Numbers that one file of an intermediate table stands for, about, and the least number of files for each core.
PER_FILE, FILES_PER_CORE = 500_000, 4
_files: list[int] = []


@contextlib.contextmanager
def files_for(spark: SparkSession, numbers: int) -> Iterator[None]:
    """Within it ``materialise`` merges small partitions: to as many files at most as ``numbers`` numbers ask for.

    The bound grows with the input; tables of fewer partitions than that stay as they are.
    """
    _files.append(max(FILES_PER_CORE * spark.sparkContext.defaultParallelism, -(-int(numbers) // PER_FILE)))
    try:
        yield
    finally:
        _files.pop()


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; any rows, an empty table too.

    Within ``scratch`` it goes at the end of that; with ``keep`` at the end of the one around it, if any, or
    when the driver ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    owners = _scratch[:-1] if keep else _scratch
    if owners:
        owners[-1].append(path)
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        (df.coalesce(_files[-1]) if _files else df).write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name``: longs that rise in the order of its rows, file by file; no two are equal.

    The number is a row's place in the stored files, so it is the same however often it is read. What is not
    a plain Parquet table is written first, in the order of its partitions. An empty table stays empty.
    """
    if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or not df.inputFiles():
        df = materialise(df, name)
    # Files are in the order of the tasks that wrote them, which have six digits or more from 100,000 on.
    path, task = F.col("_metadata.file_path"), F.regexp_extract("_path", r"part-(\d+)[^/]*$", 1).try_cast("long")
    files = df.select(path.alias("_path")).distinct()
    files = files.select("_path", F.row_number().over(Window.orderBy(task, "_path")).cast("long").alias("_file"))  # a row for each file
    rows = df.select("*", path.alias("_path"), F.col("_metadata.row_index").alias("_row")).join(F.broadcast(files), "_path")
    return rows.select(*df.columns, (F.shiftleft("_file", 40) + F.col("_row")).alias(name))


def text_keys(text: str) -> list[Column]:
    """th1 and th2: 128 bits that equal texts share (null ones too), without leaving the JVM."""
    return [F.xxhash64(F.lit(1), F.col(text)).alias("th1"), F.xxhash64(F.lit(2), F.lit("x"), F.col(text)).alias("th2")]


#: Bits of the filter of ``apart`` for each value, and at most; where it is full, more rows count as met.
BITS_PER_VALUE, MOST_BITS = 16, 1 << 26


def apart(rows: DataFrame, values: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose value of a long column may be among ``values``', and those whose value is not.

    The second are told by a broadcast filter of bounded size, so they need not be moved; to decide on the first is
    left to a join. A null is among no values. Either part, or ``values``, may be empty.
    """
    size = min(max(1 << 12, 1 << (BITS_PER_VALUE * values.count()).bit_length()), MOST_BITS)
    spot = F.pmod(F.col(column), F.lit(size))
    page, word, bit = F.shiftright(spot, 12).cast("int"), (F.shiftright(spot, 6) % 64).cast("int"), F.pmod(spot, F.lit(64)).cast("int")
    words = values.where(F.col(column).isNotNull()).select(page.alias("_page"), word.alias("_word"), bit.alias("_bit")).groupBy("_page", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    pages = words.groupBy("_page").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_map"))  # 64 words a row: few bytes beside the bits
    pages = pages.select("_page", F.expr("transform(sequence(0, 63), i -> coalesce(_map[i], 0L))").alias("_words"))
    told = rows.withColumns({"_of": page, "_in": word, "_at": bit}).join(F.broadcast(pages), F.col("_of") == F.col("_page"), "left")
    met = F.coalesce(F.expr("shiftrightunsigned(_words[_in], _at) & 1") == 1, F.lit(False))
    return told.where(met).select(*rows.columns), told.where(~met).select(*rows.columns)
