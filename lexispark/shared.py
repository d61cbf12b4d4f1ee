"""Lineage cuts through the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UNNAMED: dict[str, str] = {}
#: Bytes of a file that the driver holds at once.
CHUNK = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; only in local mode, as in tests, it may be unset, and a temporary folder serves."""
    app = spark.sparkContext.applicationId
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    named = spark.conf.get("spark.checkpoint.dir", None) or _UNNAMED.get(app) or _UNNAMED.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lexispark-"))
    return f"{named.rstrip('/')}/{app}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, part: Column | None = None) -> DataFrame:
    """``df`` with a number from 0 on: rows are numbered in their partitions, or ``part`` of it in ascending order, which begin where those before them end."""
    placed = written(df.withColumn("_part", F.spark_partition_id() if part is None else part).withColumn("_k", F.monotonically_increasing_id()))
    within = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy("_k")))
    sizes = placed.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_part", "_k", "_n", "_before")  # a row for each partition


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in any file system that Spark reads, sent there bit by bit."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for k in range(0, len(content), CHUNK):
            stream.write(bytearray(content[k : k + CHUNK]))
    finally:
        stream.close()


def got(spark: SparkSession, path: str) -> bytes:
    """What :func:`put` has written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream, out = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at), bytearray()
    try:
        while part := stream.readNBytes(CHUNK):
            out += part
    finally:
        stream.close()
    return bytes(out)


def put_lines(df: DataFrame, path: str) -> None:
    """The rows of a table of one text column, in their order, as the lines of one named file.

    Each task writes its own; the driver joins these streams, of which it holds a buffer.
    """
    spark, made = df.sparkSession, scratch(df.sparkSession)
    df.write.text(made)
    jvm = spark._jvm.org.apache.hadoop
    fs = jvm.fs.Path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in fs.listStatus(jvm.fs.Path(made)) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = fs.create(jvm.fs.Path(path), True)
    try:
        for part in parts:
            stream = fs.open(part)
            jvm.io.IOUtils.copyBytes(stream, out, CHUNK, False)
            stream.close()
            fs.delete(part, False)
    finally:
        out.close()
