"""Row-wise operators over streams.

Column functions have no state, so a streaming DataFrame takes them as a batch does; counts over time need a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexispark.functions.columns import make_pipeline
from lexispark.functions.tokens import lower_words


def read_texts(spark: SparkSession, path: str, schema: str, *, max_files: int = 100) -> DataFrame:
    """A stream of JSON lines as files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def clean(stream: DataFrame, *functions: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    return stream.withColumn(text_col, make_pipeline(*functions)(text_col))


def word_counts(stream: DataFrame, *, text_col: str = "text", time_col: str = "ts", window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(window, word, count) over event time; what comes later than ``delay`` is dropped."""
    rows = stream.withWatermark(time_col, delay).select(F.col(time_col).alias("ts"), F.explode(lower_words(text_col)).alias("word"))
    return rows.groupBy(F.window("ts", window).alias("window"), "word").agg(F.count("*").alias("count"))


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer whose state survives in the checkpoint folder, which all executors share."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
