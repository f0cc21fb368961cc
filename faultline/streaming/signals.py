"""Failure signals of logs as they arrive: the batch rules on a stream (beyond the batch operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultline.operators.extract import signal_type


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, line, signal_type) of the lines of text files that appear in a folder."""
    lines = spark.readStream.format("text").load(path).select(F.regexp_extract(F.col("_metadata.file_name"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("job_id"), F.col("value").alias("line"))
    return lines.withColumn("signal_type", signal_type(F.col("line"))).where("signal_type is not null")


def watch(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each batch of new signals to sink, what is there already first, then stop."""
    return arriving(spark, path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
