"""Tables that an operator writes between its jobs, and ranks that need no single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; unset on one machine, as in tests, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    folder = tempfile.mkdtemp(prefix="faultline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Tables:
    """Written tables cut the lineage: what comes before them is not computed again after the loss of an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(rows: DataFrame, group: str, key: str, tables: Tables, name: str) -> DataFrame:
    """rows with rank, their place from 1 in their group by key, which is unique there.

    Rows are dealt by ranges of (group, key), so that a group of any size is many tasks, each ranking its own; a prefix
    sum over the ranges of a group gives where they begin.
    """
    dealt = tables.put(rows.repartitionByRange(group, key).withColumn("part", F.spark_partition_id()), name)
    sizes = dealt.groupBy("part", group).agg(F.count("*").alias("own"))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", group, F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", group).orderBy(key))
    return dealt.withColumn("inside", inside).join(sizes, ["part", group]).withColumn("rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")
