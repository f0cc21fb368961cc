"""Tables between jobs, and connected components, for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; where it is unset on one machine (tests), a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df has in no spelling: each name with as many underscores before it as it takes."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def drawn(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """About `size` rows, or all where they are no more: those whose keys' hash lies below a cut that follows from their count.

    Every task finds its own, so no task and no driver holds more than the sample; the same rows come at every run.
    Over the size by more than five standard deviations is less likely than one in a million.
    """
    count = rows.count()
    if count <= size:
        return rows
    share = max(0.0, size - 5 * size**0.5) / count
    return rows.where(F.xxhash64(F.lit(77), *keys) < F.lit(int(-(2**63) + share * 2**64)))


class Workspace:
    """Tables that one operator writes between its jobs.

    A written table cuts the lineage: after the loss of an executor nothing before it is computed again.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes a table, or all of them; nothing where there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, work: Workspace, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    Alternating large-star and small-star passes. Each pass is an aggregate with a map-side minimum and an
    equi-join that adaptive execution can split on a hub; only the count of changed rows reaches the driver.
    """
    edges = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    edges = work.table(edges, "edges0")
    seen, turn = None, 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(least.where("m < u")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = work.table(small.union(low).where("u <> v").distinct(), f"edges{turn + 1}")
        # a fixed point has one edge per node, to its root; sums over a hash tell two edge sets apart
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"edges{turn}")
        edges, turn = nxt, turn + 1
        if mark == seen:
            break
        seen = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
