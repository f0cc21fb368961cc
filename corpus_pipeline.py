"""From raw documents to packed training sequences, in five stages; each one's result is written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents, n_chars being the length of the text that is left.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, lines, packing, quality, shingles
from faultline.llm.common import Workspace

# rows that go to Python and back at once: a batch of the default size holds tens of MB of text on each side of the pipe
BATCH_ROWS = "1000"
SHINGLE = 5
SIMILARITY = 0.8


def small_batches(stage):
    """A stage under which the session sends batches of BATCH_ROWS rows to Python."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant doesn't reject."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@small_batches
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier line or are within two edits of one."""
    rows = lines.without_repeats(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else c for c in docs.columns))


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of pairs whose five-word shingles have a Jaccard of 0.8 or more, that of smallest id.

    Documents that lost all their lines have one empty set, so one of them stays. Different texts of one id are
    different documents.
    """
    return shingles.representatives(docs, width=SHINGLE, similarity=SIMILARITY)


@small_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = found.where("n_hit > 0").select(F.col("id").alias("hit_id"), F.col("hash").alias("hit_hash")).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_hash")), "left_anti")


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences of 2048 tokens."""
    pieces = packing.pack(docs)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: The discriminant, the fingerprints and the tokens have no form in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return docs
