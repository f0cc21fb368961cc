"""Folders of logs and stored verdicts: a sink that writes a file for each log, and a cache table that is renewed in place."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from faultline.operators.extract import batched
from faultline.operators.tables import Tables

#: Characters of a job id that a file's name keeps; all others, and the percent sign, are written as %XX.
KEPT = " !#$&'()+,-.;=@[]^_`{}~"


def file_name(job_id: str) -> str:
    return quote(job_id, safe=KEPT) + ".log"


def plain_name(name: Column) -> Column:
    """A name without its %XX; a plus sign is one."""
    return F.url_decode(F.replace(F.replace(name, F.lit("+"), F.lit("%2B")), F.lit(" "), F.lit("%20")))


def job_of(file: Column) -> Column:
    """The job whose log a file of this name is; a scan names files as parts of an address, so names are encoded once more there."""
    return plain_name(F.regexp_extract(plain_name(file), r"(?s)^(.+)\.log$", 1))


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the path in it."""
    if re.match("[a-z0-9]+:", path):
        return fs.FileSystem.from_uri(quote(re.sub("^file:/(?!/)", "file:///", path), safe="/:@"))
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class LogWriter(DataSourceArrowWriter):
    """A task writes each log under a name of its own attempt, and renames them all when it has read its last row.

    So a reader never sees half a log, and a task that runs twice leaves one file. The job's end leaves the mark
    _SUCCESS; a job that fails leaves none.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = place(self.path)
        files.create_dir(folder, recursive=True)
        task, size, names = TaskContext.get(), 0, []
        for batch in iterator:
            for job, text in zip(batch.column("job_id"), batch.column("log_text")):
                name, body = file_name(job.as_py()), text.as_py().encode("utf-8", "replace")
                part = f"{folder}/_{name}.{task.taskAttemptId() if task else 0}"
                with files.open_output_stream(part) as out:
                    out.write(body)
                names.append((part, f"{folder}/{name}"))
                size += len(body)
        for part, name in names:
            files.move(part, name)
        return Written(len(names), size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = place(self.path)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(f"{sum(m.files for m in messages if m)} {sum(m.size for m in messages if m)}\n".encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass


class LogFolder(DataSource):
    """Sink of (job_id, log_text): the file X.log of each job X, its text in UTF-8 byte for byte."""

    @classmethod
    def name(cls) -> str:
        return "log_folder"

    def schema(self) -> str:
        return "job_id string, log_text string"

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"])


def write_log_files(logs: DataFrame, path: str) -> None:
    """The texts of (job_id, log_text) as files of a folder; null texts and ids are left out, a later row of an id replaces an earlier one."""
    logs.sparkSession.dataSource.register(LogFolder)
    rows = logs.select(F.col("job_id").cast("string").alias("job_id"), F.col("log_text").cast("string").alias("log_text")).dropna()
    rows.write.format("log_folder").mode("append").save(path)


def log_positions(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, path, offset, length) of the *.log files of a folder: where each log's text is, without reading it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    return files.select(job_of(F.col("_metadata.file_name")).alias("job_id"), "path", F.lit(0).cast("long").alias("offset"), "length")


def line_positions(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, path, line_no, offset, length) of the lines of a folder's logs, ends of lines left out.

    A file is read as a stream by one task. What follows can filter, join and rank positions, a few numbers a line, and
    read the text of the rows that are left with `with_text`.
    """
    schema = pa.schema([("job_id", pa.string()), ("path", pa.string()), ("line_no", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for job, where in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    files, name = place(where)
                    at = 0
                    with files.open_input_stream(name) as source:
                        for no, line in enumerate(split_stream(iter(lambda: source.read(1 << 20), b""))):
                            bare = line.rstrip(b"\n").rstrip(b"\r") if line.endswith(b"\n") else line
                            yield (job, where, no, at, len(bare))
                            at += len(line)

        return batched(rows(), schema, 50_000)

    rows = log_positions(spark, path).select("job_id", "path")
    return rows.mapInArrow(run, "job_id string, path string, line_no long, offset long, length long")


def split_stream(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Lines with their line feeds, from pieces of any size; holds a line and a piece."""
    held: list[bytes] = []
    for piece in pieces:
        first, *rest = piece.split(b"\n")
        held.append(first)
        for more in rest:
            yield b"".join(held) + b"\n"
            held = [more]
    if last := b"".join(held):
        yield last


def with_text(rows: DataFrame, name: str = "log_text") -> DataFrame:
    """rows (path, offset, length, ...) with the text that stands there, bad bytes replaced; null where the file is gone.

    Rows of one file in a task are read in order of their place, through one open file.
    """
    fields = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, offsets, lengths = (batch.column(c).to_pylist() for c in ("path", "offset", "length"))
            texts: list[str | None] = [None] * batch.num_rows
            where, source = None, None
            for i in sorted(range(len(paths)), key=lambda i: (paths[i] or "", offsets[i] or 0)):
                if paths[i] != where:
                    where = paths[i]
                    try:
                        files, inner = place(where)
                        source = files.open_input_file(inner)
                    except (OSError, TypeError):
                        source = None
                if source is not None and lengths[i] is not None:
                    texts[i] = source.read_at(lengths[i], offsets[i]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{name}` string")


#: What an entry of the cache holds besides its key, and what stands for a missing field.
ENTRY = {
    "job_id": ("string", ""), "root_cause": ("string", "Unknown"), "severity": ("string", "medium"), "error_category": ("string", "Unknown"), "failure_type": ("string", "unknown"),
    "confidence": ("double", 0.0), "explanation": ("string", ""), "fix_suggestions": ("array<string>", None), "recommended_action": ("string", ""),
}
TTL = 7 * 86400.0


class VerdictCache:
    """Verdicts by the hash of the text that they judge, in a table cut into 256 parts by the hash's first two digits.

    A write merges into the parts that its keys touch and replaces those alone; of several results of one key the last
    stays. Entries that are expired, or that can't be read, are misses.
    """

    def __init__(self, spark: SparkSession, path: str, ttl: float = TTL):
        self.spark, self.path, self.ttl = spark, path, ttl

    def rows(self) -> DataFrame:
        """(text_hash, cached_at, entry, prefix); none where the table is not there yet."""
        schema = "text_hash string, cached_at double, entry string, prefix string"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(self.path)

    def put(self, results: DataFrame, now: float, order: str = "job_ord") -> None:
        """Stores successful results (text_hash, success, order, and columns of ENTRY); failed ones leave what is there."""
        cells = [F.col(c).cast(t).alias(c) for c, (t, _) in ENTRY.items() if c in results.columns]
        new = results.where("success and text_hash is not null").select("text_hash", F.lit(now).alias("cached_at"), F.to_json(F.struct(*cells)).alias("entry"), F.col(order).alias("_order"))
        new = new.groupBy("text_hash").agg(F.max_by(F.struct("cached_at", "entry"), F.struct("_order", "entry")).alias("x")).select("text_hash", "x.*")
        tables = Tables(self.spark, "cache")
        new = tables.put(new.withColumn("prefix", F.substring("text_hash", 1, 2)), "new")
        touched = [r.prefix for r in new.select("prefix").distinct().collect()]  # 256 at most
        old = self.rows().where(F.col("prefix").isin(touched)).join(new.select("text_hash"), "text_hash", "left_anti")
        # the parts are read before any is replaced
        merged = tables.put(old.select(*new.columns).unionByName(new), "merged")
        merged.repartition("prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(self.path)
        tables.drop()

    def get(self, rows: DataFrame, now: float) -> DataFrame:
        """rows (text_hash, ...) with the fields of ENTRY that rows lacks, null at a miss, and cached, which tells hits."""
        schema = ", ".join(f"{c} {t}" for c, (t, _) in ENTRY.items())
        live = self.rows().where(F.col("cached_at") >= now - self.ttl).withColumn("x", F.from_json("entry", schema)).where("x is not null and try_parse_json(entry) is not null")
        cells = [F.coalesce(F.col(f"x.{c}"), F.array().cast(t) if d is None else F.lit(d)).alias(c) for c, (t, d) in ENTRY.items() if c not in rows.columns]
        last = Window.partitionBy("text_hash").orderBy(F.desc("cached_at"))
        live = live.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").select("text_hash", *cells, F.lit(True).alias("cached"))
        return rows.join(live, "text_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))

    def clear(self) -> int:
        """Deletes all entries; how many there were."""
        n = self.rows().count()
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return n
