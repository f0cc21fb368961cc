"""WARC archives without repeated payloads: revisit resolution by payload digest.

Headers alone (page, digest, size) are shuffled by digest to find each payload's first page. What was found goes back to
the pages as the short list of those that revisit another: pages are read by groups of input files, so large that a
group's list stays small enough to be sent to its tasks, and no payload is shuffled however many revisits there are. In
one pass over the pages each becomes a response with its payload or a revisit that refers to the first. Archives are
standard ones: a gzip member for each record, so that a record can be read where it stands; files are cut by their size,
and are read back as a stream, record by record.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from faultline.llm.common import Workspace

FILE_BYTES = 64 << 20
GROUP_REVISITS = 1_000_000  # of about 60 bytes
BATCH_BYTES = 16 << 20
EPOCH = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload):
    """Upper-case base32 of the SHA-1, from Spark functions: 40 bits of hex at a time."""
    digits = F.sha1(payload)
    part = lambda i: F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*(part(i) for i in range(4)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def hashed(pages: DataFrame, id_col: str, url_col: str, payload_col: str, file: Column | None = None) -> DataFrame:
    """(file, id, url, payload, bytes, digest) of each page."""
    rows = pages.select(
        (F.lit("") if file is None else file).alias("file"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    )
    return rows.select("*", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload").cast("binary")).alias("digest"))


def revisits(heads: DataFrame, least_bytes: int) -> DataFrame:
    """(rid, rdigest, first, file): pages whose payload an earlier page holds; heads are (id, digest, bytes, file)."""
    large = heads.where((F.col("bytes") >= least_bytes) & F.col("id").isNotNull())
    firsts = large.groupBy("digest").agg(F.min("id").alias("first"))
    found = large.select("id", "digest", "file").distinct().join(firsts, "digest").where("first < id")
    return found.select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), "first", "file")


def records(rows: DataFrame) -> DataFrame:
    """(value): one WARC record for each row."""
    revisit = F.col("first") < F.col("id")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(revisit, "").otherwise(F.col("payload"))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit(f"WARC-Date: {EPOCH}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(header, F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")).alias("value"))


@dataclass
class Archives(WriterCommitMessage):
    names: list[str]


class ArchiveWriter(DataSourceArrowWriter):
    """A task writes archives of about FILE_BYTES under names that no reader takes; when the job has ended well, those of the attempts that counted are renamed."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def place(self):
        from pyarrow import fs

        if re.match("[a-z0-9]+:", self.path):
            return fs.FileSystem.from_uri(quote(re.sub("^file:/(?!/)", "file:///", self.path), safe="/:@"))
        return fs.LocalFileSystem(), self.path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        files, folder = self.place()
        files.create_dir(folder, recursive=True)
        task, names, out, size = TaskContext.get(), [], None, 0
        for batch in iterator:
            for record in batch.column(0):
                if out is None:
                    names.append(f"part-{task.partitionId():06}-{task.taskAttemptId()}-{len(names):04}.warc.gz")
                    out, size = files.open_output_stream(f"{folder}/_{names[-1]}.open", compression=None), 0
                member = gzip.compress(record.as_buffer(), 6, mtime=0)
                out.write(member)
                size += len(member)
                if size >= self.size:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Archives(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = self.place()
        for name in (x for m in messages if m for x in m.names):
            files.move(f"{folder}/_{name}.open", f"{folder}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = self.place()
        for name in (x for m in messages if m for x in m.names):
            files.delete_file(f"{folder}/_{name}.open")


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], int(self.options.get("fileBytes", FILE_BYTES)))


def file_groups(found: DataFrame, most: int) -> list[list[str]]:
    """Input files in groups whose revisits number `most` together, or one file each; a name and a count for each file reach the driver."""
    sizes = found.groupBy("file").agg(F.count("*").alias("n")).where("file <> ''")
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    rows = sizes.select("file", F.floor(F.coalesce(before, F.lit(0)) / most).alias("g")).collect()
    groups: dict[int, list[str]] = {}
    for r in rows:
        groups.setdefault(r.g, []).append(r.file)
    return list(groups.values())


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Write deduplicated gzip archives into a folder, in one pass over the pages after one over their headers.

    Of rows with equal payloads of at least least_bytes bytes, that with the smallest id is the response and the
    others revisit it; a null payload is empty. Rows that repeat an id are one page: with equal payloads each is
    written as that page's response. A null id is never a revisit. A very long page is a record, held whole by the task
    that writes it; a file must stay below the 2 GB that Spark reads as one binary. Pages that don't come straight from
    files are joined with their revisits as Spark sees fit. Other columns are ignored.
    """
    spark = pages.sparkSession
    spark.dataSource.register(ArchiveSink)
    work = Workspace(spark, "revisits")
    file: Column | None = F.col("_metadata.file_path")
    try:
        pages.select(file)
    except AnalysisException:
        file = None
    heads = work.table(hashed(pages, id_col, url_col, payload_col, file).select("id", "digest", "bytes", "file"), "heads")
    table = work.table(revisits(heads, least_bytes), "revisits")

    def put(some: DataFrame, again: DataFrame) -> None:
        rows = hashed(some, id_col, url_col, payload_col).join(again, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
        records(rows.withColumn("first", F.coalesce("first", "id"))).write.format("warc").mode("append").option("fileBytes", FILE_BYTES).save(path)

    answers = table.select("rid", "rdigest", "first")
    if file is None:
        put(pages, answers.distinct())
    else:
        groups = file_groups(table, GROUP_REVISITS)
        for group in groups:
            mine = table.where(F.col("file").isin(group)).select("rid", "rdigest", "first").distinct()
            # a file's revisits are at most its pages, and a group of several files holds GROUP_REVISITS beside one file's at most
            put(pages.where(file.isin(group)), F.broadcast(mine) if mine.count() <= 2 * GROUP_REVISITS else mine)
        rest = [f for group in groups for f in group]
        put(pages.where(~file.isin(rest)) if rest else pages, answers.limit(0))
    work.drop()


def parsed(pieces: Iterator[bytes]) -> Iterator[dict]:
    """The records of a stream; holds one record and one piece."""
    held, at, ended = b"", 0, False

    def more() -> None:
        nonlocal held, at, ended
        piece = next(pieces, None)
        ended = piece is None
        held, at = held[at:] + (piece or b""), 0

    while True:
        while (stop := held.find(b"\r\n\r\n", at)) < 0 and not ended:
            more()
        if at == len(held):
            return
        lines = held[at:stop].decode("utf-8").split("\r\n")
        if stop < 0 or lines[0] != "WARC/1.1":
            raise ValueError("no record where one should start")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, size = stop + 4 - at, int(head["content-length"])
        while len(held) - at < start + size + 4:
            if ended:
                raise ValueError(f"{head['warc-record-id']} is cut off")
            more()
        yield head | {"block": held[at + start : at + start + size]}
        at += start + size + 4


def unzipped(data: pa.Buffer, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of gzip members, a piece at a time."""
    view, at, member = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view) or member.unconsumed_tail:
        if not member.unconsumed_tail:
            given = view[at : at + (1 << 16)]
            at += len(given)
        else:
            given = member.unconsumed_tail
        out = member.decompress(given, piece)
        if member.eof:
            left = member.unused_data
            at -= len(left)
            member = zlib.decompressobj(31)
        if out:
            yield out
    if out := member.flush():
        yield out


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, digest, refers_to, bytes, url, payload) of every record under path.

    A response's digest is computed again from its payload and must equal its header's; bytes and payload are null
    for revisits.
    """
    schema = pa.schema(
        [("id", pa.int64()), ("type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("bytes", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    )

    def page(urn: str | None) -> int | None:
        return int(digits) if urn and (digits := urn[10:-1]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for r in parsed(unzipped(content.as_buffer())):
                    full, digest = r["warc-type"] == "response", r["warc-payload-digest"].removeprefix("sha1:")
                    if full and b32encode(hashlib.sha1(r["block"]).digest()).decode() != digest:
                        raise ValueError(f"payload of {r['warc-record-id']} doesn't match its digest")
                    rows.append(
                        {
                            "id": page(r["warc-record-id"]),
                            "type": r["warc-type"],
                            "digest": digest,
                            "refers_to": page(r.get("warc-refers-to")),
                            "bytes": len(r["block"]) if full else None,
                            "url": r["warc-target-uri"],
                            "payload": r["block"] if full else None,
                        }
                    )
                    size += 200 + len(r["block"])
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, "id long, type string, digest string, refers_to long, bytes long, url string, payload binary")


def headers(found: DataFrame, work: Workspace) -> DataFrame:
    """(id, type, digest, refers_to, bytes): revisits take the size of the response that holds their digest."""
    found = work.table(found.select("id", "type", "digest", "refers_to", "bytes"), "headers")
    held = found.where("type = 'response'").groupBy("digest").agg(F.max("bytes").alias("held"))
    revisits = found.where("type = 'revisit'").join(held, "digest").select("id", "type", "digest", "refers_to", F.col("held").alias("bytes"))
    return found.where("type = 'response'").unionByName(revisits)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, type, digest, refers_to, bytes): pages written to archives in the shared folder and read back."""
    work = Workspace(pages.sparkSession, "warc")
    write(pages, f"{work.root}/archives", id_col, url_col, payload_col, least_bytes)
    out = headers(read(pages.sparkSession, f"{work.root}/archives"), work)
    work.drop("archives")
    return out
