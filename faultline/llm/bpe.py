"""BPE ids of whole texts, and the texts of ids, by reuse of content-defined chunks.

A rolling hash cuts texts where their own bytes say so, hence equal passages give equal chunks wherever they stand. A
chunk that occurs again is encoded once for all documents; what occurs once is encoded where its document is. At a
join the ids of both chunks are opened, and the bytes between are encoded anew: the window grows on either side until
it ends where white space follows another character and a token of the chunk's own ids ends there too. No pre-token
reaches over such a place in any text that holds it, so the ids on both sides agree with those of the whole text.

Texts are read three times and moved once. First, the chunks' hashes are counted, and those that recur go into a bit
table of fixed size, which all tasks get; a hash that falls on a set bit by chance is treated as shared, nothing else.
Second, the shared chunks are encoded. Third, documents meet the shared chunks' ids in buckets of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Workspace
from faultline.llm.packing import encode, encoder

RANKS = "byte_bpe_50k.tiktoken"
WINDOW_DOUBLINGS = 4
CUT_BITS = 9
LEAST_CHUNK = 64
FILTER_BITS = 26
BUCKET_BYTES = 8_000_000
PLACE = re.compile(r"(?<=\S)[ \t\n\r]")


@cache
def pieces(ranks_file: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each id, and their number."""
    made = encoder(ranks_file)
    table = [made.decode_single_token_bytes(i) for i in range(made.n_vocab)]
    return table, np.array([len(x) for x in table])


def decoded(ids: np.ndarray, ranks_file: str) -> bytes:
    return b"".join(map(pieces(ranks_file)[0].__getitem__, ids.tolist()))


def chunks(body: bytes) -> list[bytes]:
    """body cut where the hash of the 16 bytes before has CUT_BITS leading zeros, at the next start of a character."""
    b = np.frombuffer(body, np.uint8)
    if len(b) <= LEAST_CHUNK:
        return [body] if body else []
    h, by = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0x100000001B3
    for i in range(WINDOW_DOUBLINGS):
        wide = h.copy()
        wide[1 << i :] += h[: -(1 << i)] * np.uint64(by)
        h, by = wide, by * by % 2**64
    starts = np.flatnonzero((b & 0xC0) != 0x80)
    cuts = np.searchsorted(starts, np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1)
    out, at = [], 0
    for cut in starts[cuts[cuts < len(starts)]].tolist():
        if cut - at >= LEAST_CHUNK:
            out.append(body[at:cut])
            at = cut
    return [*out, body[at:]]


def key_of(chunk: bytes) -> bytes:
    return blake2b(chunk, digest_size=16).digest()


def open_ends(text: str, ids: np.ndarray, ranks_file: str) -> tuple[int, int]:
    """How many ids come before the first agreeing place of a chunk, and from the last on; (-1, -1) without one.

    A place agrees if white space follows another character and an id ends there.
    """
    ends = np.cumsum(pieces(ranks_file)[1][ids])

    def agreeing(places) -> int:
        for p in places:
            size = len(text[:p].encode())
            if ends[i := int(np.searchsorted(ends, size))] == size:
                return i + 1
        return -1

    head = agreeing(m.start() for m in PLACE.finditer(text))
    if head < 0:
        return -1, -1
    tail = -1
    for reach in (32, 1024, len(text)):
        start = max(0, len(text) - reach)
        if (tail := agreeing(reversed([m.start() for m in PLACE.finditer(text, start)]))) >= 0:
            break
    return head, len(ids) - tail


def encoded_chunk(chunk: bytes, ranks_file: str) -> tuple[np.ndarray, int, int]:
    text = chunk.decode("utf-8", "replace")
    ids = encode(text, ranks_file)
    return ids, *open_ends(text, ids, ranks_file)


def joined(parts: list[tuple[np.ndarray, int, int]], ranks_file: str) -> np.ndarray:
    """The ids of a text from those of its chunks, in order."""
    again = lambda window: encode(window.decode("utf-8", "replace"), ranks_file)
    out, window, last = [], b"", None
    for n, (ids, head, tail) in enumerate(parts):
        if head < 0:
            window, last = window + decoded(ids, ranks_file), ids if n == 0 else None
            continue
        # the start of a text is a place that agrees
        out.append(ids[:head] if n == 0 else again(window + decoded(ids[:head], ranks_file)))
        out.append(ids[head : len(ids) - tail])
        last = ids[len(ids) - tail :]
        window = decoded(last, ranks_file)
    if window:
        # and so is its end: open ids of one chunk alone are right as they are
        out.append(last if last is not None else again(window))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def shared_filter(rows: DataFrame, bits: int) -> bytes:
    """A table of 2 ** bits bits, set where the key of a chunk falls that occurs more than once; 8 MB whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for body in batch.column("text"):
                seen.update(map(key_of, chunks(body.as_py())))
            keys = np.frombuffer(b"".join(x[:8] for x in seen), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(seen.values(), pa.int64())], names=["key", "n"])

    marks = rows.select("text").mapInArrow(count, "key long, n long")
    again = marks.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("key").bitwiseAND(F.lit((1 << bits) - 1)).alias("bit"))
    words = again.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word")).toArrow()
    table = np.zeros(1 << (bits - 6), "<i8")
    table[words["at"].to_numpy()] = words["word"].to_numpy()
    return table.tobytes()


def is_set(table: np.ndarray, keys: list[bytes], bits: int) -> list[bool]:
    at = np.frombuffer(b"".join(k[:8] for k in keys), "<u8") & np.uint64((1 << bits) - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool).tolist()


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str = RANKS, filter_bits: int = FILTER_BITS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(id, n_tokens, ids, text): one row for each input row, ids as little-endian unsigned 32-bit numbers, text what they decode to.

    Null and empty texts have no ids. Rows that repeat an id, or are equal, are encoded each. A very long text is a
    bucket of its own, held whole by a task with its ids; a text without white space is one window, encoded at once.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "bpe")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), body.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bucket_bytes + 1)
    # a row's bucket follows from its id and text, so copies of a text spread over the buckets and every pass deals alike
    rows = rows.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(buckets)).alias("bucket"))
    shared = spark.sparkContext.broadcast(shared_filter(rows, filter_bits))

    def refer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, "<u8")
        for batch in batches:
            sent: dict[bytes, bytes | None] = {}
            refs: dict[tuple[int, bytes], bytes | None] = {}
            for text, bucket in zip(batch.column(0), batch.column(1).to_pylist()):
                found = chunks(text.as_py())
                keys = [key_of(c) for c in found]
                for chunk, key, again in zip(found, keys, is_set(table, keys, filter_bits)):
                    if again and (bucket, key) not in refs:
                        refs[bucket, key] = None if key in sent else chunk
                        sent[key] = None
            columns = [pa.array([b for b, _ in refs], pa.int64()), pa.array([k for _, k in refs], pa.binary()), pa.array(refs.values(), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "chunk"])

    refs = work.table(rows.select("text", "bucket").mapInArrow(refer, "bucket long, key binary, chunk binary"), "shared")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoded_chunk(c.as_py(), ranks_file) for c in batch.column(1)]
            columns = [batch.column(0), pa.array([x.astype("<u2").tobytes() for x, _, _ in found], pa.binary()), pa.array([h for _, h, _ in found], pa.int32()), pa.array([t for _, _, t in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "head", "tail"])

    each = refs.where("chunk is not null").groupBy("key").agg(F.first("chunk").alias("chunk"))
    known = work.table(each.mapInArrow(once, "key binary, ids binary, head int, tail int"), "chunks")
    sent = refs.select("bucket", "key").distinct().join(known, "key")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[int, list] = {}
            for doc, text, bucket in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                held.setdefault(bucket, []).append((doc, text.as_py()))
            blobs = [b"".join(x for _, x in of) for of in held.values()]
            columns = [
                pa.array(held, pa.int64()), pa.array([[d for d, _ in of] for of in held.values()], pa.list_(pa.int64())), pa.array([[len(x) for _, x in of] for of in held.values()], pa.list_(pa.int64())),
                pa.array([pa.compress(x, "zstd", asbytes=True) for x in blobs], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "docs", "sizes", "blob"])

    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def assemble(held: pa.Table, found: pa.Table) -> pa.Table:
        columns = (found["key"].to_pylist(), found["ids"].to_pylist(), found["head"].to_pylist(), found["tail"].to_pylist())
        ready = {k: (np.frombuffer(i, "<u2").astype(np.uint32), h, t) for k, i, h, t in zip(*columns)}
        out: list[list] = [[], [], [], []]
        for docs_, sizes, blob in zip(held["docs"].to_pylist(), held["sizes"].to_pylist(), held["blob"]):
            blob = pa.decompress(blob.as_py(), sum(sizes), "zstd", asbytes=True)
            at = 0
            for doc, n in zip(docs_, sizes):
                parts, own = [], []
                for chunk in chunks(blob[at : at + n]):
                    if (part := ready.get(key_of(chunk))) is None:
                        own.append(chunk)
                        continue
                    if own:
                        parts.append(encoded_chunk(b"".join(own), ranks_file))
                        own = []
                    parts.append(part)
                if own:
                    parts.append(encoded_chunk(b"".join(own), ranks_file))
                at += n
                ids = joined(parts, ranks_file)
                for column, value in zip(out, (doc, len(ids), ids.astype("<u4").tobytes(), decoded(ids, ranks_file).decode("utf-8", "replace"))):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types)], schema=schema)

    parked = rows.mapInArrow(pack, "bucket long, docs array<long>, sizes array<long>, blob binary")
    return parked.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(assemble, "id long, n_tokens long, ids binary, text string")


def decode(rows: DataFrame, ids_col: str = "ids", ranks_file: str = RANKS) -> DataFrame:
    """rows with decoded, the text of ids (little-endian unsigned 32-bit numbers); null stays null, bytes that are no UTF-8 are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decoded(np.frombuffer(x, "<u4"), ranks_file).decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string")
