"""Removal of repeated passages by difference-cover anchors.

Positions whose remainder modulo 13 is in {0, 1, 3, 9} form a difference cover: any two positions can be shifted
by the same 0 to 12 words onto it. So two equal windows of 20 words hold equal anchors of 8 words, both at cover
positions. The passes over the documents, which are kept as batches of a few MB:

1. hash anchors at cover positions only, and find those in more than one batch;
2. extend: only windows that hold such an anchor are hashed, reduced to the earliest of each batch, and compared
   across batches; all but the earliest are flagged;
3. drop every word under a flagged window.

Hashes travel as arrays, one for each batch and bucket, so a passage that half of all documents share is one
entry a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Workspace

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
BATCH_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20  # of texts, whose hashes a bucket takes
NO_ID = np.iinfo(np.int64).min


@cache
def constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    odd = rng.integers(0, 1 << 63, (2, WINDOW * 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[0], odd[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
LONG_WORD = 256


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """64 bits of each word: its bytes go in eight at a time, each block mixed with all before it. The two kinds share nothing but the bytes.

    Words of over LONG_WORD bytes go through a cryptographic hash, one by one.
    """
    seed = np.uint64(SEEDS[which])
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mixed(sizes.astype(np.uint64) * seed + seed)
    at, block = np.flatnonzero(sizes <= LONG_WORD), 0
    while len(at):
        left = np.minimum(sizes[at] - 8 * block, 8).astype(np.uint64)
        value = eight[starts[at] + 8 * block] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * left))
        out[at] = mixed((out[at] ^ value) * seed + np.uint64(block))
        block += 1
        at = at[sizes[at] > 8 * block]
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        word = data[starts[i] : starts[i] + sizes[i]].tobytes()
        out[i] = int.from_bytes(blake2b(word, digest_size=8, salt=bytes([which])).digest(), "little")
    return out


class Words:
    """All words of a batch: hash, document, and place in its document."""

    def __init__(self, sizes: np.ndarray, body: bytes):
        data = np.frombuffer(body, dtype=np.uint8)
        n, ends = len(data), np.cumsum(sizes)
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, dtype=bool)
        edge[ends] = True
        edge[0] = edge[n] = True
        gap = np.concatenate([[True], ~solid, [True]])
        starts = np.flatnonzero(solid & (edge[:-1] | gap[:-2]))
        stops = np.flatnonzero(solid & (edge[1:] | gap[2:])) + 1
        self.hash = word_hashes(data, starts, stops - starts, 0)
        self.second = lambda: word_hashes(data, starts, stops - starts, 1)
        self.doc = np.searchsorted(ends, starts, side="right")
        self.count = np.bincount(self.doc, minlength=len(sizes))
        self.first = np.cumsum(self.count) - self.count
        self.place = np.arange(len(starts)) - self.first[self.doc]

    def windows(self, width: int, second: bool = False) -> np.ndarray:
        """A hash for each start; starts near a document's end run over it and are for the caller to leave out."""
        words = self.second() if second else self.hash
        n = max(0, len(words) - width + 1)
        out = np.zeros(n, dtype=np.uint64)
        for k, c in enumerate(constants()[second][:width]):
            out += words[k : k + n] * c
        return mixed(out)

    def fits(self, width: int) -> np.ndarray:
        n = max(0, len(self.hash) - width + 1)
        return self.place[:n] + width <= self.count[self.doc[:n]]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, 48-bit and bucket hashes together) at cover positions of documents that hold a window."""
        width = window - PERIOD + 1
        ok = self.fits(width)
        n = len(ok)
        at = np.flatnonzero(ok & np.isin(self.place[:n] % PERIOD, COVER) & (self.count[self.doc[:n]] >= window))
        return at, self.windows(width)[at]


def unpack(row: dict) -> tuple[np.ndarray, bytes]:
    import zstandard

    return np.frombuffer(row["sizes"], "<i8"), zstandard.decompress(row["body"], max_output_size=1 << 31)


def batched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(batch, bytes, ids, sizes, body): documents in batches of about BATCH_BYTES, their texts compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, serial = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), [x.as_buffer().to_pybytes() if x.is_valid and len(x.as_buffer() or b"") else b"" for x in batch.column(1)], 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and (stop == at or size + len(texts[stop]) <= BATCH_BYTES):
                    size += len(texts[stop])
                    stop += 1
                sizes = np.array([len(t) for t in texts[at:stop]], "<i8").tobytes()
                row = [[serial], [size], [ids[at:stop]], [sizes], [pack.compress(b"".join(texts[at:stop]))]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()))], names=["batch", "bytes", "ids", "sizes", "body"]
                )
                at, serial = stop, serial + 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "batch long, bytes long, ids array<long>, sizes binary, body binary")


def split_by(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(bucket, kind="stable")
    held, starts = np.unique(bucket[order], return_index=True)
    for b, lo, hi in zip(held.tolist(), starts, [*starts[1:], len(order)]):
        yield b, [c[order[lo:hi]].tobytes() for c in columns]


def low48(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def from48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def repeated_anchors(parked: DataFrame, window: int, buckets: int) -> DataFrame:
    """(batch, shared): for each batch, its anchor hashes that another batch holds too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                h = np.unique(Words(*unpack(row)).anchors(window)[1])
                out = [(b, row["batch"], blob) for b, (blob,) in split_by((h >> np.uint64(40)).astype(np.int64) * buckets >> 24, low48(h))]
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "batch", "h"), x)) for x in out], schema=sent)

    sent = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("h", pa.binary())])
    back = pa.schema([("batch", pa.int64()), ("shared", pa.binary())])

    def meet(table: pa.Table) -> pa.Table:
        sizes = np.array([len(x) // 6 for x in table["h"].to_pylist()])
        h, inverse, count = np.unique(from48(joined(table["h"])), return_inverse=True, return_counts=True)
        shared, out, at = count[inverse] > 1, [], 0
        for batch, n in zip(table["batch"].to_pylist(), sizes):
            if shared[at : at + n].any():
                out.append({"batch": batch, "shared": low48(h[inverse[at : at + n]][shared[at : at + n]]).tobytes()})
            at += n
        return pa.Table.from_pylist(out, schema=back)

    rows = parked.select("batch", "sizes", "body").mapInArrow(emit, "bucket int, batch long, h binary")
    return rows.groupBy("bucket").applyInArrow(meet, "batch long, shared binary")


def repeated_windows(parked: DataFrame, shared: DataFrame, window: int, buckets: int) -> DataFrame:
    """(batch, starts): word positions in a batch of windows that start earlier in another batch."""
    sent = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("h", pa.binary()), ("g", pa.binary()), ("id", pa.binary()), ("place", pa.binary()), ("at", pa.binary())])
    back = pa.schema([("batch", pa.int64()), ("starts", pa.binary())])

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            words = Words(*unpack(row))
            at, h = words.anchors(window)
            known = np.unique(from48(joined(right["shared"])))
            low, same, count = np.unique(h & np.uint64((1 << 48) - 1), return_inverse=True, return_counts=True)
            hit = np.zeros(len(words.hash) + 1, dtype=np.int64)
            hit[at[((count > 1) | np.isin(low, known))[same]] + 1] = 1
            hit = np.cumsum(hit)
            ok = words.fits(window)
            begin = np.flatnonzero(ok)
            begin = begin[hit[begin + PERIOD] > hit[begin]]
            h1, h2 = words.windows(window)[begin], words.windows(window, True)[begin].astype("<u2")
            ids = np.array([NO_ID if i is None else i for i in row["ids"]], dtype="<i8")[words.doc[begin]]
            place = words.place[begin].astype("<u4")
            order = earliest_first(h1, h2, ids, place, begin)
            h1, h2, ids, place, begin = (x[order] for x in (h1, h2, ids, place, begin))
            new = is_new(h1, h2)
            cols = [x[new] for x in (h1, h2, ids, place, begin.astype("<u4"))]
            keep = np.lexsort((cols[3], cols[2]))
            cols = [x[keep] for x in cols]
            bucket = (cols[0] >> np.uint64(40)).astype(np.int64) * buckets >> 24
            out += [dict(zip(sent.names, (b, row["batch"], *blobs))) for b, blobs in split_by(bucket, *cols)]
        return pa.Table.from_pylist(out, schema=sent)

    def meet(table: pa.Table) -> pa.Table:
        sizes = [len(x) // 8 for x in table["h"].to_pylist()]
        if len(sizes) < 2:
            return pa.Table.from_pylist([], schema=back)
        h, g, ids, place, at = (np.frombuffer(joined(table[c]), t) for c, t in (("h", "<u8"), ("g", "<u2"), ("id", "<i8"), ("place", "<u4"), ("at", "<u4")))
        batch = np.repeat(np.array(table["batch"].to_pylist(), dtype=np.int64), sizes)
        order = earliest_first(h, g, ids, place, batch)
        late = order[~is_new(h[order], g[order])]
        return pa.Table.from_pylist([{"batch": b, "starts": blob} for b, (blob,) in split_by(batch[late], at[late])], schema=back)

    rows = parked.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(
        extend, "bucket int, batch long, h binary, g binary, id binary, place binary, at binary"
    )
    return rows.groupBy("bucket").applyInArrow(meet, "batch long, starts binary")


def earliest_first(h, g, ids, place, last) -> np.ndarray:
    return np.lexsort((last, place, ids, g, h))


def is_new(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), dtype=bool)
    out[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): one row for each input row, kept being its words that stay, joined by a space.

    A word goes if a window over it also starts earlier, in a row of smaller id or before in the same row. Windows
    are judged on the input. A null id counts as the smallest; of rows that repeat an id, one comes first. Null and
    empty texts have no words. A row shorter than the window keeps all. A very long text is a batch of its own, held
    whole by a task with about 40 bytes a word. Other columns are ignored.
    """
    if not PERIOD < window <= WINDOW * 8:
        raise ValueError(f"window must be over {PERIOD} and at most {WINDOW * 8}")
    spark = docs.sparkSession
    work = Workspace(spark, "substring")
    parked = work.table(batched(docs, id_col, text_col), "batches")
    # a bucket takes the hashes of so many bytes of text, however many there are in all
    total = parked.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    buckets = min(1 << 24, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_BYTES))
    shared = work.table(repeated_anchors(parked, window, buckets), "anchors")
    late = work.table(repeated_windows(parked, shared, window, buckets), "windows")
    work.drop("anchors")
    done = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for row in left.to_pylist():
            sizes, body = unpack(row)
            words = Words(sizes, body)
            begin = np.flatnonzero(words.fits(window))
            h1, h2 = words.windows(window)[begin], words.windows(window, True)[begin].astype("<u2")
            ids = np.array([NO_ID if i is None else i for i in row["ids"]], dtype="<i8")[words.doc[begin]]
            order = earliest_first(h1, h2, ids, words.place[begin], begin)
            edges = np.zeros(len(words.hash) + 1, dtype=np.int64)
            flagged = np.union1d(begin[order[~is_new(h1[order], h2[order])]], np.frombuffer(joined(right["starts"]), "<u4").astype(np.int64))
            edges[flagged] += 1
            edges[flagged + window] -= 1
            keep = np.cumsum(edges[:-1]) == 0
            kept, at, stay = [], 0, keep.tolist()
            for size, first, n in zip(sizes.tolist(), words.first.tolist(), words.count.tolist()):
                kept.append(b" ".join(compress(body[at : at + size].split(), stay[first : first + n])).decode("utf-8", "replace"))
                at += size
            gone = np.bincount(words.doc[~keep], minlength=len(sizes))
            tables.append(pa.table([pa.array(row["ids"], pa.int64()), pa.array(words.count, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], schema=done))
        return pa.concat_tables(tables) if tables else done.empty_table()

    return parked.groupBy("batch").cogroup(late.groupBy("batch")).applyInArrow(finish, "id long, n_words long, n_removed long, kept string")
