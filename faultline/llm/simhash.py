"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a 23-bit word. Of three
segments that share at most three wrong bits, some two have at most one wrong bit each. So for every pair of
segments a fingerprint is filed under near keys of the first with its own key of the second, and sought under its own
key of the first with near keys of the second: up to 21 rows of either kind, and fingerprints within three bits meet
under at least one 26-bit key. The join checks the distance itself, so only true links leave it. Expected meetings
of n random fingerprints are n * n * 147 / 2^27, a thousand a fingerprint at 10^9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import golay
from faultline.llm.common import Workspace, connected_components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
MAX_BITS = 3
CHUNK = 1 << 18


def fingerprint(text: bytes, width: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else (b" ".join(words),)
    ones, total = np.zeros(64, dtype=np.int64), 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype="<u8")
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of each row; null and wordless texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(b, width) if b else 0 for b in (x.as_buffer().to_pybytes() if x.is_valid else b"" for x in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def crossed(near: np.ndarray, own: np.ndarray, pair: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of a pair's near keys of one segment with the own key of the other; each key of a row once."""
    new = np.ones(near.shape, dtype=bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    row = np.nonzero(new)[0]
    one, other = near[new].astype(np.int64), own[row].astype(np.int64)
    return row, (one << 13 | other if first else other << 13 | one) | pair << 26


def filed(fps: DataFrame, fp_col: str = "fp") -> DataFrame:
    """(fp, filed, sought): the keys of distinct fingerprints."""

    def arrays(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.Array:
        row, key = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[order].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                seg = [golay.keys((part >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.uint32)) for lo, n in SEGMENTS]
                kinds = [[crossed(seg[x][1], seg[y][0], p, first) for p, (x, y) in enumerate(pairs)] for pairs, first in ((PAIRS, True), ([(b, a) for a, b in PAIRS], False))]
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), *(arrays(k, len(part)) for k in kinds)], names=["fp", "filed", "sought"])

    return fps.select(F.col(fp_col).alias("fp")).mapInArrow(run, "fp long, filed array<int>, sought array<int>")


def links(fps: DataFrame, work: Workspace, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst) for each two distinct fingerprints within max_bits (at most three), src < dst.

    The keys are written once and read by both sides. Neither side is broadcast: their size follows the input. Of a
    key with many fingerprints adaptive execution splits the join.
    """
    if max_bits > MAX_BITS:
        raise ValueError("two segments with at most one wrong bit each are only certain up to three bits")
    keyed = work.table(filed(fps), "keys")
    own = keyed.select(F.col("fp").alias("src"), F.explode("filed").alias("key"))
    look = keyed.select(F.col("fp").alias("dst"), F.explode("sought").alias("key"))
    near = (F.col("src") < F.col("dst")) & (F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= max_bits)
    return own.join(look.hint("merge"), (own["key"] == look["key"]) & near).select("src", "dst").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component): one row for each input row.

    Rows with one fingerprint are one node, so copies never meet pairwise. Null and empty texts share fingerprint
    zero and are linked like any other. Rows that repeat an id keep one output row each; a null id takes part but
    names no component unless all of its members' ids are null. A very long text is hashed whole, its shingles' hashes
    held at once (8 bytes a word). Other columns are ignored, whatever their names.
    """
    work = Workspace(docs.sparkSession, "simhash")
    rows = work.table(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = work.table(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = work.table(links(distinct, work, max_bits), "links")
    work.drop("keys")
    roots = connected_components(found, work).select(F.col("node").alias("fp"), "root")
    labelled = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component"))
    labelled = work.table(labelled.join(least, "root").select("fp", "component"), "labelled")
    return rows.join(labelled, "fp").select("id", "fp", "component")
