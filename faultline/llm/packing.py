"""Packing of token sequences: concatenate all documents and cut.

Two passes. The first encodes every document once and writes its ids with their offset inside the partition. A
prefix sum over the partitions' totals gives each partition its global offset, and the second pass cuts the ids
into fixed windows. A document that crosses a window's edge gives one boundary record for each window it touches;
no window but the last is short, and no id is dropped or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import Workspace

SEQUENCE = 2048
END_ID = 1


def end_of_text() -> dict[str, int]:
    return {"<|endoftext|>": 50256}


@cache
def encoder(ranks_file: str):
    """Byte-level BPE of the vocabulary byte_bpe_50k.json, read as ranks: the same ids at a fifth of the time.

    The end-of-text string inside a text is its special id, as the vocabulary's own tokenizer has it.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks_file), "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding(ranks_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=end_of_text())
    if made.n_vocab > 1 << 16:
        raise ValueError("ids travel as 16-bit numbers; this vocabulary has more")
    return made


def encode(text: str, ranks_file: str) -> np.ndarray:
    return encoder(ranks_file).encode_to_numpy(text, allowed_special="all")


def encoded(docs: DataFrame, id_col: str, text_col: str, ranks_file: str) -> DataFrame:
    """(id, part, local, n, ids): ids as little-endian 16-bit numbers with the end id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts, starts, sizes, ids = batch.column(1), [], [], []
            for text in texts:
                found = encode(text.as_py() or "", ranks_file)
                ids.append(np.append(found, END_ID).astype("<u2").tobytes())
                starts.append(local)
                sizes.append(len(found) + 1)
                local += len(found) + 1
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["id", "part", "local", "n", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, part int, local long, n long, ids binary")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence: int = SEQUENCE,
    ranks_file: str = "byte_bpe_50k.tiktoken",
) -> DataFrame:
    """(id, start, length, doc_tokens, sequence_id, offset, ids): one row for each piece.

    ids holds the piece as little-endian unsigned 32-bit numbers. A null or empty text is the end id alone; rows
    that repeat an id are packed each on their own; an empty table gives no rows. A very long text is encoded whole by
    the task that reads it, with two bytes for each of its ids. Other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "packing")
    rows = work.table(encoded(docs, id_col, text_col, ranks_file), "encoded")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each partition of the input, so the window and the broadcast hold a few bytes a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = rows.join(F.broadcast(bases), "part").select("id", (F.col("base") + F.col("local")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, at, n, ids in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                wide = np.frombuffer(ids.as_buffer(), dtype="<u2").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, sequence)
                    size = min(n - start, sequence - offset)
                    for column, value in zip(out, (doc, start, size, n, seq, offset, wide[start : start + size].tobytes())):
                        column.append(value)
                    start += size
            types = [pa.int64()] * 6 + [pa.binary()]
            names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return placed.mapInArrow(cut, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
