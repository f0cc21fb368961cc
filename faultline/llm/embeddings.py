"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking.

Vectors are taken as points of the unit sphere and each label's mean is subtracted, so that a common direction of all
vectors doesn't fill the bits. Rotations that quantise the rest with least loss are learned on a bounded sample
(iterative quantisation, from several starts), and the signs of a rotated vector are balanced bits. A label's code has
so many bits that its substrings, one for each table, have about log2(n / BLOCK) bits, n being the label's number of
vectors of one length, and so many substrings that a pair at the threshold, whose bits differ with a probability that
follows from the threshold and the label's mean, agrees in none of them with probability MISS at most. Tables are
looked up by equality: a table more costs one row, the neighbours of a substring one for each bit of it. Vectors that
agree in one table of one label meet there, and their cosine is computed from the original vectors. A pair counts in
the first table where it meets. A bucket with many vectors is dealt to block pairs, and a task returns link counts and
a spanning forest, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Workspace, connected_components, drawn

SAMPLE = 20_000
BLOCK = 32
BUCKET = 256
MISS = 0.02
GROUP_ROWS = 4_000
BITS = 64


def normal(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def quantiser(sample: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Principal directions of centred vectors, rotated so that signs lose least (iterative quantisation)."""
    _, vectors = np.linalg.eigh(sample.T @ sample)
    basis = vectors[:, ::-1][:, :BITS]
    flat = sample @ basis
    rotation = np.linalg.qr(np.random.default_rng((7, seed)).normal(size=(basis.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(flat @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ flat)
        rotation = (left @ right).T
    return basis @ rotation


@cache
def unlearned(length: int, seed: int) -> np.ndarray:
    """An orthogonal matrix for vectors of a length that the sample has none of."""
    return np.linalg.qr(np.random.default_rng((11, length, seed)).normal(size=(length, length)))[0][:, :BITS]


def tables(n: int, mean_cosine: float, cosine: float) -> tuple[int, int]:
    """(bits of a substring, number of them) for a label of n vectors whose mean has this square.

    Two unit vectors at the threshold have, once the mean is taken from both, an inner product of (cosine - m) / (1 - m)
    about, and a bit tells them apart with probability angle / pi. Where the tables would compare as many pairs as there
    are, because nearly all vectors of a label are near each other, there are no bits and one table.
    """
    bits = max(0, math.ceil(math.log2(n / BLOCK))) if n > BLOCK else 0
    inner = (cosine - mean_cosine) / (1 - mean_cosine) if mean_cosine < 1 else 0.0
    agree = (1 - math.acos(max(0.0, min(1.0, inner))) / math.pi) ** bits
    if not bits or agree >= 1:
        return 0, 1
    number = math.ceil(math.log(MISS) / math.log1p(-agree))
    return (bits, number) if number <= 2**bits else (0, 1)


def codes(rest: np.ndarray, bits: int, number: int, rotations: list[np.ndarray]) -> np.ndarray:
    """One substring of each table, as int32, of centred vectors; without bits all share one."""
    if not bits:
        return np.zeros((len(rest), 1), dtype="<i4")
    on = np.concatenate([rest @ r >= 0 for r in rotations], axis=1)[:, : bits * number]
    return (on.reshape(len(rest), number, bits) @ (1 << np.arange(bits))).astype("<i4")


def rotations_for(length: int, bits: int, number: int, learned: tuple[int, list[np.ndarray]]) -> list[np.ndarray]:
    width = min(BITS, length)
    need = -(-bits * number // width)
    return learned[1][:need] if length == learned[0] else [unlearned(length, i) for i in range(need)]


def forest(adjacent: np.ndarray) -> np.ndarray:
    """For each row the smallest row that it reaches."""
    root = np.arange(len(adjacent))
    reach = adjacent | np.eye(len(adjacent), dtype=bool)
    while True:
        new = np.where(reach, root[None, :], len(root)).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def first_meetings(near: np.ndarray, code: np.ndarray, table: int) -> None:
    """Clears pairs that agree in a table before this one."""
    if table:
        i, j = np.nonzero(near)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near[a, b] = (code[a, :table] != code[b, :table]).all(1)


def label_spaces(nodes: DataFrame, cosine: float) -> DataFrame:
    """(label, size, n, mean, bits, number) of the vectors of each label and length; tasks add up what they have before the exchange."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds: dict[tuple, list[int]] = {}
            for i, kind in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                kinds.setdefault(kind, []).append(i)
            sums = [normal(batch.column(2).take(pa.array(at)).flatten().to_numpy().reshape(len(at), z)).sum(0) for (_, z), at in kinds.items()]
            columns = [pa.array([x for x, _ in kinds], pa.string()), pa.array([z for _, z in kinds], pa.int32()), pa.array([len(at) for at in kinds.values()], pa.int64()), pa.array(sums, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "size", "n", "sum"])

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tables(n, float(np.dot(m, m)), cosine) for n, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([b for b, _ in found], pa.int32()), pa.array([t for _, t in found], pa.int32())], names=["label", "size", "n", "mean", "bits", "number"])

    parts = nodes.select("label", "size", "v").mapInArrow(add, "label string, size int, n long, sum array<double>")
    sums = parts.select("label", "size", "n", F.posexplode("sum").alias("at", "x")).groupBy("label", "size", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    cells = F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x"))))
    means = sums.groupBy("label", "size").agg(F.first("n").alias("n"), F.transform(cells, lambda c: c["x"]).alias("mean"))
    return means.mapInArrow(plan, "label string, size int, n long, mean array<double>, bits int, number int")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.93, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component): one row for each input row.

    Rows link when their labels are equal and not null and their cosine, in double precision, reaches the
    threshold, as far as the index finds the pair. Vectors that are null, empty, zero, or that hold a null or
    non-finite component link with nothing, vectors of different lengths not with each other. Equal vectors of a
    label are one node with a count. Rows that repeat an id link with each other like any two rows. Rotations are
    learned on at most about `sample` vectors, of the most frequent length; vectors of another length get rotations that
    are not learned. Other columns are ignored.
    """
    work = Workspace(vectors.sparkSession, "embeddings")
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), label.alias("label"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", odd) & F.exists("v", lambda x: x != 0)
    rows = work.table(rows.select("id", "label", F.when(usable, F.col("v")).alias("v")), "rows")
    # -0.0 and 0.0 are one number in a grouping key, so equal vectors meet whatever the sign of a zero
    nodes = rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("k"), F.min("id").alias("least"))
    # written, a node keeps its number
    nodes = work.table(nodes.select(F.monotonically_increasing_id().alias("node"), "*", F.size("v").alias("size")), "nodes")
    spaces = work.table(label_spaces(nodes, cosine), "spaces")
    need = spaces.where("bits > 0").groupBy("size").agg(F.sum("n").alias("c"), F.max(F.col("bits") * F.col("number")).alias("bits")).orderBy(F.desc("c"), "size").limit(1).collect()
    learned: tuple[int, list[np.ndarray]] = (0, [])
    if need:
        length = need[0]["size"]
        chosen = drawn(nodes.where(F.col("size") == length), sample, "v").join(spaces.where("bits > 0").select("label", "size", "mean"), ["label", "size"]).select("node", "v", "mean").collect()
        chosen.sort(key=lambda r: r.node)
        rest = normal(np.array([r.v for r in chosen])) - np.array([r["mean"] for r in chosen]) if chosen else np.zeros((0, length))
        learned = length, [quantiser(rest, i) for i in range(-(-need[0]["bits"] // min(BITS, length)))]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, size, k, values, mean, bits, number = (batch.column(i) for i in range(8))
            kinds: dict[tuple, list[int]] = {}
            for i, kind in enumerate(zip(label.to_pylist(), size.to_pylist(), bits.to_pylist(), number.to_pylist())):
                kinds.setdefault(kind, []).append(i)
            code, unit = [b""] * batch.num_rows, [b""] * batch.num_rows
            for (_, z, w, t), at in kinds.items():
                x = normal(values.take(pa.array(at)).flatten().to_numpy().reshape(len(at), z))
                rest = x - mean[at[0]].values.to_numpy()
                for i, c, u in zip(at, codes(rest, w, t, rotations_for(z, w, t, learned)), x.astype("<f8")):
                    code[i], unit[i] = c.tobytes(), u.tobytes()
            parts = pa.array([np.frombuffer(c, "<i4") for c in code], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([node, label, size, parts, pa.array(code, pa.binary()), pa.array(unit, pa.binary()), k], names=["node", "label", "size", "parts", "code", "unit", "k"])

    coding = nodes.join(spaces, ["label", "size"]).select("node", "label", "size", "k", "v", "mean", "bits", "number")
    coding = work.table(coding.mapInArrow(coded, "node long, label string, size int, parts array<int>, code binary, unit binary, k long"), "codes")
    spread = coding.select("node", "label", "size", F.posexplode("parts").alias("t", "part"))
    # how many blocks a bucket needs; only buckets of two or more go on
    counts = spread.groupBy("label", "size", "t", "part").count().where("count > 1")
    counts = counts.withColumn("blocks", F.ceil(F.col("count") / BUCKET).cast("int"))
    met = spread.join(counts, ["label", "size", "t", "part"])
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("bucket", F.xxhash64("label", "size", "t", "part", F.least("mine", "other"), F.greatest("mine", "other")))
    met = work.table(met.select("bucket", "t", "mine", "other", "node"), "met")
    total = max(1, met.count() // GROUP_ROWS)
    met = met.join(coding.select("node", "label", "code", "unit", "k"), "node")
    met = met.select(F.pmod("bucket", F.lit(total)).alias("deal"), "bucket", "t", "mine", "other", "node", "label", "code", "unit", "k")
    out = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def rerank(table: pa.Table) -> pa.Table:
        bucket, t, mine, other, node, k = (table[c].to_numpy() for c in ("bucket", "t", "mine", "other", "node", "k"))
        units, parts = table["unit"].to_pylist(), table["code"].to_pylist()
        # the label, the length and the table stand beside the bucket's hash, so no two buckets are taken for one
        _, label = np.unique(np.array(table["label"].to_pylist(), dtype=object), return_inverse=True)
        keys = np.stack([bucket, label, np.array([len(u) for u in units], dtype=np.int64), t])
        order = np.lexsort(keys)
        edges = np.flatnonzero((np.diff(keys[:, order]) != 0).any(0)) + 1
        found: list[list[np.ndarray]] = [[], [], []]
        for at in np.split(order, edges):
            if len(at) < 2:
                continue
            unit = np.frombuffer(b"".join(units[i] for i in at), "<f8").reshape(len(at), -1)
            near = unit @ unit.T >= cosine
            if mine[at[0]] != other[at[0]] or (mine[at] != mine[at[0]]).any():
                near &= mine[at][:, None] != mine[at][None, :]
            np.fill_diagonal(near, False)
            first_meetings(near, np.frombuffer(b"".join(parts[i] for i in at), "<i4").reshape(len(at), -1), int(t[at[0]]))
            linked = near.any(1)
            if linked.any():
                root = forest(near)
                for column, value in zip(found, (node[at], node[at][root], near @ k[at])):
                    column.append(value[linked])
        return pa.table([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in found], schema=out)

    links = work.table(met.groupBy("deal").applyInArrow(rerank, "node long, root long, links long"), "links")
    roots = connected_components(links.select(F.col("node").alias("src"), F.col("root").alias("dst")), work)
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "label", "v", "k", "least").join(degree, "node", "left").join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = work.table(named.join(least, "root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"), "component"), "named")
    done = rows.join(named, ["label", "v"], "left")
    return done.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component"))
