"""Near-duplicates by the Jaccard similarity of word shingles: fingerprints find candidates, the sets decide.

Candidates are the members of a bucket: of a fingerprint, of two fingerprints that Golay keys link at three bits, or
of a band of minimum hashes. Fingerprints at three bits reach only pairs near 1; of pairs at 0.8 the bands miss one in
4,500 (16 bands of 4). In each bucket all sets are compared with its smallest one, then only those pairs that are not
in one component already, so a large group of near copies costs one comparison for each. A bucket that stays open
with more than CROWD members (unlike documents around one common passage, say) isn't paired: its members meet again
under their rarest shingles. Two sets of similarity t share one of the n - ceil(t * n) + 1 rarest of each, so this
loses no pair, and a common passage is no key of a set that has much else. There the join also compares parity bits
of the sets, which bound their difference from below. Only components are exact, not links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm import simhash
from faultline.llm.common import Workspace, connected_components

BANDS, ROWS = 16, 4
CHUNK = 1 << 14
PAIRS_A_SALT = 1_000
CROWD = 16
BROADCAST_IDS = 1_000_000
CELLS = 1 << 16
PARITIES = tuple(f"p{i}" for i in range(8))
MASKS, ODD, MIX = (np.random.default_rng(s).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for s in (21, 22, 23))


def grams(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else (b" ".join(words),)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), CHUNK):
        least = np.minimum(least, ((hashes[i : i + CHUNK, None] ^ MASKS) * (ODD | np.uint64(1))).min(0))
    return (least * (MIX | np.uint64(1)) ^ MIX).reshape(BANDS, ROWS).sum(1, dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """For each of 512 classes of hashes, whether the set holds an odd number of them; a shingle that two sets don't share turns one bit."""
    odd = np.bincount((hashes.view(np.uint64) >> np.uint64(55)).astype(np.int64), minlength=64 * len(PARITIES)).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def row_hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def texts_of(part: pa.RecordBatch, column: int) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid and len(x.as_buffer() or b"") else b"" for x in part.column(column)]


def node_names(found: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in found], dtype=np.uint64).view(np.int64)


def sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, rid, node, n, fp, bands) of each row; rid hashes id and text, node names the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                texts = texts_of(part, 2)
                found = [grams(x, width) for x in texts]
                fp = np.array([simhash.fingerprint(x, width) for x in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(node_names(found)), pa.array([len(g) for g in found], pa.int32()), pa.array(fp), pa.array([bands(g) for g in found], pa.list_(pa.int64()))],
                    names=["id", "rid", "node", "n", "fp", "bands"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, rid long, node long, n int, fp long, bands array<long>")


def whole_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, n, grams) of the rows whose rid is in wanted: the shingles' hashes, 8 bytes each, of those sets that may meet another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                found = [grams(x, width) for x in texts_of(batch.slice(lo, 1024), 0)]
                yield pa.RecordBatch.from_arrays([pa.array(node_names(found)), pa.array([len(g) for g in found], pa.int32()), pa.array([g.view(np.int64) for g in found], pa.list_(pa.int64()))], names=["node", "n", "grams"])

    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted  # 8 bytes each
    rows = docs.select(row_hash(id_col, text_col).alias("rid"), F.col(text_col).cast("string").alias("text")).join(few, "rid", "left_semi")
    return rows.select("text").mapInArrow(run, "node long, n int, grams array<long>")


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Those (a, b) whose sets reach the similarity; held (node, n, grams) has each set once. A node of many pairs is dealt to several tasks."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_SALT).cast("int").alias("salts")).where("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    left = held.select(F.col("node").alias("a"), F.col("grams").alias("ga")).join(pairs.select("a").distinct(), "a", "left_semi").join(many, "a", "left")
    left = left.select("a", "ga", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
    both = dealt.join(held.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").join(left, ["a", "salt"])
    common = F.size(F.array_intersect("ga", "gb"))
    return both.where(common / (F.size("ga") + F.size("gb") - common) >= similarity).select("a", "b")


def alike(x: str, y: str, similarity: float):
    """Whether sets of two sizes can reach the similarity."""
    return F.least(x, y) >= F.greatest(x, y) * F.lit(similarity) - 1e-9


def starred(keys: DataFrame, order: Column, similarity: float) -> DataFrame:
    """(a, b): each member of a key with the key's first member by an order."""
    hubs = keys.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    met = keys.join(hubs, "key").where((F.col("node") != F.col("hub.node")) & alike("n", "hub.n", similarity))
    return met.select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b")).distinct()


def still_open(keys: DataFrame, links: DataFrame, work: Workspace) -> DataFrame:
    """keys (key, node, ...) with root and members, of the keys whose members lie in several components."""
    roots = connected_components(links, work, "a", "b")
    named = keys.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    return named.join(parts.select("key", "members"), "key")


def paired(members: DataFrame, similarity: float, ranked: bool = False) -> DataFrame:
    """(a, b): members of one key in different components.

    Where members have the place of the key among their shingles from the rarest on, the first key that two sets
    share bounds what they can share; keys after it bound it further, so a pair that fails here fails everywhere. Sets
    of similarity t differ in (n_a + n_b) * (1 - t) / (1 + t) shingles at most, so in no more parities.
    """
    side = lambda s: members.select("key", *(F.col(c).alias(c + s) for c in ("node", "n", "root") + ("place", *PARITIES) * ranked))
    test = (F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & alike("n_a", "n_b", similarity)
    if ranked:
        most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
        test &= most * F.lit(1 + similarity) >= (F.col("n_a") + F.col("n_b")) * F.lit(similarity) - 1e-9
        apart = reduce(add, (F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES))
        test &= apart * F.lit(1 + similarity) <= (F.col("n_a") + F.col("n_b")) * F.lit(1 - similarity) + 1e-9
    return side("_a").join(side("_b"), "key").where(test).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node, n, place, parities): each set under the rarest of its shingles, so many that similar sets share one.

    Any one order of all shingles loses no pair. Ours counts shingles in CELLS cells by hash, a table of fixed size, and
    goes by a shingle's cell, then by its value: what many sets share comes late.
    """
    cells = sets.select(F.explode("grams").alias("g")).groupBy(F.pmod("g", F.lit(CELLS)).alias("cell")).agg(F.count("*").alias("n"))
    counts = np.zeros(CELLS, dtype=np.int64)
    for r in cells.collect():  # CELLS rows at most
        counts[r.cell] = r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in range(4 + len(PARITIES))]
            for node, g in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = g.values.to_numpy()
                n = len(x)
                most = n - math.ceil(n * similarity - 1e-9) + 1
                key = x[np.lexsort((x, counts[x % CELLS]))[:most]]
                same = (np.full(most, v) for v in parities(x))
                for column, value in zip(columns, (key, np.full(most, node), np.full(most, n), np.arange(most), *same)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["key", "node", "n", "place", *PARITIES])

    return sets.select("node", "grams").mapInArrow(run, "key long, node long, n long, place long" + "".join(f", {p} long" for p in PARITIES))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """(id, rid, root, component): one row for each input row, rid hashing its id and text; rows link when the Jaccard similarity reaches the given one.

    Rows with one set are one node, those without words too. A null id takes part but names no component unless all
    of its members' ids are null. Of a very long text a task holds the text and 8 bytes for each distinct shingle.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    # each round of components has a folder of its own; all go when the result is written
    work, *rounds = (Workspace(spark, "shingles") for _ in range(4))
    rows = work.table(sets(docs, id_col, text_col, width), "rows")
    nodes = work.table(rows.where("n > 0").select("node", "n", "fp", "bands", "rid").dropDuplicates(["node"]), "nodes")
    golay = work.table(simhash.links(nodes.select("fp").distinct(), work), "golay")
    work.drop("keys")
    ends = golay.withColumn("key", F.xxhash64("src", "dst"))
    ends = ends.select("key", F.col("src").alias("fp")).union(ends.select("key", F.col("dst").alias("fp")))
    keys = nodes.select("node", "n", F.explode("bands").alias("key")).union(nodes.select("node", "n", F.xxhash64("fp").alias("key")))
    keys = work.table(keys.union(nodes.join(ends, "fp").select("node", "n", "key")).select("key", "node", "n"), "filed")
    # only sets that stand beside another under some key are ever compared
    met = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    wanted = nodes.select("node", "rid").join(keys.join(met, "key").select("node").distinct(), "node").select("rid")
    wanted = work.table(wanted.distinct(), "wanted")
    held = work.table(whole_sets(docs, wanted, id_col, text_col, width).dropDuplicates(["node"]), "held")
    seen = work.table(starred(keys, F.col("node"), similarity), "star")
    links = work.table(verified(seen, held, similarity), "first")
    members = work.table(still_open(keys, links, rounds[0]), "open")
    rest = paired(members.where(F.col("members") <= crowd), similarity)
    dense = work.table(members.where(F.col("members") > crowd).select("node").distinct(), "crowd")
    if dense.limit(1).count():
        rare = work.table(rarest(held.join(dense, "node", "left_semi"), similarity), "rare")
        # other hubs than before, and another one for each key
        more = work.table(starred(rare, F.xxhash64("key", "node"), similarity).join(seen, ["a", "b"], "left_anti"), "more")
        links = work.table(links.union(verified(more, held, similarity)), "second")
        rest = rest.union(paired(still_open(rare, links, rounds[1]), similarity, ranked=True)).distinct()
        seen = seen.union(more)
    rest = work.table(rest.join(seen, ["a", "b"], "left_anti"), "rest")
    links = work.table(links.union(verified(rest, held, similarity)), "links")
    roots = connected_components(links, rounds[2], "a", "b")
    ended = rows.select("id", "rid", "node").join(roots, "node", "left").select("id", "rid", F.coalesce("root", "node").alias("root"))
    ended = work.table(ended, "roots")
    least = ended.groupBy("root").agg(F.min("id").alias("component"))
    out = Workspace(spark, "near").table(ended.join(least, "root").select("id", "rid", "root", "component"), "components")
    for used in (work, *rounds):
        used.drop()
    return out


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of docs for each component: that of the smallest id, nulls last.

    Of different texts under that id in one component the one of smallest hash stays; rows equal in id and text are
    one document, and one of them stays. Rows of one id in different components all stay.
    """
    found = near_duplicates(docs, id_col, text_col, width, similarity)
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("o"), "id", "rid")).alias("x")).select("x.id", "x.rid")
    same = found.groupBy(F.col("id").alias("keep_id"), F.col("rid").alias("keep_rid")).agg(F.count("*").alias("keep_rows"))
    keep = same.join(best, F.col("keep_id").eqNullSafe(F.col("id")) & (F.col("keep_rid") == F.col("rid")), "left_semi")
    rows = docs.join(keep, (row_hash(id_col, text_col) == F.col("keep_rid")) & F.col(id_col).cast("long").eqNullSafe(F.col("keep_id")))
    one, many = rows.where("keep_rows = 1"), rows.where("keep_rows > 1").dropDuplicates([id_col, text_col])
    return one.unionByName(many).select(*docs.columns)
