"""Merkle manifest of a table: a digest for each row, a tree for each group, one root over them, and a proof for each row.

A node is the digest of up to three neighbours' digests, so a tree is cut into aligned blocks of 3 ** HEIGHT leaves
whose inner levels need no other block. A task walks its block leaf by leaf: of each level it keeps the run of nodes
that the leaf is in, and treehash stacks make the next runs meanwhile, the one with the lowest open node first, so what
it holds beside the block grows with the height alone. Blocks' roots are the leaves of the next tree, and the groups'
roots those of the last; a block's path through them is joined to it once and appended to the paths of its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import Workspace

ARITY = 3
HEIGHT = 7
ROWS_A_RANGE = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of a row's fields: a dash for null, else its length in UTF-8, a colon and the value."""
    text = [c.cast("string") for c in fields]
    marked = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]
    return F.sha2(F.concat(*marked), 256)


class Treehash:
    """Makes the nodes of one run of a level: a leaf goes onto the stack at each step, and three of a height become one."""

    def __init__(self, level: int, first: int, leaves: list[str]):
        self.level, self.at, self.leaves = level, first, leaves
        self.end = min(first + ARITY ** (level + 1), len(leaves))
        self.heights: list[int] = []
        self.nodes: list[str] = []

    def done(self) -> bool:
        return self.at == self.end

    def lowest(self) -> int:
        return self.heights[-1] if self.heights else self.level

    def join(self, height: int, n: int) -> None:
        self.nodes[-n:] = [digest("".join(self.nodes[-n:]))]
        self.heights[-n:] = [height + 1]

    def step(self) -> None:
        self.nodes.append(self.leaves[self.at])
        self.heights.append(0)
        self.at += 1
        height = 0
        while height < self.level and len(self.heights) >= ARITY and self.heights[-ARITY] == height:
            self.join(height, ARITY)
            height += 1
        if self.at == len(self.leaves):
            # the block ends here: what is left of a run is hashed though it be fewer
            for height in range(self.level):
                if n := self.heights.count(height):
                    self.join(height, n)


def walk(leaves: list[str], height: int) -> Iterator[tuple[str, str]]:
    """(siblings, turns) of each leaf in turn, up to the given height: digests from left to right, level by level, and
    for each level two digits, the place in its run and the run's length."""

    def ready(ahead: Treehash) -> list[str]:
        while not ahead.done():
            ahead.step()
        return ahead.nodes

    def begun(level: int, first: int) -> Treehash | None:
        return Treehash(level, first, leaves) if first < len(leaves) else None

    spans = [ARITY ** (level + 1) for level in range(height)]
    runs = [ready(Treehash(level, 0, leaves)) for level in range(height)]
    ahead = [begun(level, spans[level]) for level in range(height)]
    places = [0] * height
    for at in range(len(leaves)):
        yield (
            "".join([x for run, own in zip(runs, places) for i, x in enumerate(run) if i != own]),
            "".join([f"{own}{len(run)}" for run, own in zip(runs, places)]),
        )
        busy = [x for x in ahead if x and not x.done()]
        for _ in range(height - 1):
            if not busy:
                break
            lowest = min(busy, key=Treehash.lowest)
            lowest.step()
            if lowest.done():
                busy.remove(lowest)
        for level in range(height):
            if (at + 1) % (spans[level] // ARITY):
                break
            places[level] += 1
            if (at + 1) % spans[level] == 0 and ahead[level]:
                runs[level], places[level] = ready(ahead[level]), 0
                ahead[level] = begun(level, at + 1 + spans[level])


def levels(n: int, most: int) -> int:
    """Levels above n nodes until one is left, at most those of a block."""
    height = 0
    while n > 1 and height < most:
        n, height = -(-n // ARITY), height + 1
    return height


def height_of(n: int, block: int) -> int:
    """Inner levels of a block of a tree of n leaves: its one block stops at a single node, a block among many at its own."""
    return block if n > ARITY**block else levels(n, block)


def top(leaves: list[str], height: int) -> str:
    """The node of the given height over a block, by one treehash stack."""
    if height == 0:
        return leaves[0]
    over = Treehash(height, 0, leaves)
    while not over.done():
        over.step()
    return over.nodes[0]


def fold(node: str, siblings: str, turns: str) -> str:
    """The root that a leaf's digest leads to by its proof."""
    at = 0
    for own, of in zip(turns[::2], turns[1::2]):
        left, right = at + 64 * int(own), at + 64 * (int(of) - 1)
        node = digest(siblings[at:left] + node + siblings[left:right])
        at = right
    return node


def numbered(rows: DataFrame, work: Workspace, name: str) -> DataFrame:
    """rows (g, o, id, leaf, given) with at, the place in group g by (o, leaf), and n, the group's size.

    Rows are dealt by ranges, so a large group is many tasks; each range counts its own rows of a group, and a prefix
    sum over the ranges of a group, a few numbers a range, gives where they begin.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS_A_RANGE + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, run, local = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            runs, places = [], []
            for g in batch.column("g").to_pylist():
                if g != group:
                    group, run, local = g, run + 1, 0
                runs.append(run)
                places.append(local)
                local += 1
            extra = [pa.array([part] * len(runs), pa.int64()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "run", "local"])

    ranged = rows.repartitionByRange(parts, "g", "o", "leaf").sortWithinPartitions("g", "o", "leaf").drop("o")
    ranged = work.table(ranged.mapInArrow(count, "g string, id long, leaf string, given string, part long, run long, local long"), f"{name}-ranged")
    sizes = ranged.groupBy("part", "run").agg(F.first("g").alias("of"), F.count("*").alias("size"))
    by = Window.partitionBy("of")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "run", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(by).alias("n"))
    return ranged.join(bases, ["part", "run"]).select("g", "id", "leaf", "given", (F.col("base") + F.col("local")).alias("at"), "n")


BLOCK = "g string, n long, block long, root string, ids array<long>, leaves array<string>, given array<string>"


def blocks_of(nodes: DataFrame, height: int) -> DataFrame:
    """A row for each aligned block of nodes (g, n, at, id, leaf, given): its root, and what it holds, in order."""
    size = ARITY**height
    schema = pa.schema(
        [("g", pa.string()), ("n", pa.int64()), ("block", pa.int64()), ("root", pa.string()), ("ids", pa.list_(pa.int64())), ("leaves", pa.list_(pa.string())), ("given", pa.list_(pa.string()))]
    )

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        leaves, n = table["leaf"].to_pylist(), table["n"][0].as_py()
        row = {"g": table["g"][0].as_py(), "n": n, "block": table["block"][0].as_py(), "root": top(leaves, height_of(n, height))}
        return pa.Table.from_pylist([row | {"ids": table["id"].to_pylist(), "leaves": leaves, "given": table["given"].to_pylist()}], schema=schema)

    return nodes.withColumn("block", F.floor(F.col("at") / size).cast("long")).groupBy("g", "block").applyInArrow(build, BLOCK)


def grown(nodes: DataFrame, work: Workspace, name: str, height: int) -> list[DataFrame]:
    """Tables of blocks from the leaves up, until every group's tree has one block; each has a 3 ** height-th of the rows of the one below."""
    size, out = ARITY**height, []
    while True:
        out.append(work.table(blocks_of(nodes, height), f"{name}-blocks{len(out)}"))
        open_ = out[-1].where(F.col("n") > size)
        if open_.isEmpty():
            return out
        none = F.lit(None)
        nodes = open_.select("g", F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("block").alias("at"), none.cast("long").alias("id"), F.col("root").alias("leaf"), none.cast("string").alias("given"))


def roots(tree: list[DataFrame], height: int) -> DataFrame:
    """(g, root) of every group."""
    out = None
    for blocks in tree:
        done = blocks.where(F.col("n") <= ARITY**height).select("g", "root")
        out = done if out is None else out.unionByName(done)
    return out


PROVED = "g string, at long, id long, leaf string, given string, subroot string, root string, siblings string, turns string"


def proved(tree: list[DataFrame], over: DataFrame, height: int) -> DataFrame:
    """PROVED rows of a tree's leaves; over (g, subroot, root, siblings, turns) is what lies above each group's root."""
    size = ARITY**height
    names = [x.split()[0] for x in PROVED.split(", ")]
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in PROVED.split(", ")]

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = list(walk(row["leaves"], height_of(row["n"], height)))
                n = len(own)
                columns = [
                    [row["g"]] * n, range(row["block"] * size, row["block"] * size + n), row["ids"], row["leaves"], row["given"], [row["subroot"]] * n, [row["root"]] * n,
                    [s + row["siblings"] for s, _ in own], [t + row["turns"] for _, t in own],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    above = None
    for blocks in reversed(tree):
        held = blocks.drop("root")
        joined = held.where(F.col("n") <= size).join(over, "g")
        if above is not None:
            up = above.select("g", F.col("at").alias("block"), "subroot", "root", "siblings", "turns")
            joined = joined.unionByName(held.where(F.col("n") > size).join(up, ["g", "block"]))
        above = joined.mapInArrow(paths, PROVED)
    return above


def proofs(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, given, subroot, root, siblings, turns) of rows (g, id, leaf, given), digests as hex text.

    Groups come in the order of g, null first; a group's rows by id, null first, repeated ids by their digest. A proof
    is the digests beside a leaf's way up, `siblings`, and for each level the place and the size of its run, `turns`;
    `fold` leads from a digest to the root. A block is held by a task, about 200 bytes a leaf, and a proof for each of
    its leaves; a text of any length is one digest. An empty table has no rows and no root.
    """
    work = Workspace(rows.sparkSession, "merkle")
    # a name that is never null and sorts as the group does
    key = F.coalesce(F.concat(F.lit("="), F.col("g").cast("string")), F.lit("-"))
    leaves = work.table(rows.select(key.alias("g"), F.col("id").cast("long").alias("o"), F.col("id").cast("long").alias("id"), "leaf", "given"), "leaves")
    tree = grown(numbered(leaves, work, "rows"), work, "rows", height)
    subroots = work.table(roots(tree, height), "subroots")
    none = F.lit(None).cast("string")
    groups = subroots.select(F.lit("").alias("g"), F.col("g").alias("o"), F.lit(None).cast("long").alias("id"), F.col("root").alias("leaf"), F.col("g").alias("given"))
    trunk = grown(numbered(groups, work, "groups"), work, "groups", height)
    root = roots(trunk, height).select("g", F.col("root").alias("subroot"), "root", F.lit("").alias("siblings"), F.lit("").alias("turns"))
    over = proved(trunk, root, height).select(F.col("given").alias("g"), F.col("leaf").alias("subroot"), "root", "siblings", "turns")
    return proved(tree, work.table(over, "over"), height).drop("g", "at")


def verified(proved_rows: DataFrame) -> DataFrame:
    """proofs() with folded, the root that `given`, or the leaf where it is null, leads to by the leaf's proof."""
    fields = proved_rows.schema

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = [given or own for given, own in zip(batch.column("given").to_pylist(), batch.column("leaf").to_pylist())]
            ends = [fold(*x) for x in zip(start, batch.column("siblings").to_pylist(), batch.column("turns").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.string())], names=[*batch.schema.names, "folded"])

    return proved_rows.mapInArrow(check, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", folded string")


def manifest(docs: DataFrame, given: Column | None = None, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """verified() rows of a table: a leaf for each row from its fields, a tree for each value of group_col.

    given replaces text_col where it is not null, and the row's proof is then checked against the changed row. Null
    fields are a dash; empty texts are not. Rows that repeat an id, or are equal, are leaves of their own. Columns that
    are not fields are ignored, whatever their names.
    """
    own = [F.col(c) for c in fields]
    changed = F.lit(None).cast("string") if given is None else F.when(given.isNotNull(), leaf([given if c == text_col else F.col(c) for c in fields]))
    rows = docs.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).alias("id"), leaf(own).alias("leaf"), changed.alias("given"))
    return verified(proofs(rows, height))


def without_line_feeds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text without its line feeds, for rows whose id, in decimal, has an even crc32 and whose text has one; else null."""
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return F.when(even & F.col(text_col).contains("\n"), F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
