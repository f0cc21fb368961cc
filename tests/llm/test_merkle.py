import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from faultline.llm import merkle, registry


def sha(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """All levels from the leaves to the one root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def beside(levels, at):
    """(left, right) siblings of a leaf, level by level."""
    for level in levels[:-1]:
        first = at // 3 * 3
        yield level[first:at], level[at + 1 : first + 3]
        at //= 3


def plain(rows):
    """A row for each document (doc_id, source, lang, n_chars, text), as the contract says, one after the other."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0], leaf_of(r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    trunk = tree([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for at, (_, doc, leaf, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            way = [*beside(trees[s], at), *beside(trunk, place)]
            text = row[4]
            if doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf_of((*row[:4], text))
            for left, right in way:
                node = sha("".join(left) + node + "".join(right))
            root = trunk[-1][0]
            out.append((doc, leaf, trees[s][-1][0], root, sha("".join(x for pair in way for part in pair for x in part)), node, node == root))
    return sorted(out, key=str)


def found(rows):
    return sorted(((r.id, r.leaf, r.subroot, r.root, sha(r.siblings), r.folded, r.folded == r.root) for r in rows), key=str)


@pytest.mark.parametrize("height", [1, 2, 3, 7])
def test_every_path_of_a_block(height):
    for n in (1, 2, 3, 4, 5, 8, 9, 10, 26, 27, 28, 80, 81, 82, 200):
        leaves = [sha(str(i)) for i in range(min(n, 3**height))]
        own = merkle.height_of(n, height)
        levels = tree(leaves)
        while len(levels) <= own:
            levels.append([sha(levels[-1][0])])
        assert merkle.top(leaves, own) == levels[own][0]
        for at, (siblings, turns) in enumerate(merkle.walk(leaves, own)):
            assert siblings == "".join(x for pair in list(beside(levels[: own + 1], at)) for part in pair for x in part)
            assert merkle.fold(leaves[at], siblings, turns) == levels[own][0]


def test_stacks_stay_small(monkeypatch):
    """A stack holds two open nodes a level and the three of its run."""
    most = 0
    step = merkle.Treehash.step

    def counted(self):
        nonlocal most
        step(self)
        most = max(most, len(self.nodes))

    monkeypatch.setattr(merkle.Treehash, "step", counted)
    list(merkle.walk([str(i) for i in range(3**6)], 6))
    assert most <= 3 + 2 * 6


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, leaf int, root string"


@pytest.mark.parametrize("height", [1, 2, 7])
def test_equal_to_plain(spark, height):
    rng = random.Random(height)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "a", "ä", "=", "-", "hot", "hot", "hot"]), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "x\ny", "\n", "é\n\n", "x" * 9000])) for _ in range(150)]
    rows += [rows[0], rows[0], (7, "lone", "en", 1, "a\nb")]
    docs = spark.createDataFrame([(*r, "z", 1, "z") for r in rows], SCHEMA)
    got = merkle.manifest(docs, given=merkle.without_line_feeds(docs), height=height).collect()
    assert found(got) == plain(rows)
    assert all(merkle.fold(r.leaf, r.siblings, r.turns) == r.root for r in got)


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "", 1, "")], SCHEMA)
    assert found(merkle.manifest(docs, given=merkle.without_line_feeds(docs)).collect()) == plain([(1, None, None, None, None)])
    assert merkle.manifest(docs.limit(0)).collect() == []


def test_query(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = registry.op13_manifest(spark, root)
    mine = sorted(map(tuple, got.collect()), key=str)
    assert mine == plain(rows)
    assert {r[-1] for r in mine} == {True, False}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    sql = db.execute(registry.OP13_SQL)
    assert [c[0] for c in sql.description] == got.columns
    assert sorted(sql.fetchall(), key=str) == mine
