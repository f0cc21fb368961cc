import numpy as np
import pytest
import xxhash

from faultline.llm import golay, simhash
from faultline.llm.common import Workspace

ROOT = "/root/testdata/sf0.001"


def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=3):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def test_golay_keys_cover_single_errors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 500, dtype=np.uint32)
    own, near = golay.keys(words)
    assert {len(np.unique(r)) for r in near} == {2, 7}
    for bit in range(23):
        other, _ = golay.keys(words ^ np.uint32(1 << bit))
        assert all(o in r for o, r in zip(other, near))
    assert len(np.unique(golay.keys(np.arange(1 << 14, dtype=np.uint32))[0])) <= 8192


def test_links_within_three_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for n in (1, 2, 3, 4):
            x = int(b)
            for bit in rng.choice(64, n, replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(np.array(sorted(fps), dtype=np.uint64).view(np.int64).tolist())
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), Workspace(spark, "t")).collect()}
    want = {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want and len(want) > 100
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), Workspace(spark, "t"), 4)


def check(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string" + extra)
    got = sorted((r.id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(df).collect())
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute_components([r[0] for r in rows], fps)))
    assert got == want


def test_edges(spark):
    check(spark, [(1, None, 5), (2, "", 6), (3, " \t ", 7), (4, "One", 8), (5, "one two", 9), (5, "one two", 9), (6, "a B c d", 1), (7, "x y " * 30000, 2)], ", fp long")
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    check(spark, rows)
