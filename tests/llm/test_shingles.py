import random

import corpus_pipeline
import numpy as np
from test_simhash import brute_components

from faultline.llm import shingles


def gram_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, similarity=0.8):
    """(components by comparing all sets, number of pairs between 0.8 and 0.9)."""
    sets, root, low = [gram_set(t) for _, t in rows], list(range(len(rows))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            share = len(sets[i] & sets[j]) / union if union else 1
            if share >= similarity:
                root[find(i)] = find(j)
                low += share < 0.9
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows)), low


def texts(seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 200, 500)))]
        for _ in range(4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.choice((0.005, 0.01, 0.02, 0.03))))):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(1000, ""), (1001, None), (1002, " \n"), (1003, "two words"), (1004, "Two  words"), (1005, "two other")]


def test_against_brute_force(spark):
    rows = texts()
    want, low = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert low > 30
    assert sorted((r.id, r.component) for r in shingles.near_duplicates(df).collect()) == want
    kept = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in want})


def test_finds_what_three_bits_miss():
    from test_simhash import brute_fp

    rows = texts()
    old = brute_components([d for d, _ in rows], [brute_fp(t, 5) for _, t in rows])
    assert len(set(old)) > len({c for _, c in brute(rows)[0]}) + 30


def around_a_passage(n=120, seed=5):
    """Documents that share two thirds of their words, and near copies of a few of them."""
    rng = random.Random(seed)
    common = [f"c{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join(common + [f"u{rng.randrange(10**6)}" for _ in range(rng.choice((40, 60)))])) for i in range(n)]
    return rows + [(1000 + i, rows[i * 5][1].rsplit(" ", 4)[0] + " other end of it") for i in range(15)]


def test_crowded_buckets(spark):
    rows = around_a_passage()
    want, _ = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.component) for r in shingles.near_duplicates(df, crowd=4).collect()) == want
    assert 100 < len({c for _, c in want}) < 130
    rows = texts(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.component) for r in shingles.near_duplicates(df, crowd=1).collect()) == brute(rows)[0]


def test_parities_never_exceed_the_difference():
    rng = random.Random(8)
    for _ in range(300):
        both, a, b = ({rng.getrandbits(64) for _ in range(rng.choice((0, 5, 80, 900)))} for _ in range(3))
        bits = [shingles.parities(np.array(sorted(x), dtype=np.uint64)) for x in (both | a, both | b)]
        assert sum(int(x).bit_count() for x in (bits[0] ^ bits[1]).view(np.uint64)) <= len(a ^ b)


def test_representatives_of_repeated_and_null_ids(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta " * 3, "one two three four five six seven", "seven six five four three two one")
    rows = [(1, a, "x"), (1, a, "y"), (1, b, "x"), (2, b, "x"), (3, c, "z"), (None, c, "z"), (None, "only null here", "z"), (None, "only null here", "z"), (None, "another null one", "z"), (4, None, "n"), (5, "", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    got = sorted(((r.doc_id, r.text) for r in shingles.representatives(df).collect()), key=str)
    assert got == sorted([(1, a), (1, b), (3, c), (None, "only null here"), (None, "another null one"), (4, None)], key=str)
    assert shingles.representatives(df.limit(0)).collect() == []
