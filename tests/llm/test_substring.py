import hashlib

import numpy as np

from faultline.llm import registry, substring

ROOT = "/root/testdata/sf0.001"


def brute(rows, width=20):
    """{(id, text): multiset of (n_words, n_removed, kept)} with rows of one id in the given order."""
    seen, out = set(), []
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        out.append((d, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((tuple(r) for r in substring.without_repeats(df, **more).collect()), key=str)


def test_cover():
    for d in range(substring.PERIOD):
        assert any((a - b) % substring.PERIOD == d for a in substring.COVER for b in substring.COVER)


def test_random_passages(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(50)] + ["é x", "\x1cq"]
    passages = [list(rng.choice(vocabulary, n)) for n in (19, 20, 21, 33, 60, 60)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.integers(0, 5)):
            words += list(rng.choice(vocabulary, rng.integers(0, 25))) + passages[rng.integers(0, len(passages))]
        rows.append((d, rng.choice([" ", "\n", "\t  "]).join(words)))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, window=14) == brute(rows, 14)


def test_words_that_differ_in_many_letters(spark):
    """A word of Thue and Morse and its complement, which hashes by powers modulo 2^64 take for one; words of all lengths; very long ones."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = morse.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"t{i}" for i in range(19))
    rows = [(1, f"{morse} {tail}"), (2, f"{other} {tail}"), (3, f"{morse} {tail}"), (4, f"{morse[:256]} {tail}"), (5, f"{other[:256]} {tail}"), (6, f"{morse * 300} {tail}"), (7, f"{other * 300} {tail}")]
    rows += [(10 + n, f"{'z' * n} {tail}") for n in range(1, 40)]
    got = run(spark, rows)
    assert got == brute(rows) and sum(r[2] for r in got) == 20


def test_word_hashes_are_apart():
    words = sorted({("ab" * 600)[i:j].encode() for i in range(2) for j in range(i + 1, 700, 3)} | {bytes([c]) * n for c in (1, 97, 255) for n in range(1, 300)})
    body, starts = b"".join(words), np.cumsum([0, *map(len, words)])[:-1]
    kinds = [substring.word_hashes(np.frombuffer(body, np.uint8), starts, np.array(list(map(len, words))), k) for k in (0, 1)]
    assert all(len(set(k.tolist())) == len(words) for k in kinds) and not (kinds[0] == kinds[1]).any()


def test_edges(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 5000), (5, "a " * 25), (6, passage), (7, "x " + passage), (None, passage + " tail"), (8, passage)]
    assert run(spark, rows) == brute(rows)
    got = run(spark, [(6, passage), (6, passage), (6, passage)])
    assert sorted(r[2] for r in got) == [0, 30, 30]
    assert run(spark, rows[:1]) == brute(rows[:1])
    empty = spark.createDataFrame([], "doc_id long, text string, batch int")
    assert substring.without_repeats(empty).collect() == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in registry.op8_substring_dedup(spark, ROOT).collect())
    want = sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows))
    assert got == want and sum(r[2] for r in got) > 0
