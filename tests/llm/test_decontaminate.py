import random
import re

import pytest

from faultline.llm import decontaminate


def words(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", small)


def brute(docs, items, window=10):
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, other in items:
            b = words(other)
            k = min(window, len(b))
            for s in range(len(b) - k + 1) if b else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == b[s : s + k]:
                        hit |= set(range(p, p + k))
                        found |= {str(item)} if item is not None else set()
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, w int").repartition(2)
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, prints int")
    return sorted((tuple(r) for r in decontaminate.contamination(d, b, **more).collect()), key=str)


def made(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "C", "ä", "É", "x1", "9"]
    text = lambda k: rng.choice((" ", "-", ". ")).join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, text(rng.choice((0, 1, 3, 5, 9, 10, 11, 14, 30)))) for i in range(14)]
    items.append((3, items[10][1]))
    docs = []
    for d in range(n):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            other = words(rng.choice(items)[1])
            cut = rng.randrange(len(other) + 1)
            parts += [" ".join(other[cut : cut + 13]).upper(), text(rng.randrange(0, 12))]
        docs.append((d, "  ".join(parts)))
    return docs, items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_ROWS, 0])
def test_every_shared_window(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    docs, items = made(1, 60)
    want = brute(docs, items)
    assert run(spark, docs, items) == want and sum(r[2] for r in want) > 100
    long = [i for i in items if len(words(i[1])) >= 10]
    assert run(spark, docs, long) == brute(docs, long)
    assert run(spark, docs, long, window=7, gram=3) == brute(docs, long, 7)


def test_edges(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (None, "q w e r t y u i o p"), (2, None), (4, ""), (5, "zz")]
    docs = [(1, None), (2, ""), (3, items[0][1]), (3, items[0][1]), (None, "x " + items[1][1]), (6, "zz " * 3000), (7, "a " * 20000), (8, "--")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items[2:4]) == brute(docs, [])
    assert run(spark, [], items) == []
    d = spark.createDataFrame(docs, "doc_id long, text string")
    plan = decontaminate.contamination(d, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
