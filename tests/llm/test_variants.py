import random
import re
import zlib
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import registry, variants

words_of = st.lists(st.text("abé", min_size=1, max_size=7), max_size=40)


def edits(word, letters):
    """All texts one edit away."""
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + c + word[i + 1 :] for c in letters} | {word[:i] + word[i + 1 :]}
    return out - {word}


def plain(counts):
    """(word, form, root, n, n_near, form_n) of a dictionary of counts, by trying every edit."""
    letters = {c for w in counts for c in w}
    near = {w: [x for x in edits(w, letters) if x in counts] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(((-counts[x], x) for x in near[w]), default=(0, None))
        if best[1] is not None and -best[0] >= 2 * n:
            form[w] = best[1]
    out = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return sorted(out)


def corpus(docs):
    out = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


@settings(max_examples=200, deadline=None)
@given(words_of)
def test_numbers_are_places_in_order(found):
    keys = sorted(set(found) - {""})
    made = variants.Automaton(keys)
    assert [made.rest(made.root, 0, w, 0) for w in keys] == list(range(len(keys)))
    assert made.words[made.root] == len(keys)
    assert made.rest(made.root, 0, "zz", 0) == -1


@settings(max_examples=200, deadline=None)
@given(words_of, st.text("abé", min_size=2, max_size=7))
def test_halves_find_every_edit(found, word):
    keys = sorted(set(found) | {word})
    back = sorted(w[::-1] for w in keys)
    half = variants.half_of(word)
    first = {keys[i] for i in variants.Automaton(keys).near(word, half)}
    second = {back[i][::-1] for i in variants.Automaton(back).near(word[::-1], len(word) - half)}
    assert first == {x for x in edits(word, "abé") & set(keys) if x.startswith(word[:half])}
    assert first | second == edits(word, "abé") & set(keys)


def test_states_are_minimal():
    """Words of one ending share its states."""
    made = variants.Automaton(sorted(a + b for a in "abcdef" for b in ("ing", "ings", "ed")))
    assert len(made.edges) == 7


def test_small_ranges_and_copies(spark):
    """Many ranges, halves that reach over several of them, several copies of a range: the same rows."""
    rng = random.Random(5)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))): rng.randint(3, 400) for _ in range(500)}
    counts |= {"a" * n: n for n in range(60, 90)} | {"é" + "x" * 80: 3, "é" + "x" * 81: 7, "x" * 81: 14}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = variants.variants(df, range_words=40, asked=25)
    assert sorted(map(tuple, got.collect())) == plain(counts)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "Hello hello HELLO hellos hellos hellos Hellos"), (3, "jello jello jello " * 3), (3, "jello"), (3, "jello"), (4, "ÀÉtude àétude ÀÉtude ÀÉtude ÷×÷×÷ " * 9), (5, "a" * 70000 + " "), (6, "x1y2z3 abcd " * 50)]
    rows += [(100 + i, "hello world etude " * 7) for i in range(300)]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    assert sorted(map(tuple, variants.spelling_variants(df).collect())) == plain(corpus(rows))
    assert variants.spelling_variants(df.limit(0)).collect() == []


def test_query(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op12_spelling_variants(spark, root)
    mine = sorted(map(tuple, got.collect()))
    assert mine == plain(corpus(rows))
    assert any(r[1] for r in mine) and any(r[1] != r[2] for r in mine if r[1])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    sql = db.execute(registry.OP12_SQL)
    assert [c[0] for c in sql.description] == got.columns
    assert sorted(sql.fetchall()) == mine
