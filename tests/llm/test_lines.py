import random

from pyspark.sql import functions as F

from faultline.llm import lines, registry


def distance(a, b, band=10**9):
    """Edit distance where it is at most band, otherwise something larger."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - band), min(len(b), i + band)
        new = [i if lo == 1 else 10**9] if lo == 1 else [10**9] * lo
        new += [10**9] * (lo - len(new))
        for j in range(lo, hi + 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != b[j - 1])))
        row = new + [10**9] * (len(b) - hi)
    return row[-1]


def near(a, b, edits):
    return abs(len(a) - len(b)) <= edits and distance(a, b, edits) <= edits


def brute(rows, edits=2, least=20):
    """{(id, text): (n_lines, removed, kept)}; rows equal in id and text are one."""
    first: dict = {}
    for d, t in rows:
        for no, x in enumerate((t or "").split("\n")):
            at = (-(2**63) if d is None else d, no)
            if x.strip():
                first[x] = min(first.get(x, at), at)
    late = {x for x in first for y in first if first[y] < first[x] and x != y and min(len(x), len(y)) >= least and near(x, y, edits)}
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        gone = [no for no, x in enumerate(parts) if x.strip() and (x in late or (-(2**63) if d is None else d, no) > first[x])]
        out.append((d, len(parts), gone, "\n".join(x for no, x in enumerate(parts) if no not in gone)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 0, "a", "b", 1) for r in rows], "doc_id long, text string, kept string, line int, k1 string, _K2 string, gone int")
    got = lines.without_repeats(df, **more)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    return sorted(((r.doc_id, r.n_lines, r.removed, r.kept) for r in got.collect()), key=str)


def edited(rng, s, n, letters):
    s = list(s)
    for _ in range(n):
        i = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[i] = rng.choice(letters)
        elif what == 1:
            s.insert(i, rng.choice(letters))
        else:
            del s[i]
    return "".join(s)


def test_within(spark):
    rng, rows = random.Random(1), []
    for _ in range(300):
        a = "".join(rng.choice("abé𝄞") for _ in range(rng.randrange(1, 30)))
        rows.append((a, edited(rng, a, rng.randrange(0, min(5, len(a))), "abé𝄞")))
    for n in (40, 70, 300):
        a = "".join(rng.choice("abé𝄞") for _ in range(n))
        rows += [(a, edited(rng, a, k, "abé𝄞")) for k in (0, 1, 2, 2, 3, 3, 4) for _ in range(4)]
        rows += [(a, "b" + a[:-1]), (a, a[1:] + "é"), (a, a[:5] + "zzzzz" + a[10:])]
    rows += [("", ""), ("", "ab"), ("abc", ""), ("aaaa", "aaaaaa"), ("aaaaa", "aa")]
    df = spark.createDataFrame(rows, "a string, b string")
    for edits in (0, 1, 2, 3):
        got = df.select("a", "b", lines.within(F.col("a"), F.col("b"), edits).alias("w")).collect()
        assert all(r.w == (distance(r.a, r.b) <= edits) for r in got)


def test_sketches_never_rule_out_a_link(spark):
    rng, rows = random.Random(9), []
    for _ in range(400):
        a = "".join(rng.choice("gggppmuced") for _ in range(rng.randrange(20, 260)))
        rows.append((a, edited(rng, a, 2, "gpx"), "".join(rng.choice("etaonirsz") for _ in range(60))))
    df = spark.createDataFrame(rows, "a string, b string, c string").select(*(lines.sketch(F.col(c)).alias(c) for c in "abc"))
    got = df.select(lines.apart(F.col("a"), F.col("b")).alias("near"), lines.apart(F.col("a"), F.col("c")).alias("far")).collect()
    assert max(r.near for r in got) <= 4 and min(r.far for r in got) > 4


def test_long_lines_of_any_letters(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("etaon éж𝄞") for _ in range(rng.randrange(120, 300))) for _ in range(8)]
    rows = [(d, edited(rng, rng.choice(base), rng.randrange(4), "etaж𝄞")) for d in range(60)]
    want = brute(rows)
    assert run(spark, rows) == want and sum(len(r[2]) for r in want) > 20


def test_random_lines(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("etaon é") for _ in range(rng.randrange(18, 45))) for _ in range(25)]
    rows = []
    for d in range(80):
        rows.append((d, "\n".join(edited(rng, rng.choice(base), rng.randrange(4), "etaon z") for _ in range(rng.randrange(0, 5)))))
    want = brute(rows)
    assert run(spark, rows) == want and sum(len(r[2]) for r in want) > 50
    assert run(spark, rows, edits=1) == brute(rows, 1)
    assert run(spark, rows, edits=3, least_chars=10) == brute(rows, 3, 10)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_IDS", 0)
    x = "the quick brown fox jumps over it"
    rows = [(1, None), (2, ""), (3, x), (4, x + "\n" + x), (4, x + "\n" + x), (None, "a\n" + x[:-1]), (5, "short\nshort"), (6, ("y" * 30 + "\n") * 3000), (7, x * 2000), (8, x * 2000 + "!"), (9, "\n\n"), (10, " \n short \n short \n\t")]
    got = {(r[0], r[1]): r[2] for r in run(spark, rows)}
    assert got[(8, 1)] == [0] and got[(7, 1)] == [] and got[(6, 3001)] == list(range(1, 3000)) and got[(3, 1)] == [0] and got[(4, 2)] == [0, 1] and got[(None, 2)] == [] and got[(10, 4)] == [2] and got[(5, 2)] == [1]
    assert run(spark, []) == []


def test_query(spark):
    root = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_lines, r.removed) for r in registry.op4_line_dedup(spark, root).collect()), key=str)
    assert got == sorted(((d, n, ",".join(map(str, g))) for d, n, g, _ in brute(rows)), key=str)
