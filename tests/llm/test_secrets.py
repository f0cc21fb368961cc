import hashlib
import math
import random
import re

from faultline.llm import registry, secrets


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out)


def entropy_hit(s, size, bits):
    for i in range(len(s) - size + 1):
        w = s[i : i + size]
        if -sum(w.count(c) / size * math.log2(w.count(c) / size) for c in set(w)) >= bits - 1e-9:
            return True
    return False


def flat(rows):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in rows)


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, base int")
    return {r.id: r for r in secrets.spans(df).collect()}


def test_rules_on_random_pieces(spark):
    rng = random.Random(2)
    pieces = ["token", "API_KEY", "apikey", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGHIJ1234567890", "deadbeef0123", "0123456789abcdef", "é𝄞", "\n", "x.y/z", "passwdSECRET", "="]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(400)]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base == flat(want), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in want) for j in range(3)]
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))


def test_sliding_entropy_equals_a_count_of_every_window(spark):
    from pyspark.sql import functions as F

    for kind in secrets.CLASSES:
        every_window(spark, F, kind)


def every_window(spark, F, kind):
    rng = random.Random(5)
    strings = ["".join(rng.choice(kind.alphabet[: rng.choice((2, 6, 9, 12, 20, 66))]) for _ in range(rng.randrange(0, 140))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in strings], "s string").select("s", secrets.entropic(F.col("s"), kind).alias("hit"))
    got = [(r.s, r.hit) for r in df.collect()]
    assert all(h == entropy_hit(s, kind.window, kind.bits) for s, h in got) and len({h for _, h in got}) == 2


def test_added_spans_and_allow_list(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYzQ8d"
    got = scan(spark, [f"see {key} there", "see abababAB12ababababAB12ababab", "path home/users/work/reports/daily", "Example7Qx2Lm9Zp4Rt6Yw8Kd3", "a" * 100000])
    assert got[0].spans == f"entropy:4:{4 + len(key)}" and got[0].base == ""
    assert got[1].spans == got[2].spans == got[3].spans == ""


def test_edges(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "token=abcdefghijkl")], "doc_id long, text string")
    assert sorted((str(r.id), r.base, r.spans) for r in secrets.spans(df).collect()) == [("1", "", ""), ("1", "", ""), ("None", "assign:0:18", "assign:0:18")]
    assert secrets.spans(df.limit(0)).collect() == []
    assert "Python" not in secrets.spans(df)._jdf.queryExecution().executedPlan().toString()


def test_query(spark):
    root = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = registry.op3_secret_scan(spark, root).collect()
    assert len(got) == len(texts) and sum(r.n_assign for r in got) > 10
    for r in got:
        assert r.base_sha256 == hashlib.sha256(flat(brute(texts[r.doc_id])).encode()).hexdigest()


def test_candidates_of_each_class(spark):
    rng = random.Random(8)
    letters = [secrets.DIGITS + "ABCDEF", secrets.DIGITS + secrets.UPPER, secrets.DIGITS + secrets.LOWER, secrets.UPPER + secrets.LOWER, secrets.UPPER + secrets.LOWER + secrets.DIGITS + "+/_-"]
    keys = ["".join(rng.sample(alphabet, min(16, len(alphabet)))) + "".join(rng.sample(alphabet, 16)) for alphabet in letters]
    got = scan(spark, [f"é {k}." for k in keys] + ["1234567890123456789012", "supercalifragilisticexpialidocious", "GetUserAccountByIdentifierFromStore", f"{keys[4]}-0123456789abcdef-x", "A1" * 50])
    assert [got[i].spans for i in range(5)] == [f"entropy:2:{2 + len(k)}" for k in keys]
    assert [got[i].spans for i in (5, 6, 7, 9)] == ["hex:0:22", "", "", ""]
    # a base span inside a longer string leaves the rest to be judged
    assert got[8].base == f"hex:{len(keys[4]) + 1}:{len(keys[4]) + 17}" and f"entropy:0:{len(keys[4]) + 1}" in got[8].spans


def test_many_matches_in_one_text(spark):
    rng = random.Random(9)
    text = "".join(f"{rng.randrange(1 << 70):018x}{rng.choice((' ', ' token: abcdefghijkl12 ', ' é '))}" for _ in range(9000))
    got = scan(spark, [text])[0]
    assert got.base == flat(brute(text)) and got.n_hex > 8000 and got.n_assign > 1000


def test_planted_tokens_are_found(spark):
    """Tokens of forty random letters and digits behind every third document: nearly all are added spans, and base spans stay."""
    import base64
    import re

    root = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got, found, planted = {r.doc_id: r for r in registry.secrets_planted(spark, root).collect()}, 0, 0
    for doc, text in texts.items():
        if doc % 3 == 0:
            token = re.sub("[^A-Za-z0-9]", "x", base64.b64encode(hashlib.sha256(str(doc).encode()).digest()).decode())[:40]
            at = len(text) + len(" bearer ")
            text += f" bearer {token} end"
            base = [x for x in brute(text) if x[0] < at + 40 and x[2] > at]
            planted += 1
            found += any(x.startswith("entropy:") and at <= int(x.split(":")[1]) < at + 40 for x in got[doc].spans.split(",") if x) or bool(base)
        assert got[doc].base_sha256 == hashlib.sha256(flat(brute(text)).encode()).hexdigest()
    assert planted > 300 and found >= 0.97 * planted
    plain = [r for r in got.values() if r.doc_id % 3]
    assert sum("entropy" in r.spans for r in plain) <= 0.01 * len(plain)
