import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import pii, registry


def brute(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab@.@..-%+ 01259()é\n"), max_size=60))
def test_rules_are_leftmost_matches(text):
    assert pii.rules(text) == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "+1 (017) 555-7713", "10.0.0.1", "256.1.1.1", "a.b@c.de", "x@y", " ", ".", "-", "+", "0"]), max_size=9))
def test_rules_on_pieces(pieces):
    assert pii.rules("".join(pieces)) == brute("".join(pieces))


def test_held_out_precision_and_recall():
    rows = pii.examples(2500, 99)
    x, y = np.array([pii.describe(t, s, e, g) for t, s, e, _, g in rows]), np.array([r[3] for r in rows])
    trees = pii.model()
    hit = trees.score(x) >= trees.thresholds[x[:, 0].astype(int)]
    assert (y[hit] == 1).mean() > 0.95 and hit[y == 1].mean() > 0.8


def test_added_spans_and_redaction():
    text = "Please call (212) 555-0187 or write jane.roe [at] mail.org. License version 2.0, order 1234567."
    base, every = pii.find(text, pii.model())
    assert base == [] and {k for _, k, _ in every} == {"tel", "mail"}
    assert pii.redacted(text, every) == "Please call [tel] or write [mail]. License version 2.0, order 1234567."


def test_edges(spark):
    long = "1" * 200000 + " " + "a" * 200000 + "@" + " b@c.d"
    rows = [(1, None, "x"), (2, "", "x"), (3, long, "x"), (3, "a@b.c +1 234 567 8901", "x"), (None, "é 1.2.3.4", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.id, r.base) for r in pii.spans(df, redact=True).collect()}
    assert got == {(1, ""), (2, ""), (3, "email:400003:400008"), (3, "email:0:5,phone:6:21"), (None, "ip:2:9")}
    assert pii.spans(df.limit(0)).collect() == []


def test_query(spark):
    root = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    got = registry.op9_pii(spark, root).collect()
    assert len(got) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 20
    for r in got:
        want = brute(texts[r.doc_id])
        flat = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(flat.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert set(filter(None, flat.split(","))) <= set(r.spans.split(","))
