import math
import re
import zlib
from collections import Counter

import numpy as np

from faultline.llm import quality, registry


def test_density_difference_is_that_of_two_gaussians():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(2, 3, (400, 3))])
    y = np.repeat([0, 1], 400)
    m = quality.discriminant(x, y, 0.1, 0.2)
    z = (x - m.centre) / m.scale
    want = []
    for c in (0, 1):
        cov = np.linalg.inv(m.whiten[c].T @ m.whiten[c])
        d = z - m.means[c]
        want.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(m.difference(x), want[1] - want[0])


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "a\x00b " * 50000, 3), (3, "!!", 3), (None, "x", 4)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (9, 0)], "doc_id long, quality int")
    got = quality.scores(docs, labels).collect()
    assert len(got) == 5 and all(r.score == 0.5 for r in got)
    assert quality.scores(docs.limit(0), labels.limit(0)).collect() == []
    assert all(np.isfinite(quality.statistics(t)).all() for t in (b"", b"\n", b"A", b"\xc3\xa9", b"1 2 3", b"x" * 100000))


def test_held_out_accuracy(spark):
    root = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.op10_quality(spark, root).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for d, r in got.items())
    labels = [r for r in spark.read.parquet(f"{root}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) / len(labels) > 0.95


def plain_statistics(text):
    """The statistics of a text, counted byte by byte and word by word."""
    body = (text or "").encode()
    counts = Counter(body)
    between = lambda lo, hi: sum(n for c, n in counts.items() if lo <= c <= hi)
    words = [w for w in re.split(rb"[\t-\r ]+", body) if w]
    lines = [x for x in body.split(b"\n") if x]
    n, m, points = max(1, len(body)), max(1, len(words)), b".,;:'\"()-?"
    lower, upper, digit, wide = between(97, 122), between(65, 90), between(48, 57), between(128, 255)
    stop = sum(counts[c] for c in points)
    symbol = n - lower - upper - digit - wide - stop - counts[32] - between(9, 13)
    letters = max(1, lower + upper + wide)
    share = lambda a, b: math.log((a + 0.5) / (b + 20))
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    caps = sum(any(65 <= c <= 90 for c in w) and not any(97 <= c <= 122 for c in w) and len(w) > 1 for w in words)
    marked = sum(not letter(w[-1]) and w[-1] not in points and not 48 <= w[-1] <= 57 for w in words)
    inner = [w.strip(points) for w in words]
    bare = sum(not (x and all(65 <= c <= 90 or 97 <= c <= 122 for c in x)) and max(w) < 128 for w, x in zip(words, inner))
    kinds = Counter(words)
    entropy = -sum(k / n * math.log(k / n) for k in counts.values())
    return [
        math.log1p(len(words)), math.log(n / m), lower / letters, share(upper, letters), share(digit, n), wide / letters, share(stop, n), share(max(0, symbol), n),
        share(body.count(b"!!") + body.count(b" | "), m), share(caps, m), share(marked, m), share(bare, m), math.log((len(kinds) + 1) / (m + 1)) / math.log(m + 2),
        share(max(kinds.values(), default=0), m), math.log1p(len(words) / max(1, len(lines))), share(len(lines) - len(set(lines)), len(lines)), entropy,
    ]


def plain_densities(x, y, diagonal, pooled):
    """The difference of the two log-densities as a function of rows, by inverses and determinants."""
    centre, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - centre) / scale, -12, 12)
    own = [np.cov(z[y == c], rowvar=False) for c in (0, 1)]
    both = (own[0] * (y == 0).sum() + own[1] * (y == 1).sum()) / len(y)
    parts = []
    for c in (0, 1):
        s = own[c] * (1 - pooled) + both * pooled
        s = np.where(np.eye(len(s)) == 1, s, s * (1 - diagonal)) + 1e-3 * np.eye(len(s))
        parts.append((z[y == c].mean(0), np.linalg.inv(s), np.linalg.slogdet(s)[1]))

    def difference(rows):
        out = []
        for mean, inverse, size in parts:
            d = np.clip((rows - centre) / scale, -12, 12) - mean
            out.append(-0.5 * np.einsum("ij,jk,ik->i", d, inverse, d) - 0.5 * size)
        return out[1] - out[0]

    return difference


def plain_calibration(d, y):
    """Slope and intercept that minimise the log-loss with 0.005 * slope^2 beside it, on differences in units of their mean size."""
    unit = np.abs(d).mean() + 1e-9
    x = np.clip(d / unit, -20, 20)
    design, at = np.stack([x, np.ones(len(x))], axis=1), np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ at))
        at = at - np.linalg.solve(design.T * (p * (1 - p)) @ design + np.diag([1e-2, 0]), design.T @ (p - y) + [1e-2 * at[0], 0])
    return at[0] / unit, at[1]


def plain_scores(docs, labels):
    """Scores of (doc_id, text) by labels (doc_id, quality), in numpy alone."""
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    known = {}
    for d, q in labels:
        if d is not None and q in (0, 1) and not held(d):
            known[d] = max(q, known.get(d, 0))
    rows = {}
    for d, text in docs:
        if d in known:
            rows[d] = min(rows.get(d, [math.inf]), plain_statistics(text))
    ids = sorted(rows)
    x, y = np.array([rows[d] for d in ids]), np.array([known[d] for d in ids])
    fold, best = np.arange(len(y)) % 4, None
    for choice in ((0.05, 0.0), (0.2, 0.0), (0.1, 0.2), (0.3, 0.3), (0.6, 0.3), (0.8, 0.6)):
        d = np.zeros(len(y))
        for k in range(4):
            d[fold == k] = plain_densities(x[fold != k], y[fold != k], *choice)(x[fold == k])
        slope, intercept = plain_calibration(d, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(slope * d + intercept, -35, 35))), 1e-6, 1 - 1e-6)
        loss = -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
        if best is None or loss < best[0]:
            best = loss, choice, slope, intercept
    _, choice, slope, intercept = best
    found = plain_densities(x, y, *choice)(np.array([plain_statistics(t) for _, t in docs]))
    return [(d, held("" if d is None else d), 1 / (1 + math.exp(-min(700, max(-700, slope * v + intercept))))) for (d, _), v in zip(docs, found)]


def test_every_score_by_brute_force(spark):
    """The whole query over sf0.01 with nulls, repeated and conflicting rows, and columns of clashing names planted."""
    root = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{root}/labels.parquet").collect()]
    got = sorted((r.doc_id, r.held_out, r.score) for r in registry.op10_quality(spark, root).collect())
    want = sorted(plain_scores(docs, labels))
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-5, atol=1e-7)
    first = [d for d, q in labels if q == 0][:5]
    docs += [(None, "x y"), (None, None), (10**6, None), (10**6 + 1, ""), (first[0], "other text"), (first[1], docs[0][1]), docs[3], docs[3]]
    labels += [(first[0], 1), (first[1], None), (None, 1), (10**6, 0), (10**7, 1), (first[2], 0), (first[3], 7)]
    frame = spark.createDataFrame([(d, t, 0.5, "s") for d, t in docs], "doc_id long, text string, score double, x string")
    marks = spark.createDataFrame([(d, q, 1) for d, q in labels], "doc_id long, quality int, y int")
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, quality.scores(frame, marks).collect()), key=key), sorted(plain_scores(docs, labels), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-5, atol=1e-7)
