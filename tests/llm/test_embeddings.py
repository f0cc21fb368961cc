import math

import numpy as np
import pytest

from faultline.llm import embeddings, registry


def brute(rows, threshold=0.93):
    """[(id, n_links, component)] by comparing all rows of a label."""
    n = len(rows)
    ok = [lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v, _), o in zip(rows, ok)]
    root, links = list(range(n)), [0] * n

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least: dict = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)]) for i, r in enumerate(rows))


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    return sorted((r.id, r.n_links, r.component) for r in embeddings.near_duplicates(df).collect())


def planted(seed, groups, size, spread):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        centre = rng.normal(size=32)
        for _ in range(size):
            rows.append((len(rows), np.float32(centre + rng.normal(size=32) * spread).tolist(), g % 3))
    return rows


def test_recall_against_brute_force(spark):
    rows = planted(1, 60, 4, 0.15) + [(1000 + i, v, lab) for i, v, lab in planted(2, 300, 1, 0)]
    got, want = run(spark, rows), brute(rows)
    assert sum(r[1] for r in got) >= 0.9 * sum(r[1] for r in want) > 100
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_one_large_group_in_blocks(spark):
    rows = planted(3, 1, 700, 0.01)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    a, b = [1.0, 2.0, 3.0, 0.0], [3.0, -1.0, 0.5, 0.25]
    rows = [
        (1, a, 1), (2, a, 1), (2, a, 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [], 1), (7, [0.0] * 4, 1),
        (8, [1.0, None, 2.0, 3.0], 1), (9, [1.0, float("nan"), 2.0, 3.0], 1), (10, [1.0, float("inf"), 2.0, 3.0], 1), (11, b, 1), (12, [-0.0 + x for x in b], 1), (13, [2 * x for x in a], 1),
    ]
    rows += [(14, [1.0, 2.0], 1), (15, [2.0, 4.0], 1), (16, [1.0, 2.0], 2), (17, [3.0], 1), (18, [5.0], 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[4:8]) == brute(rows[4:8])
    assert run(spark, [r for r in rows if r[0] == 99]) == []


def test_query(spark):
    root = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{root}/embeddings.parquet").collect()]
    got = registry.op2_embedding_near_dedup(spark, root).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_in_a_large_label(spark):
    """Planted pairs of cosine 0.93 to 0.96 in a label of 20,000 vectors, beside a small label that is found whole."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(1_000, 64))
    side -= (side * base[:1_000]).sum(1, keepdims=True) * base[:1_000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.931, 0.96, size=(1_000, 1))
    near = cosine * base[:1_000] + np.sqrt(1 - cosine**2) * side
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]).astype(np.float32))]
    rows += [(50_000 + i, v, 2) for i, v, _ in rows[:100] + rows[20_000:20_100]]
    got = run(spark, rows)
    assert sum(r[1] for r in got if r[0] < 50_000) >= 0.99 * 2_000
    assert sum(r[1] for r in got if r[0] >= 50_000) == 200
    assert all(r[1] in (0, 1) for r in got)
    assert all(r[2] == r[0] - 20_000 for r in got if r[1] and 20_000 <= r[0] < 50_000)


def test_two_lengths_in_one_large_label(spark):
    rows = planted(8, 100, 4, 0.05)
    rows = [(i, v, 1) for i, v, _ in rows] + [(1000 + i, v[:12], 1) for i, v, _ in rows]
    got, want = run(spark, rows), brute(rows)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want) > 1000
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_recall_by_band_and_size(spark):
    """Planted pairs in each band of cosine, in labels of three sizes: nearly all are found in each, none that is not one."""
    rng, rows, bands = np.random.default_rng(6), [], ((0.931, 0.95), (0.95, 0.97), (0.97, 0.99))
    for label, n in enumerate((1_000, 10_000, 30_000)):
        base = rng.normal(size=(n, 64))
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        side = rng.normal(size=(600, 64))
        side -= (side * base[:600]).sum(1, keepdims=True) * base[:600]
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        cosine = np.concatenate([rng.uniform(*b, size=(200, 1)) for b in bands])
        near = cosine * base[:600] + np.sqrt(1 - cosine**2) * side
        rows += [(label * 100_000 + i, v.tolist(), label) for i, v in enumerate(np.concatenate([near, base]).astype(np.float32))]
    got = {r[0]: r[1] for r in run(spark, rows)}
    for label in range(3):
        for b in range(3):
            assert sum(got[label * 100_000 + i] for i in range(b * 200, b * 200 + 200)) >= 0.95 * 200


def with_mean(rng, n, share, pairs, low, high, dim=64):
    """n unit vectors whose mean cosine is `share`, the first `pairs` of them with a partner each at a cosine from low to high."""
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    common = unit(rng.normal(size=(1, dim)))
    base = rng.normal(size=(n, dim))
    base = unit(base - (base @ common.T) * common)
    base = math.sqrt(share) * common + math.sqrt(1 - share) * base
    # a partner is as far from the common direction, so that only the rest differs
    rest = unit(base[:pairs] - (base[:pairs] @ common.T) * common)
    side = rng.normal(size=(pairs, dim))
    side = unit(side - (side @ common.T) * common - (side * rest).sum(1, keepdims=True) * rest)
    inner = (rng.uniform(low, high, size=(pairs, 1)) - share) / (1 - share)
    near = math.sqrt(share) * common + math.sqrt(1 - share) * (inner * rest + np.sqrt(1 - inner**2) * side)
    return base, near


@pytest.mark.parametrize("share", [0.0, 0.6, 0.8])
def test_recall_with_a_common_mean(spark, share):
    """Recall in bands of cosine, at three sizes of a label, whatever direction all vectors share; and few compared pairs."""
    rng, rows, bands = np.random.default_rng(int(share * 10) + 1), [], ((0.9301, 0.94), (0.94, 0.96), (0.96, 0.99))
    for label, n in enumerate((300, 4_000, 12_000)):
        for b, band in enumerate(bands):
            base, near = with_mean(rng, n // 3, share, 90, *band)
            # one common direction a label: all bands share it
            rows += [(label * 100_000 + b * 30_000 + i, v.tolist(), label) for i, v in enumerate(np.concatenate([near, base]))]
    got = {r[0]: r[1] for r in run_double(spark, rows)}
    for label in range(3):
        for b in range(3):
            assert sum(got[label * 100_000 + b * 30_000 + i] > 0 for i in range(90)) >= 0.9 * 90, (label, b)


def run_double(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    return sorted((r.id, r.n_links, r.component) for r in embeddings.near_duplicates(df).collect())


def test_bits_are_learned_and_balanced():
    """Bits of a label halve it, whatever its mean; tables at 50,000 vectors compare under a tenth of all pairs; learned rotations lose less."""
    rng = np.random.default_rng(2)
    for share in (0.0, 0.6, 0.8):
        base, near = with_mean(rng, 20_000, share, 20_000, 0.93, 0.9301)
        mean = base.mean(0)
        bits, number = embeddings.tables(50_000, float(mean @ mean), 0.93)
        found = [embeddings.quantiser(base[:5_000] - mean, i) for i in range(-(-bits * number // 64))]
        a, b = (embeddings.codes(x - mean, bits, number, found) for x in (base, near))
        on = np.concatenate([(a >> i) & 1 for i in range(bits)], axis=1).mean(0)
        assert abs(on - 0.5).max() < 0.05
        assert (a == b).any(1).mean() > 0.95
        alike = sum(float((np.bincount(a[:, t], minlength=2**bits) / len(a) @ (np.bincount(a[:, t], minlength=2**bits) / len(a)))) for t in range(number))
        assert 0 < bits and alike < 0.1
    spread = rng.normal(size=(4_000, 64)) * np.geomspace(1, 0.05, 64)
    loss = lambda r: np.square(np.sign(spread @ r) - spread @ r).sum()
    assert loss(embeddings.quantiser(spread, 0)) < loss(embeddings.unlearned(64, 0))


def test_rotations_are_learned_on_given_tables(spark, monkeypatch):
    seen = []
    learn = embeddings.quantiser
    monkeypatch.setattr(embeddings, "quantiser", lambda sample, seed: seen.append(len(sample)) or learn(sample, seed))
    for sf, least in (("sf0.01", 400), ("sf0.1", 1_900)):
        assert registry.op2_embedding_near_dedup(spark, f"/root/testdata/{sf}").count() > 0
        assert seen and seen.pop() >= least
        seen.clear()
