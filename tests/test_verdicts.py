import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.functions import rules, text
from faultline.operators import clusters, report, verdicts

SINGLE = [
    ("segmentation fault (core dumped)", "crash", "critical", "Likely crash failure (heuristic)", "component crash/exception", 0.65),
    ("Command failed on trial053 with status 1: 'sudo yum -y install erlang'", "infra", "high", "Command failed on trial053 with status 1: 'sudo yum -y install erlang'", "infrastructure/provisioning issue", 0.65),
    ("something happened", "unknown", "medium", "Likely unknown failure (heuristic)", "unknown issue", 0.4),
    ("No module named 'x.y'", "config", "high", "No module named 'x.y'", "configuration/dependency error", 0.65),
]


def test_verdicts_without_model(spark):
    df = spark.createDataFrame([(r[0],) for r in SINGLE], "text string")
    got = {r.text: r for r in verdicts.verdicts(df).collect()}
    for t, kind, severity, cause, category, sure in SINGLE:
        r = got[t]
        assert (r.failure_type, r.severity, r.root_cause, r.error_category, r.confidence) == (kind, severity, cause, category, sure)
        assert r.fix_suggestions == [r.recommended_action]


def plain_reason(text):
    """The failure reason of a text, line after line."""
    err = told = failed = None
    for line in map(str.strip, text.splitlines()):
        low = line.lower()
        if "stderr" in low and not err:
            for pattern in rules.STDERR_REASONS:
                if m := re.search(f"({pattern})", line, re.I):
                    err = m[1].strip()[:300]
                    break
        if low.startswith("failure_reason:"):
            told = line[15:].strip("' ")[:300]
        if not failed and (m := re.match(r".*?(Command failed\s*(?:\(.*?\))?\s*(?:on \w+\s*)?with status \d+.*)", line, re.I)):
            failed = m[1][:300]
        if m := re.search(r"(No module named '[^']+')", line):
            return m[1]
        if "failed to fetch package version" in low or "error reimaging" in low:
            return line[:300]
        if m := re.search(r"(valgrind error:.*)", line, re.I):
            return m[1][:300]
    if err:
        return f"{err} ({told[:100]})" if told else err
    return told or failed


def test_reasons_of_texts_of_many_lines(spark):
    rng = random.Random(11)
    pieces = [
        "x.stderr: Error EINVAL: no", "stderr no such file or directory: /a", "  stderr: permission denied (x)  ", "STDERR Invalid command: y", "plain", "", "failure_reason: 'it broke '", "Failure_Reason:", "failure_reason: " + "z" * 400,
        "Command failed on h1 with status 3: do", "a Command failed (workunit test x) on h with status 12", "COMMAND FAILED with status 1", "No module named ''", "   ", "Connection refused", "stderr ", "é stderr ImportError: é",
    ]
    decisive = ["ImportError: No module named 'a.b'", "Failed to fetch package version from x", " Error reimaging machines " + "w" * 400, "see VALGRIND error: leak"]
    texts = ["\n".join(rng.choice(pieces if rng.random() < 0.95 else decisive) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    texts += ["\r\n".join(t.split("\n")) for t in texts[:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.r for r in df.select("i", verdicts.reason(F.col("t")).alias("r")).collect()}
    assert got == {i: plain_reason(t) for i, t in enumerate(texts)}
    assert sum(r is None for r in got.values()) > 20 and len(set(got.values())) > 20


def test_every_noise_form(spark):
    """One line for each alternative of the noise rule, as a search of its own tells, and lines that only come near."""
    after = [
        "10.0.0.1:0/123 >> x", "conn(0xab12f", "s=STATE_OPEN", "s=READY", "s=BANNER", "s=AUTH_X", "s=NONE", "s=CLOSED", "q.mark_down", "x.stop", "x.ready entity", "shutdown_connections", "wait complete", "Processor -- start", "start start",
        "x.connect", "mon_subscribe", "mon_getmap", "mon_command", "==== mon_map", "==== config(1", "==== mgrmap", "==== osd_map", "_handle_peer_banner", "Inferring config",
    ]
    lines = [f"INFO:teuthology.orchestra.run.h1.stderr: 2024 {x}" for x in after] + [f"x {x} y" for x in after]
    lines += ["journalctl@ceph.mon.a.b.stdout: x dispatch", "journalctl@ceph.mon.a.b.stdout: x dispatch.", "journalctl@ceph.mon.a.b.stdout: Reconfiguring q", "a gzip -5 --verbose b", "tar c -f - -C /x", "-- replaced with a.gz", "  12.5% -- replaced", "x 12.5% -- replaced"]
    lines += [f"INFO:teuthology.orchestra.run.h1.stderr:{x}" for x in ("", "  ", "12+34 records in", "99 bytes copied", "x 99 bytes")] + ["real 1m2.3s", "sys\t0m0s", "user 1m2s."]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    got = {r.i for r in df.where(text.has(F.col("line"), rules.NOISE)).collect()}
    assert got == {i for i, x in enumerate(lines) if re.search(rules.NOISE, x)} and len(after) <= len(got) <= len(after) + 12


def test_types(spark):
    want = {
        "error einval": "test_bug", "CommandFailedError (workunit test x": "infra", "command failed (s3 x tests": "test_bug", "reimage of x failed": "infra", "sigabrt": "crash", "timed out": "timeout",
        "no route to host": "network", "keyring": "permission", "a room": "resource", "AssertionError": "crash", "parse error": "config", "got 404": "infra", "expected 1": "test_bug", "fine": "unknown",
    }
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r.t: r.k for r in df.select("t", verdicts.inferred_type(F.col("t")).alias("k")).collect()} == want


def test_normal_forms(spark):
    df = spark.createDataFrame([(x,) for x in ("SEV1", " sev4", "banana", None, "Connection", "infrastructure", "oom", "test-failure")], "v string")
    got = df.select("v", verdicts.normal_severity(F.col("v")).alias("s"), verdicts.normal_type(F.col("v")).alias("t")).collect()
    assert [(r.s, r.t) for r in got] == [("critical", "unknown"), ("low", "unknown"), ("medium", "unknown"), ("medium", "unknown"), ("medium", "network"), ("medium", "infra"), ("medium", "resource"), ("medium", "test_bug")]


def test_replies(spark):
    good = '{"root_cause": "disk", "severity": "SEV2", "failure_type": "oom", "confidence": 1.7, "fix_suggestions": "a, b"}'
    rows = [("plain", good), ("fenced", f"```json\n{good}\n```"), ("inside", f"Here: {good} so."), ("comma", good[:-1] + ",}"), ("none", "no json"), ("empty", ""), ("null", None), ("partial", '{"root_cause": "x"}'), ("number", "7")]
    df = spark.createDataFrame([(k, r, "no space left on device") for k, r in rows], "k string, raw_reply string, text string")
    got = {r.k: r for r in verdicts.from_replies(df).collect()}
    for k in ("plain", "fenced", "inside", "comma"):
        r = got[k]
        assert (r.json_valid, r.root_cause, r.severity, r.failure_type, r.confidence, r.fix_suggestions) == (True, "disk", "high", "resource", 1.0, ["a", "b"]), k
    assert not any(got[k].json_valid for k in ("none", "empty", "null", "partial", "number")) and got["none"].failure_type == "resource"


def test_ungrounded_cause_is_reset(spark):
    df = spark.createDataFrame([("boto3 broke", "timed out", 0.9), ("the 'missing thing' broke", "timed out", 0.9), ("it timed out", "timed out", 0.9)], "root_cause string, text string, confidence double")
    assert [r.confidence for r in verdicts.verdicts(df).collect()] == [0.65, 0.65, 0.9]


@pytest.mark.parametrize(("total", "failed", "kind", "pct"), [(100, 80, "mass_failure", "80%"), (100, 30, "partial_failure", "30%"), (100, 5, "isolated", "5%"), (0, 0, "isolated", "0%"), (50, 50, "mass_failure", "100%"), (200, 100, "partial_failure", "50%")])
def test_health(spark, total, failed, kind, pct):
    r = report.run_health(spark.createDataFrame([("r", total, failed)], "run_id string, total_jobs int, failed_jobs int")).first()
    assert (r.classification, r.pct, r.passed_jobs) == (kind, pct, total - failed)


def test_jaccard_and_volatile_parts(spark):
    df = spark.createDataFrame([("abc def ghi", "abc def jkl"), ("", "1 2"), ("abc", ""), ("abc", "ABC")], "a string, b string")
    assert [r[0] for r in df.select(text.jaccard(text.tokens(F.col("a")), text.tokens(F.col("b")))).collect()] == [0.5, 1.0, 0.0, 1.0]
    one = spark.createDataFrame([("2024-01-01 10:00:00 boom 0xdeadbeef pid=12 /tmp/x",)], "t string").select(text.without_volatile(F.col("t"))).first()[0]
    assert one.split() == ["boom"]


HEADS = "run_id string, cluster_id string, signature string, size long, representative_job_id string, text_length long, first_ord long"


def test_merge_is_greedy(spark):
    rows = [("r", "c1", "alpha beta gamma delta", 2, "j1", 10, 0), ("r", "c2", "alpha beta gamma delta eps", 1, "j3", 99, 2), ("r", "c3", "nothing alike here", 1, "j4", 5, 3)]
    df = spark.createDataFrame(rows, HEADS)
    got = [(r.cluster_id, r.size, r.representative_job_id) for r in clusters.merged_clusters(df).orderBy("cluster_no").collect()]
    assert got == [("c2", 3, "j3"), ("c3", 1, "j4")]
    assert {r.cluster_id: r.head for r in clusters.merge_map(df).collect()} == {"c1": "c2", "c2": "c2", "c3": "c3"}
    assert clusters.merge_map(df.limit(0)).collect() == []


def test_sets_that_share_little_never_meet(spark):
    """Of sets that share frequent tokens nearly none but the similar ones leave the join, and no similar pair is lost."""
    rng = random.Random(5)
    sets = [rng.sample(range(60), 20) for _ in range(300)]
    sets += [[*s[: 20 - k], *range(60 + 10 * i, 60 + 10 * i + k)] for i, s in enumerate(sets[:60]) for k in (1, 3, 4)]
    rows = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id long, t array<string>")
    index = clusters.prefix_index(rows, 0.7).cache()
    met = {tuple(r) for r in clusters.met(index, index, 0.7).where("a < b").collect()}
    of = [set(s) for s in sets]
    want = {(a, b) for b in range(len(of)) for a in range(b) if len(of[a] & of[b]) / len(of[a] | of[b]) >= 0.7}
    assert want <= met and len(met) < 3 * len(want)
    assert {(r.a, r.b) for r in clusters.similar_sets(rows, 0.7).collect()} == want
    index.unpersist()


def test_merged_sizes_order_the_clusters(spark):
    """One set of tokens in two clusters makes the largest, though no two sets are similar."""
    rows = [("r", "b", "gamma delta", 4, "j1", 1, 0), ("r", "a1", "alpha beta", 3, "j2", 1, 1), ("r", "a2", "beta alpha", 3, "j3", 1, 2)]
    got = {(r.cluster_id, r.head, r.cluster_no, r["size"]) for r in clusters.merge_map(spark.createDataFrame(rows, HEADS)).collect()}
    assert got == {("a1", "a1", 1, 6), ("a2", "a1", 1, 6), ("b", "b", 2, 4)}


def test_a_chain_is_decided_in_order(spark):
    """Each set is similar to its neighbours alone: the first takes the second, the third stays, and so on."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    rows = [("r", f"c{i:02}", " ".join(words[i : i + 10]), 1, f"j{i}", 5, i) for i in range(30)]
    got = {r.cluster_id: r.head for r in clusters.merge_map(spark.createDataFrame(rows, HEADS), 0.8).collect()}
    assert got == {f"c{i:02}": f"c{i // 2 * 2:02}" for i in range(30)}


def test_a_large_family_costs_one_comparison_each(spark):
    """Signatures that differ in one word, and some of two other kinds: the first of each takes its own, and no crowd is paired."""
    rows = [("r", f"c{i}", f"connection to host failed after many tries word{i:06}", 1, f"j{i}", 5, i) for i in range(6_000)]
    rows += [("r", f"d{i}", f"disk of node was full during write part{i:06}", 1, f"k{i}", 5, 10_000 + i) for i in range(3_000)]
    rows += [("r", f"e{i}", f"alone{i:04} apart{i:04} other{i:04}", 1, f"m{i}", 5, 20_000 + i) for i in range(50)]
    found = clusters.merge_map(spark.createDataFrame(rows, HEADS).repartition(4))
    got = {(r.head, r.cluster_no, r["size"]) for r in found.collect()}
    assert got == {("c0", 1, 6_000), ("d0", 2, 3_000)} | {(f"e{i}", 3 + i, 1) for i in range(50)}


@pytest.mark.parametrize("crowd", [2, 64])
@pytest.mark.parametrize("seed", [4, 5])
def test_merge_against_comparing_all_heads(spark, monkeypatch, seed, crowd):
    """Random signatures in two runs, some with one set of tokens, some with none; with crowds taken by hubs and without."""
    monkeypatch.setattr(clusters, "CROWD", crowd)
    rng, rows = random.Random(seed), []
    for i in range(150):
        words = " ".join(rng.sample(["alpha", "beta", "gamma", "delta", "eps", "zeta"], rng.randrange(3, 7))) + f" {rng.choice(['one', 'two', '9'])} {i}" if i % 15 else f"{i} {i}"
        rows.append((f"r{i % 2}", f"c{i * 37 % 1000}", words, rng.randrange(1, 6), f"j{i}", rng.randrange(40), i))
    want = {}
    for run in ("r0", "r1"):
        # (cluster, words, size, representative, text, members)
        heads = [(r[1], frozenset(re.findall(r"[a-z_][a-z0-9_]{2,}", r[2])), r[3], r[4], r[5], [r[1]]) for r in sorted(rows, key=lambda r: (-r[3], r[6])) if r[0] == run]
        while True:
            out, pool = [], list(heads)
            while pool:
                lead, rest = pool[0], pool[1:]
                close = [o for o in rest if not (lead[1] | o[1]) or len(lead[1] & o[1]) / len(lead[1] | o[1]) >= 0.7]
                best = max([lead, *close], key=lambda o: o[4])  # max takes the first of equals
                out.append((best[0], best[1], sum(o[2] for o in [lead, *close]), best[3], best[4], [c for o in [lead, *close] for c in o[5]]))
                pool = [o for o in rest if o not in close]
            out.sort(key=lambda o: -o[2])
            if len(out) == len(heads):
                break
            heads = out
        want |= {(run, c): (h[0], n, h[2]) for n, h in enumerate(heads, 1) for c in h[5]}
    got = {(r.run_id, r.cluster_id): (r.head, r.cluster_no, r["size"]) for r in clusters.merge_map(spark.createDataFrame(rows, HEADS)).collect()}
    assert got == want and len({v for v in want.values()}) < 120


def test_orders_and_limits(spark):
    rows = [("job9", "low", 0.9, "b", 0), ("job10", "critical", 0.2, "a", 1), ("Job2", "high", None, None, 2), ("x", "odd", 0.9, "a", 3)]
    df = spark.createDataFrame(rows, "job_id string, severity string, confidence double, user string, job_ord int")
    ids = lambda rows: [r.job_id for r in rows.collect()]
    assert ids(report.by_confidence(df)) == ["job9", "x", "job10", "Job2"]
    assert ids(report.by_job_id(df)) == ["Job2", "job9", "job10", "x"]
    assert ids(report.by_user(df)) == ["Job2", "job10", "x", "job9"]
    assert ids(report.limited(df, 2)) == ["job10", "Job2"] and report.left_out(df, 2).first().more == "+2 more" and report.left_out(df, 4).first().more == ""


def test_percents(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (0.999,)], "x double")
    got = [tuple(r) for r in df.select(report.half_even(F.col("x")), report.cut_percent(F.col("x")), report.half_up(F.col("x"))).collect()]
    assert got == [("12%", "12%", "13%"), ("14%", "13%", "14%"), ("100%", "99%", "100%")]


def test_written_csv(spark, tmp_path):
    report.write_csv(spark.createDataFrame([("1", ["a", "b"]), ("2", [])], "job_id string, fix_suggestions array<string>"), f"{tmp_path}/v.csv")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(f"{tmp_path}/v.csv").collect()) == [("1", "a; b"), ("2", None)]


def test_cache(spark):
    cache = spark.createDataFrame([("a", 100.0, "x"), ("a", 50.0, "old"), ("b", 1.0, "y")], "text_hash string, cached_at double, answer string")
    got = {r.text_hash: (r.answer, r.cached) for r in report.from_cache(spark.createDataFrame([("a",), ("b",), ("c",)], "text_hash string"), cache, 110.0, 60.0).collect()}
    assert got == {"a": ("x", True), "b": (None, False), "c": (None, False)}


def test_clip_and_escape(spark):
    df = spark.createDataFrame([("a\n" * 10000,), ("<b>&'",)], "t string")
    a, b = (r[0] for r in df.select(text.clip_middle(F.col("t"), 200)).collect())
    assert len(a) < 300 and "truncated" in a and b == "<b>&'"
    assert df.select(text.html_escape(F.col("t"))).collect()[1][0] == "&lt;b&gt;&amp;&#x27;"
