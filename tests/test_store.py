import os
import random

from pyspark.sql import functions as F

from faultline.operators import clusters, condense, report, triage, verdicts
from faultline.sources import logs, store
from test_extract import plain_condensed

LOGS = "job_id string, status string, log_text string, source_url string, log_name string, elapsed_s double, error_message string"


def test_logs_go_to_files_and_back(spark, tmp_path):
    texts = {"1": "a\r\nb", "2": "no end", "x y": "é\n\n", "a/b%c": "odd", "ünï*+&": "name", "big": "line\n" * 200_000, "empty": ""}
    rows = [(j, "ok", t, "u", "n", 1.0, "") for j, t in texts.items()] + [("lost", "fetch_failed", None, "u", "n", 2.0, "gone"), ("null", "ok", None, "u", "n", 2.0, "")]
    df = spark.createDataFrame(rows, LOGS).repartition(5)
    report.write_logs(df, str(tmp_path))
    assert {r.job_id: r.log_text for r in logs.log_folder(spark, f"{tmp_path}/logs").collect()} == {j: t for j, t in texts.items() if t}
    assert {r.job_id: r.log_text for r in logs.stored_logs(spark, str(tmp_path)).collect()} == texts | {"lost": None, "null": None}
    index = {r.job_id: r for r in spark.read.option("header", True).csv(f"{tmp_path}/index.csv").collect()}
    assert set(index) == {*texts, "lost", "null"}
    for job, text in texts.items():
        path = tmp_path / index[job].log_path
        assert path.read_bytes() == text.encode() and int(index[job].bytes) == len(text.encode()) and index[job].status == "ok"
    assert {index[j].log_path for j in ("lost", "null")} == {None} and index["lost"].bytes == "0"
    names = sorted(os.listdir(tmp_path / "logs"))
    assert len(names) == len(texts) + 1 and "_SUCCESS" in names and all(os.path.isfile(tmp_path / "logs" / n) for n in names)
    # written again, a log is replaced and none is left in part
    report.write_logs(df.where("job_id = '1'").withColumn("log_text", F.lit("new")), str(tmp_path))
    assert (tmp_path / "logs/1.log").read_text() == "new" and len(os.listdir(tmp_path / "logs")) == len(names)


def test_texts_are_read_where_they_stand(spark, tmp_path):
    """Positions are filtered, dealt and ranked; text is read last and is in no exchange."""
    folder = tmp_path / "logs"
    folder.mkdir()
    bodies = {"1": b"a\r\nOOM here\n\nlast", "x y": "é\nü".encode() * 400_000, "3": b"", "4": b"bad \xff\n"}
    for name, body in bodies.items():
        (folder / f"{name}.log").write_bytes(body)
    rows = store.line_positions(spark, str(folder))
    got = {}
    for r in store.with_text(rows, "line").collect():
        got.setdefault(r.job_id, {})[r.line_no] = r.line
    want = {j: b.decode("utf-8", "replace").replace("\r\n", "\n").split("\n") for j, b in bodies.items() if b}
    want = {j: x[:-1] if x[-1] == "" else x for j, x in want.items()}
    assert {j: [x[i] for i in range(len(x))] for j, x in got.items()} == want
    # the last line of each log, chosen by positions alone
    last = rows.groupBy("job_id").agg(F.max_by(F.struct("path", "offset", "length"), "line_no").alias("x")).select("job_id", "x.*")
    found = store.with_text(last, "line")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "line" not in plan[plan.index("Exchange") :].split("Exchange", 1)[1].split("\n")[0].replace("line_no", "")
    assert {r.job_id: r.line for r in found.collect()} == {j: x[-1] for j, x in want.items()}
    whole = store.with_text(store.log_positions(spark, str(folder)))
    assert {r.job_id: r.log_text for r in whole.collect()} == {j: b.decode("utf-8", "replace") for j, b in bodies.items() if b}
    gone = spark.createDataFrame([(f"{folder}/none.log", 0, 5), (None, 0, 5)], "path string, offset long, length long")
    assert [r.log_text for r in store.with_text(gone).collect()] == [None, None]


def test_cache_is_renewed_in_place(spark, tmp_path):
    cache = store.VerdictCache(spark, f"{tmp_path}/cache", ttl=100.0)
    keys = spark.createDataFrame([("aa1",), ("aa2",), ("bb1",), ("cc1",)], "text_hash string")
    got = lambda now: {r.text_hash: (r.root_cause, r.confidence, r.cached) for r in cache.get(keys, now).collect()}
    assert got(0.0) == dict.fromkeys(("aa1", "aa2", "bb1", "cc1"), (None, None, False)) and cache.clear() == 0
    results = "text_hash string, success boolean, job_ord int, root_cause string, confidence double"
    cache.put(spark.createDataFrame([("aa1", True, 1, "first", 0.5), ("aa1", True, 2, "second", 0.6), ("aa1", False, 3, "bad", 0.1), ("aa2", True, 0, "x", 0.5), ("bb1", True, 0, "y", None), (None, True, 0, "z", 0.5)], results), 10.0)
    before = {n: os.path.getmtime(tmp_path / "cache/prefix=bb" / n) for n in os.listdir(tmp_path / "cache/prefix=bb")}
    assert got(50.0) == {"aa1": ("second", 0.6, True), "aa2": ("x", 0.5, True), "bb1": ("y", 0.0, True), "cc1": (None, None, False)}
    cache.put(spark.createDataFrame([("aa1", True, 0, "third", 0.7), ("cc1", False, 0, "bad", 0.7)], results), 60.0)
    assert cache.rows().where("text_hash = 'aa1'").count() == 1 and cache.rows().count() == 3
    assert {n: os.path.getmtime(tmp_path / "cache/prefix=bb" / n) for n in os.listdir(tmp_path / "cache/prefix=bb")} == before
    # what is older than its time is a miss
    assert got(130.0) == {"aa1": ("third", 0.7, True), "aa2": (None, None, False), "bb1": (None, None, False), "cc1": (None, None, False)}
    # and so is what can't be read
    spark.createDataFrame([("cc1", 60.0, '{"root_cause": ', "cc")], "text_hash string, cached_at double, entry string, prefix string").write.mode("append").partitionBy("prefix").parquet(f"{tmp_path}/cache")
    (tmp_path / "cache/prefix=bb/part-bad.parquet").write_bytes(b"PAR1 not a table")
    assert got(70.0) == {"aa1": ("third", 0.7, True), "aa2": ("x", 0.5, True), "bb1": ("y", 0.0, True), "cc1": (None, None, False)}
    assert cache.clear() == 4 and got(70.0)["aa1"] == (None, None, False)


def test_fallbacks_and_cache_rows(spark):
    df = spark.createDataFrame([("A", "j1", "ok", "x"), ("B", "j1", "fetch_failed", None), ("A", "j2", "ok", ""), ("B", "j3", None, "x")], "run_id string, job_id string, status string, log_text string")
    assert sorted((r.run_id, r.job_id) for r in report.fallbacks(df).collect()) == [("A", "j2"), ("B", "j1"), ("B", "j3")]
    assert [(r.run_id, r.job_id) for r in report.usable(df).collect()] == [("A", "j1")]
    cache = spark.createDataFrame([("k", 1.0, "old")], "text_hash string, cached_at double, answer string")
    new = spark.createDataFrame([("k", 2.0, "a", True), ("k", 3.0, "b", True), ("k", 4.0, "c", False)], "text_hash string, cached_at double, answer string, success boolean")
    assert [tuple(r) for r in report.updated_cache(cache, new).collect()] == [("k", 3.0, "b")]


def test_verdicts_with_logs(spark):
    found = spark.createDataFrame([("A", "1", "x"), ("B", "1", "y"), ("B", "2", "z")], "run_id string, job_id string, root_cause string")
    parsed = spark.createDataFrame([("A", "1", 0, "ta"), ("B", "1", 1, "tb"), ("B", "1", 2, "later")], "run_id string, job_id string, job_ord int, condensed_text string")
    assert sorted((r.run_id, r.job_id, r.root_cause, r.condensed_text) for r in report.with_logs(found, parsed).collect()) == [("A", "1", "x", "ta"), ("B", "1", "y", "later"), ("B", "2", "z", None)]


def some_runs(rng):
    pieces = ["Traceback (most recent call last):", '  File "a.py", line 1', "ValueError: bad value", "KeyError: other", "plain", "Command failed on h1 with status 3: sudo x", "ERROR timed out waiting", "No space left on device", "fine 2024-01-01 10:00:00"]
    rows = []
    for run in ("A", "B"):
        for j in range(25):
            text = "\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
            rows.append((run, str(j), j, *rng.choice([("ok", text)] * 6 + [("fetch_failed", None), ("ok", "")])))
    return rows


RUNS = "run_id string, job_id string, job_ord int, status string, log_text string"


def test_one_call_from_logs_to_verdicts(spark, tmp_path):
    """Its parts, put together by hand over single runs, give the same verdicts; the cache serves a second call."""
    rows = some_runs(random.Random(2))
    df = spark.createDataFrame(rows, RUNS)
    cache = store.VerdictCache(spark, f"{tmp_path}/cache")
    totals = spark.createDataFrame([("A", 30), ("B", 5)], "run_id string, total_jobs int")
    found = triage.triage(df, totals=totals, cache=cache, now=5.0)
    got = {(r.run_id, r.job_id): r for r in found.verdicts.collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if r.fallback} == {(r[0], r[1]) for r in rows if r[3] != "ok" or not r[4]}
    assert all((r.error_category, r.confidence) == ("artifact availability issue", 1.0) for r in got.values() if r.fallback)
    texts = {(r[0], r[1]): plain_condensed(r[4]) for r in rows if r[3] == "ok" and r[4]}
    assert {(r.run_id, r.job_id): r.condensed_text for r in found.parsed.collect()} == texts
    # members of a cluster share the verdict of its longest text, the first of equals
    members, order = {}, {(r[0], r[1]): r[2] for r in rows}
    for r in found.members.collect():
        members.setdefault((r.run_id, r.cluster_id), []).append((r.run_id, r.job_id))
    assert sorted(x for xs in members.values() for x in xs) == sorted(texts)
    assert {(r.run_id, r.cluster_id): r["size"] for r in found.clusters.collect()} == {k: len(v) for k, v in members.items()}
    reps = {k: min(v, key=lambda x: (-len(texts[x]), order[x])) for k, v in members.items()}
    alone = spark.createDataFrame([(*k, texts[rep]) for k, rep in reps.items()], "run_id string, cluster_id string, text string")
    judged = {(r.run_id, r.cluster_id): (r.root_cause, r.severity, r.failure_type) for r in verdicts.verdicts(alone).collect()}
    assert {x: (got[x].root_cause, got[x].severity, got[x].failure_type) for v in members.values() for x in v} == {x: judged[k] for k, v in members.items() for x in v}
    assert {(r.run_id, r.total_jobs, r.failed_jobs) for r in found.health.collect()} == {("A", 30, 25), ("B", 25, 25)}
    # what was counted while the tables were written equals a pass over them
    cards = found.verdicts.transform(report.snapshot).first().asDict()
    assert {k: found.counts[k] for k in cards} == cards and cards["jobs"] == len(rows)
    assert (found.counts["jobs_to_judge"], found.counts["clusters"], found.counts["saved"], found.counts["from_cache"]) == (len(texts), len(members), len(texts) - len(members), 0)
    stats = condense.parse_stats(found.parsed).agg(*(F.sum(c).alias(c) for c in ("tracebacks", "error_blocks", "total_lines", "total_chars", "condensed_chars"))).first().asDict()
    assert {k: found.counts[k] for k in stats} == stats
    second = triage.triage(df, cache=cache, now=6.0)
    assert second.counts["from_cache"] == len(members)
    again = second.verdicts.collect()
    assert {(r.run_id, r.job_id): r.root_cause for r in again} == {k: r.root_cause for k, r in got.items()}
    assert all(r.cached != r.fallback for r in again) and not any(r.cached for r in got.values())


def test_signatures_use_traces_and_blocks(spark):
    text = "Traceback (most recent call last):\n  File \"a.py\", line 1\nValueError: bad value\nplain"
    df = spark.createDataFrame([("A", "1", 0, "ok", text), ("A", "2", 1, "ok", "x\nassert\ny")], RUNS)
    found = triage.triage(df)
    signs = {r.representative_job_id: r.signature for r in found.clusters.collect()}
    assert signs["1"] == "ValueError: bad value" and signs["2"].startswith("===")
    block = spark.createDataFrame([("none", ["a\nERROR here\nb"])], "text string, blocks array<string>")
    assert block.select(clusters.signature(F.col("text"), None, F.col("blocks"))).first()[0] == "ERROR here"


def test_replies_are_read(spark):
    df = spark.createDataFrame([("A", "1", 0, "ok", "OOM"), ("A", "2", 1, "ok", "completely different words here")], RUNS)
    replies = spark.createDataFrame([("A", "1", '{"root_cause": "memory ran out", "severity": "low", "failure_type": "oom", "confidence": 0.9}')], "run_id string, job_id string, raw_reply string")
    got = {r.job_id: (r.root_cause, r.failure_type, r.severity) for r in triage.triage(df, replies=replies).verdicts.collect()}
    assert got["1"] == ("memory ran out", "resource", "critical") and got["2"][1] == "unknown"


def test_run_names_and_order_of_ids(spark):
    page = "<a href='https://qa-proxy.ceph.com/teuthology/inner-run/1/x.log'>l</a>"
    df = spark.createDataFrame([("https://h/outer-run/", page), ("https://h/outer-run", ""), ("https://h/", "")], "url string, html string")
    assert [r.run_name for r in logs.run_names(df).collect()] == ["inner-run", "outer-run", None]
    assert {r.run_name for r in logs.run_names(df, forced="given").collect()} == {"given"}
    rows = "".join(f"<tr><td><a>{i}</a></td><td>fail</td></tr>" for i in (10002, 9999, 10010, 9999))
    assert [r.job_id for r in logs.failed_jobs(spark.createDataFrame([("u", rows)], "url string, html string")).collect()] == ["10002", "10010", "9999"]
    long = spark.createDataFrame([("j" + "9" * 25,), ("j1" + "0" * 25,), ("j007",), ("j8",)], "job_id string")
    assert [r.job_id for r in report.by_job_id(long).collect()] == ["j007", "j8", "j" + "9" * 25, "j1" + "0" * 25]
