from faultline.sources import logs
from faultline.streaming import signals

PAGE = """<table><tr><td><a href='/1'>1001</a><a href='/2'>1002</a></td><td>fail</td></tr><tr><td><a>1003</a></td><td>failed</td></tr>
<tr><td><a>12</a></td><td>dead</td></tr><tr><td><a>1001</a></td><td>pass, no error</td></tr></table>"""


def test_run_page(spark):
    df = spark.createDataFrame([("u", PAGE), ("e", "")], "url string, html string")
    assert [(r.url, r.total_jobs) for r in logs.job_counts(df).collect()] == [("u", 2)]
    assert sorted(r.job_id for r in logs.failed_jobs(df).collect()) == ["1001", "1002"]


def test_suite_page(spark):
    row = lambda run, fails: f'<tr><td><a href="/{run}/">x</a></td><td></td><td></td><td></td><td>{fails}</td></tr>'
    df = spark.createDataFrame([("s", row("ann-2024-01-02_10:00", "3 fail") + row("bo-2024-01-03_10:00", "7 fail") + row("cy-2024-01-04_10:00", "all pass"))], "url string, html string")
    assert [(r.user, r.fail_count) for r in logs.suite_runs(df).collect()] == [("bo", 7), ("ann", 3)]


def test_lines_and_filter(spark):
    df = spark.createDataFrame([("1", "a\r\nb c\n"), ("2", ""), ("3", None), ("4", "\n")], "job_id string, t string")
    got = [(r.job_id, r.line_no, r.line) for r in logs.text_lines(df, "job_id", "t").collect()]
    assert got == [("1", 0, "a"), ("1", 1, "b"), ("1", 2, "c"), ("4", 0, "")]
    assert [r.job_id for r in logs.only_jobs(df, " 1, ,3").collect()] == ["1", "3"] and logs.only_jobs(df, "").count() == 4


def test_folder_and_stream(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/7.log").write_text("fine\nOOM\n")
    assert [(r.job_id, r.log_text) for r in logs.log_folder(spark, f"{tmp_path}/logs").collect()] == [("7", "fine\nOOM\n")]
    got = []
    signals.watch(spark, f"{tmp_path}/logs", f"{tmp_path}/cp", lambda df, _: got.extend(df.collect())).awaitTermination()
    assert [(r.job_id, r.signal_type) for r in got] == [("7", "resource")]
