import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from faultline.plans import registry

ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    assert contract.entry(spark).count() > 1
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    found = db.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(str([r[i] for i in at]) for r in found.fetchall())
    df = registry.queries()[name](spark, ROOT)
    assert sorted(df.columns) == columns
    assert sorted(str(list(r)) for r in df.select(columns).collect()) == want


def test_log_queries_run_rules_compiled(spark):
    """Of a session that was started with Spark's own limit, too, as the JVM leaves longer methods to its interpreter."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    registry.queries()["snapshot_cards"](spark, ROOT)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_union_of_runs_finds_the_jobs_once(spark):
    df = registry.queries()["multi_run_union"](spark, ROOT)
    assert df.count() > 1 and not any("events.parquet" in f for f in df.inputFiles())


def test_verdicts_of_runs_read_written_logs(spark, monkeypatch):
    """Logs are read for their lines, sizes, states and fallbacks, so they are made once."""
    given = []
    monkeypatch.setattr(registry.triage, "triage", lambda logs: given.append(logs) or registry.triage.Triage(None, None, None, spark.range(1).selectExpr(*(f"id AS {c}" for c in "run_id job_id cluster_id severity failure_type root_cause confidence fallback".split())), None, {}))
    registry.queries()["run_verdicts"](spark, ROOT)
    files = given[0].inputFiles()
    assert files and not any("events.parquet" in f for f in files)


def test_parsed_logs_are_made_once(spark):
    """Their sizes are read from the written logs, not from the events again."""
    assert not any("events.parquet" in f for f in registry.queries()["parse_stats"](spark, ROOT).inputFiles())


def test_rules_on_generated_lines_are_many_tasks(spark, tmp_path):
    """Of events in one row group, too, where no line number is asked for; and where one is, its exchange is the only one."""
    spark.read.parquet(f"{ROOT}/events.parquet").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    size = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(size)
    spark.conf.set(size, "1b")
    try:
        found = registry.extract.signals(registry.lines(spark, str(tmp_path)))
        assert found.select(F.spark_partition_id().alias("part")).distinct().count() > 1
        numbered = registry.lines(spark, str(tmp_path))
        numbered.collect()
        plan = numbered._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set(size, before)
