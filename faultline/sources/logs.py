"""Where log lines come from: text columns, folders of logs, run pages, and the generated jobs of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import rules, text
from faultline.sources.store import job_of

TEMPLATES = (
    ("error", 0, 1, "{ts} ERROR:teuthology.run_tasks:Saw exception from tasks."),
    ("error", 0, 2, "Traceback (most recent call last):"),
    ("error", 0, 3, '  File "tasks/x.py", line {k}, in run'),
    ("error", 0, 4, "ValueError: bad value {k}"),
    ("error", 1, 1, "{ts} INFO:teuthology.orchestra.run.smithi{h}.stderr:Error EINVAL: invalid command"),
    ("error", 2, 1, "{ts} DEBUG:teuthology.orchestra.run:got remote process result: 22"),
    ("error", 3, 1, "{ts} CommandFailedError: Command failed on smithi{h} with status {k}: ceph x"),
    ("error", 4, 1, "{ts} ssh: connect to host 10.0.0.{k} port 22: Connection refused"),
    ("error", 5, 1, "{ts} osd.1 segmentation fault (core dumped) pid={k}"),
    ("error", 6, 1, "{ts} ERROR operation timed out after {k}s"),
    ("error", 7, 1, "{ts} cluster [WRN] HEALTH_WARN"),
    ("error", 8, 1, "{ts} open /tmp/f{k}: Permission denied"),
    ("error", 9, 1, "{ts} write: No space left on device"),
    ("error", 10, 1, "failure_reason: valgrind error: SyscallParam"),
    ("error", 11, 1, "{ts} WARNING:tasks.cephadm: step failed"),
    ("error", 12, 1, "{ts} MODULE FAILURE in step {k}"),
    ("error", 13, 1, "{ts} journalctl@ceph.mon.a.b.stdout: ERROR out of memory dispatch"),
    ("error", 14, 1, "{ts} DEBUG:teuthology.orchestra.run.trial{k}:> sudo other"),
    ("error", 15, 1, "Traceback (most recent call last):"),
    ("error", 15, 2, '  File "tasks/y.py", line {k}, in go'),
    ("error", 15, 3, "    raise Broken({k})"),
    ("error", 15, 4, "RuntimeError: broken {k}"),
    ("error", 16, 1, "write: No space left on device"),
    ("error", 16, 2, "   write: No space left on device"),
    ("error", 17, 1, "=== SUMMARY ==="),
    ("click", 0, 1, "{ts} DEBUG:teuthology.orchestra.run.smithi{h}:> sudo ceph step {k}"),
    ("purchase", 0, 1, "{ts} INFO:teuthology.orchestra.run.smithi{h}.stderr:line {k}"),
    ("view", 0, 1, "{ts} INFO:tasks.workunit: ok {k}"),
    ("signup", 0, 1, "{ts} INFO:tasks.workunit: done"),
)


def generated_lines(events: DataFrame) -> DataFrame:
    """(job_id, line_no, line): a log for each user of the events table, by a join with line templates.

    Events are dealt by user first, for the numbers along a log and for the rules after them: these cost far more than reading,
    and where no number is asked for, a file of few large row groups would otherwise be as few tasks.
    """
    events = events.hint("rebalance", "user_id")
    templates = events.sparkSession.createDataFrame(TEMPLATES, "et string, km int, seq int, tmpl string")
    keyed = events.withColumn("kk", F.regexp_extract("props", "([0-9]+)", 1))
    keyed = keyed.withColumn("mod", F.when(F.col("event_type") == "error", F.col("kk").cast("int") % 18).otherwise(0))
    joined = keyed.join(F.broadcast(templates), (F.col("event_type") == F.col("et")) & (F.col("mod") == F.col("km")))
    line = F.replace("tmpl", F.lit("{ts}"), F.substring(F.col("ts").cast("string"), 1, 19))
    line = F.replace(F.replace(line, F.lit("{k}"), F.col("kk")), F.lit("{h}"), (F.col("user_id") % 3).cast("string"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id", "seq")
    return joined.select(F.col("user_id").cast("string").alias("job_id"), (F.row_number().over(order) - 1).cast("long").alias("line_no"), line.alias("line"))


def text_lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, line) of a text column; a null or empty text has no lines."""
    return rows.select(id_col, F.posexplode(text.split_lines(F.coalesce(text_col, F.lit("")))).alias("n", "line")).select(id_col, F.col("n").cast("long").alias("line_no"), "line")


def log_folder(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, log_text): *.log files of a folder, bad bytes replaced, job_id from the file's name, %XX being the byte XX.

    Files without a byte give no row; `stored_logs` knows them by the index.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path)
    return files.select(job_of(F.col("_metadata.file_name")).alias("job_id"), F.decode("content", "UTF-8").alias("log_text"))


def stored_logs(spark: SparkSession, path: str) -> DataFrame:
    """What report.write_logs wrote under a path: its index, a row for each log, with log_text, null where the fetch failed."""
    schema = "job_id string, status string, log_path string, fetched_from string, log_name string, bytes long, elapsed_s string, error_message string"
    index = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{path}/index.csv")
    rows = index.join(log_folder(spark, f"{path}/logs"), "job_id", "left")
    return rows.withColumn("log_text", F.coalesce("log_text", F.when((F.col("status") == "ok") & (F.col("bytes") == 0), F.lit(""))))


def only_jobs(rows: DataFrame, jobs: str | None) -> DataFrame:
    """Rows of a comma-separated list of job ids; all rows without a list."""
    wanted = [j.strip() for j in (jobs or "").split(",") if j.strip()]
    return rows.where(F.col("job_id").isin(wanted)) if wanted else rows


def page_rows(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, row_no, row, links): table rows of run pages, with the digit-only texts of their links."""
    found = pages.select(url_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "row"))
    texts = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), lambda a: text.strip(F.regexp_replace(a, "<[^>]*>", "")))
    return found.withColumn("links", F.filter(texts, lambda a: a.rlike(r"^[0-9]{4,}$")))


def job_counts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, total_jobs): distinct first job links of a page's rows."""
    rows = page_rows(pages, url_col, html_col).where(F.size("links") > 0)
    return rows.groupBy(url_col).agg(F.countDistinct(F.element_at("links", 1)).alias("total_jobs"))


def failed_jobs(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, job_id): all job links of rows whose text says fail, dead, error or hung as a word, ids of a page as texts in order."""
    rows = page_rows(pages, url_col, html_col).where(F.regexp_replace("row", "<[^>]*>", " ").rlike(r"(?i)\b(fail|dead|error|hung)\b"))
    return rows.select(url_col, F.explode("links").alias("job_id")).distinct().orderBy(url_col, "job_id")


def suite_runs(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(suite_url, run_url, fail_count, user): runs of suite pages with failures, most first.

    A page on which no run has failures gives all its dated run links with count zero, in order of address.
    """
    rows = pages.select(F.col(url_col).alias("suite_url"), F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("no", "row"))
    href = F.regexp_extract("row", r"(?is)<a\b[^>]*href=[\"']([^\"']*/[^\"'/]+-[0-9]{4}-[0-9]{2}-[0-9]{2}_[^\"']*)[\"']", 1)
    cells = F.size(F.regexp_extract_all("row", F.lit(r"(?is)<td\b"), F.lit(0)))
    rows = rows.select("suite_url", "no", href.alias("run_url"), cells.alias("cells"), F.regexp_extract(F.regexp_replace("row", "<[^>]*>", " "), r"(?i)(\d+)\s+fail", 1).alias("fails"))
    rows = rows.where("run_url <> ''").withColumn("fail_count", F.when(F.col("cells") >= 5, F.coalesce(F.expr("try_cast(fails AS INT)"), F.lit(0))).otherwise(0))
    first = Window.partitionBy("suite_url", "run_url").orderBy(F.col("fail_count") == 0, "no")
    runs = rows.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    runs = runs.withColumn("any", F.max("fail_count").over(Window.partitionBy("suite_url"))).where("fail_count > 0 or any = 0")
    return runs.select("suite_url", "run_url", "fail_count", F.regexp_extract("run_url", r"([^/]+?)-[0-9]{4}-[0-9]{2}-[0-9]{2}_[^/]*/?$", 1).alias("user")).orderBy(
        "suite_url", F.desc("fail_count"), "run_url"
    )


def log_urls(jobs: DataFrame, run_col: str = "run_name", id_col: str = "job_id") -> DataFrame:
    """jobs with place, url and log_name: where a job's log may be, the first to try at place 0."""
    first = F.format_string(rules.LOG_URL, run_col, id_col)
    names = F.array(*(F.struct(F.regexp_replace(first, rules.LOG_NAMES[0] + "$", n).alias("url"), F.lit(n).alias("log_name")) for n in rules.LOG_NAMES))
    return jobs.select("*", F.posexplode(names).alias("place", "x")).select(*jobs.columns, F.col("place").cast("long").alias("place"), "x.url", "x.log_name")


def run_names(pages: DataFrame, url_col: str = "url", html_col: str = "html", forced: str | None = None) -> DataFrame:
    """pages with run_name: a forced one, else that of a log's address in the page, else the last part of its path; null without one."""
    path = F.regexp_replace(F.regexp_extract(url_col, r"^[^:/]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    given = F.nullif(F.lit(forced or ""), F.lit(""))
    found = F.nullif(F.regexp_extract(html_col, rules.LOG_URL_RUN, 1), F.lit(""))
    return pages.withColumn("run_name", F.coalesce(given, found, F.nullif(F.regexp_extract(path, r"/([^/]+)$", 1), F.lit(""))))


def url_parts(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """rows with valid, suite_page and slug: an http address with a host; a listing page; a name of 80 characters."""
    url = F.col(url_col)
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(url, r"^[^:/]+://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[^:/]+://[^/?#]*([^?#]*)", 1)
    bare = F.regexp_replace(path, "^/+|/+$", "")
    listing = url.rlike(r"[?&](suite|branch|machine_type|status|sha1)=") | (bare == "") | (bare.rlike(r"^[A-Za-z-]+$") & (F.length(bare) < 30))
    slug = F.substring(F.regexp_replace(F.element_at(F.split(bare, "/"), -1), r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    return rows.withColumns({"valid": scheme.isin("http", "https") & (host != ""), "suite_page": listing, "slug": F.when(slug == "", "run").otherwise(slug)})
