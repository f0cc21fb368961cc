"""Registered queries of the log operators over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import rules, text
from faultline.operators import clusters, condense, extract, report, triage, verdicts
from faultline.operators.tables import Tables
from faultline.plans.session import compiled
from faultline.sources import logs, store

MODEL, VERSION = "rules", "v1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.generated_lines(table(spark, sf_dir, "events"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, job_id, job_ord, text): a job's signal lines in order; jobs are dealt to four runs by their number."""
    found = extract.signals(lines(spark, sf_dir)).groupBy("job_id").agg(extract.joined_text())
    number = F.col("job_id").cast("long")
    return found.select((number % 4).cast("string").alias("run_id"), "job_id", number.alias("job_ord"), "text")


def failing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal lines as failures of their own: (run_id, job_id, job_ord, text), the id being job:line."""
    rows = extract.signals(lines(spark, sf_dir))
    return rows.select(
        "signal_type", F.concat_ws(":", "job_id", F.col("line_no").cast("string")).alias("job_id"), (F.col("job_id").cast("long") * 1000 + F.col("line_no")).alias("job_ord"), F.col("line").alias("text")
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each error line, and a fallback for each job of number 0 modulo 7 as if its log were missing."""
    rows = verdicts.verdicts(failing_lines(spark, sf_dir)).withColumns({"success": F.lit(True), "fallback": F.lit(False)})
    missing = lines(spark, sf_dir).select("job_id").distinct().where(F.col("job_id").cast("long") % 7 == 0)
    lost = missing.select("job_id", F.col("job_id").cast("long").alias("job_ord"), *(F.lit(v).alias(k) for k, v in report.FALLBACK.items()), F.lit(True).alias("success"), F.lit(True).alias("fallback"))
    return rows.select(*lost.columns).unionByName(lost)


# --- the same rows in SQL -----------------------------------------------------------------------------------------


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def cte(**parts: str) -> str:
    return ", ".join(f"{k} AS ({v})" for k, v in parts.items())


def signal_sql() -> str:
    out = [f"WHEN {matches('line', rules.NOISE)} THEN NULL"]
    for s in rules.SIGNALS:
        test = [matches("line", s.pattern)] + ([f"contains(upper(line), '{s.needs}')"] if s.needs else []) + [f"NOT contains(line, '{w}')" for w in s.without]
        out.append(f"WHEN {' AND '.join(test)} THEN '{s.name}'")
    return f"CASE {' '.join(out)} END"


def case(column: str, pairs: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {matches(column, p)} THEN {quoted(v)}" for p, v in pairs) + f" ELSE {default} END"


def map_sql(column: str, table: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {default} END"


TEMPLATE_SQL = ", ".join(f"({quoted(e)}, {k}, {s}, {quoted(t)})" for e, k, s, t in logs.TEMPLATES)
LINES = f"""tm(et, km, seq, tmpl) AS (VALUES {TEMPLATE_SQL}),
ev AS (SELECT *, regexp_extract(props, '([0-9]+)', 1) AS kk FROM events),
lines AS (SELECT CAST(user_id AS VARCHAR) AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, seq) - 1 AS line_no,
  replace(replace(replace(tmpl, '{{ts}}', substr(CAST(ts AS VARCHAR), 1, 19)), '{{k}}', kk), '{{h}}', CAST(user_id % 3 AS VARCHAR)) AS line
  FROM ev JOIN tm ON event_type = et AND km = CASE WHEN event_type = 'error' THEN CAST(kk AS INT) % 18 ELSE 0 END)"""
SIGNALS = f"{LINES}, sg AS (SELECT * FROM (SELECT *, {signal_sql()} AS signal_type FROM lines) WHERE signal_type IS NOT NULL)"
ERRORS = f"{LINES}, hits AS (SELECT * FROM lines WHERE {matches('line', rules.ERROR_WORD)} AND NOT {matches('line', rules.NOISE)})"
ENDS = "ends AS (SELECT job_id, max(line_no) AS last FROM lines GROUP BY 1)"


def islands_sql(hits: str, before: int, after: int, join: int) -> str:
    return f"""{ENDS}, mk AS (SELECT job_id, line_no, CASE WHEN line_no - lag(line_no) OVER (PARTITION BY job_id ORDER BY line_no) <= {before + after + join} THEN 0 ELSE 1 END AS new FROM {hits}),
il AS (SELECT job_id, line_no, sum(new) OVER (PARTITION BY job_id ORDER BY line_no) AS island FROM mk),
sp AS (SELECT job_id, island, greatest(min(line_no) - {before}, 0) AS start_line, least(max(line_no) + {after}, any_value(last)) AS end_line FROM il JOIN ends USING (job_id) GROUP BY 1, 2)"""


BLOCKS = f"""{ERRORS}, {islands_sql("hits", 5, 5, 1)},
bl AS (SELECT sp.job_id, start_line, end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM sp JOIN lines ON sp.job_id = lines.job_id AND line_no BETWEEN start_line AND end_line GROUP BY 1, 2, 3)"""
STRONG = (
    f"({matches('line', rules.COMMAND_FAILED)} OR (contains(line, 'ERROR:teuthology') AND contains(line, 'Saw exception')) OR "
    f"({matches('line', rules.TASK_WARNING)} AND (contains(lower(line), 'failed') OR contains(lower(line), 'error'))))"
)
JOBS = f"{SIGNALS}, jb AS (SELECT CAST(CAST(job_id AS BIGINT) % 4 AS VARCHAR) AS run_id, job_id, CAST(job_id AS BIGINT) AS job_ord, string_agg(line, chr(10) ORDER BY line_no) AS text FROM sg GROUP BY job_id)"
FAILING = f"{SIGNALS}, fl AS (SELECT signal_type, job_id || ':' || line_no AS job_id, CAST(job_id AS BIGINT) * 1000 + line_no AS job_ord, line AS text FROM sg)"
STRIP = lambda c: f"regexp_replace({c}, '^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$', '', 'g')"


def fingerprint_sql(column: str) -> str:
    out = STRIP(column)
    for pattern, by in rules.FINGERPRINT_STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return f"substr({out}, 1, 200)"


TYPE_SQL = case("lower(text)", [(p, t) for t, p in rules.TYPE_RULES], "'unknown'")
PTYPE_SQL = case("text", [("(?i)" + p, t) for t, _, p in rules.CONCRETE_RULES])
PSEV_SQL = case("text", [("(?i)" + p, s) for _, s, p in rules.CONCRETE_RULES])
RANK_SQL = "CASE {0} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 99 END"
# a failing line is one line: its reason is the line's own
REASON_SQL = f"""coalesce(nullif(regexp_extract(text, '(?i)(valgrind error:.*)', 1), ''),
 CASE WHEN contains(lower(text), 'stderr') THEN coalesce({", ".join(f"nullif(regexp_extract(text, {quoted('(?i)(' + p + ')')}, 1), '')" for p in rules.STDERR_REASONS)}) END,
 CASE WHEN starts_with(lower(text), 'failure_reason:') THEN nullif(trim(substr(text, 16), ''' '), '') END,
 nullif(regexp_extract(text, '(?i)^.*?(Command failed\\s*(?:\\(.*?\\))?\\s*(?:on \\w+\\s*)?with status \\d+.*)', 1), ''),
 CASE WHEN {matches("text", rules.ERROR_LINE)} AND NOT {matches("text", rules.METADATA)} THEN text END)"""
VERDICTS = f"""{FAILING}, v0 AS (SELECT *, {TYPE_SQL} AS t0, {PTYPE_SQL} AS pt, {PSEV_SQL} AS ps, {REASON_SQL} AS why FROM fl),
v1 AS (SELECT *, CASE WHEN t0 <> 'unknown' THEN t0 ELSE coalesce(pt, 'unknown') END AS failure_type, CASE WHEN {RANK_SQL.format("ps")} < 2 THEN ps ELSE 'medium' END AS s0 FROM v0),
v2 AS (SELECT job_id, job_ord, coalesce(why, 'Likely ' || failure_type || ' failure (heuristic)') AS root_cause,
  CASE WHEN failure_type IN ('crash', 'config', 'resource', 'permission', 'test_bug') AND s0 = 'medium' THEN 'high' ELSE s0 END AS severity, failure_type,
  {map_sql("failure_type", rules.CATEGORIES, "'unknown issue'")} AS error_category, CASE WHEN failure_type <> 'unknown' THEN 0.65 ELSE 0.4 END::DOUBLE AS confidence FROM v1)"""
FALLBACK_SQL = ", ".join(f"{quoted(v) if isinstance(v, str) else str(v) + '::DOUBLE'} AS {k}" for k, v in report.FALLBACK.items())
JUDGED = f"""{VERDICTS}, jd AS (SELECT *, true AS success, false AS fallback FROM v2
  UNION ALL SELECT job_id, CAST(job_id AS BIGINT) AS job_ord, {FALLBACK_SQL}, true, true FROM (SELECT DISTINCT job_id FROM lines) WHERE CAST(job_id AS BIGINT) % 7 = 0)"""
VOLATILE_SQL = lambda c: f"regexp_replace({c}, {quoted(rules.VOLATILE)}, '', 'g')"
SIGNATURE_SQL = STRIP(
    VOLATILE_SQL(
        f"""coalesce(nullif(concat_ws(' | ', nullif(regexp_extract(text, {quoted(rules.SIGNATURE_COMMAND)}, 1), ''), coalesce(nullif(regexp_extract(text, {quoted(rules.SIGNATURE_TIMEOUT)}, 1), ''),
  nullif(regexp_extract(text, {quoted(rules.SIGNATURE_FATAL)}, 1), ''))), ''), substr(text, 1, 200))"""
    )
)
TRACES = f"""{LINES}, nb AS (SELECT job_id, line_no, {STRIP("line")} AS bare, {matches("line", rules.TRACEBACK_START)} AS start, {matches(STRIP("line"), rules.TRACEBACK_CHAIN)} AS chain,
  substr(line, 1, 1) IN (' ', chr(9)) AS indented FROM lines WHERE {STRIP("line")} <> ''),
nx AS (SELECT *, lead(line_no) OVER o AS follow, coalesce(lead(start OR chain) OVER o, false) AS linked, NOT lead(indented) OVER o AS flush FROM nb WINDOW o AS (PARTITION BY job_id ORDER BY line_no)),
ek AS (SELECT *, CASE WHEN starts_with(bare, 'File ') OR starts_with(bare, '...') THEN '' WHEN {matches("bare", rules.TRACEBACK_END)} THEN CASE WHEN linked THEN 'jump' ELSE 'end' END
  WHEN follow = line_no + 1 AND flush AND NOT linked THEN 'stop' ELSE '' END AS kind FROM nx),
ln AS (SELECT l.job_id, l.line_no, l.line, coalesce(start, false) AS start, coalesce(kind, '') AS kind, follow,
  CASE WHEN kind = 'jump' THEN coalesce((SELECT min(x.line_no) FROM ek x WHERE x.job_id = l.job_id AND x.start AND x.line_no >= ek.follow), 1000000000) END AS again FROM lines l LEFT JOIN ek USING (job_id, line_no)),
wk AS (SELECT job_id, -1::BIGINT AS line_no, NULL::BIGINT AS tr, 0::BIGINT AS cnt, 0::BIGINT AS skip, 0::BIGINT AS fol, NULL::BIGINT AS inc FROM (SELECT DISTINCT job_id FROM lines)
  UNION ALL SELECT w.job_id, n.line_no,
    CASE WHEN w.tr IS NULL THEN CASE WHEN n.start THEN w.cnt END WHEN n.line_no >= w.skip AND n.kind IN ('end', 'stop') THEN NULL ELSE w.tr END,
    CASE WHEN w.tr IS NULL AND n.start THEN w.cnt + 1 ELSE w.cnt END,
    CASE WHEN w.tr IS NOT NULL AND n.line_no >= w.skip AND n.kind = 'jump' THEN n.again ELSE w.skip END,
    CASE WHEN w.tr IS NOT NULL AND n.line_no >= w.skip AND n.kind = 'jump' THEN n.follow ELSE w.fol END,
    CASE WHEN w.tr IS NULL THEN CASE WHEN n.start THEN w.cnt END WHEN n.line_no >= w.skip OR n.line_no >= w.fol THEN w.tr END
  FROM wk w JOIN ln n ON n.job_id = w.job_id AND n.line_no = w.line_no + 1),
tb AS (SELECT wk.job_id, wk.line_no, inc AS tr, line FROM wk JOIN lines USING (job_id, line_no) WHERE inc IS NOT NULL)"""
CLUSTERED = f"{JOBS}, cl AS (SELECT *, substr(sha256(sig), 1, 16) AS cluster_id FROM (SELECT *, {SIGNATURE_SQL} AS sig FROM jb))"
LINE_CLUSTERS = f"{FAILING}, lc AS (SELECT *, CAST(CAST(split_part(job_id, ':', 1) AS BIGINT) % 4 AS VARCHAR) AS run_id, substr(sha256(sig), 1, 16) AS cluster_id FROM (SELECT *, {SIGNATURE_SQL} AS sig FROM fl))"
DOC_LINES = "dl AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line FROM (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS p FROM documents)))"
TOKEN_SETS = """ts AS (SELECT text, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z_][a-zA-Z0-9_]{2,}'), lambda x: lower(x)))) AS t FROM (SELECT DISTINCT text FROM fl)),
hd AS (SELECT t, min(text) AS head FROM ts WHERE len(t) > 0 GROUP BY 1)"""


def merge_sql(members: str, passes: int = 4) -> str:
    """Members (run_id, cluster_id, job_id, job_ord, sig, text) merged greedily, one pass after the other; a pass that takes nothing changes nothing.

    Each pass numbers a run's clusters, walks them in order with the list of those that stay, and gives the others to the first of it.
    """
    out = f"""mb AS ({members}),
n0 AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY size DESC, o) AS pos FROM (
  SELECT run_id, cluster_id AS name, count(*) AS size, min(job_ord) AS o, max(length(text)) AS len,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(any_value(sig), '[a-zA-Z_][a-zA-Z0-9_]{{2,}}'), lambda x: lower(x)))), ' ') AS k FROM mb GROUP BY 1, 2)),
ks AS (SELECT DISTINCT run_id, k, string_split(k, ' ') AS t FROM n0),
sim AS (SELECT run_id, a.k AS ka, b.k AS kb FROM ks a JOIN ks b USING (run_id) WHERE a.k = b.k OR (a.k <> '' AND b.k <> '' AND len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) >= 0.7))"""
    for p in range(passes):
        out += f""",
nb{p} AS (SELECT b.run_id, b.pos, coalesce(list(a.pos) FILTER (a.pos IS NOT NULL), []) AS earlier FROM n{p} b LEFT JOIN (sim JOIN n{p} a ON sim.run_id = a.run_id AND sim.ka = a.k) ON sim.run_id = b.run_id AND sim.kb = b.k AND a.pos < b.pos GROUP BY 1, 2),
st{p} AS (SELECT DISTINCT run_id, 0::BIGINT AS i, []::BIGINT[] AS stay FROM n{p}
  UNION ALL SELECT s.run_id, s.i + 1, CASE WHEN list_has_any(stay, earlier) THEN stay ELSE list_append(stay, s.i + 1) END FROM st{p} s JOIN nb{p} n ON s.run_id = n.run_id AND n.pos = s.i + 1),
ow{p} AS (SELECT n.run_id, n.pos, CASE WHEN list_contains(stay, n.pos) THEN n.pos ELSE list_min(list_intersect(stay, earlier)) END AS own FROM nb{p} n JOIN (SELECT run_id, arg_max(stay, i) AS stay FROM st{p} GROUP BY 1) USING (run_id)),
g{p} AS (SELECT run_id, w.own AS of, sum(size)::BIGINT AS size, first(name ORDER BY len DESC, pos) AS name, first(k ORDER BY len DESC, pos) AS k, max(len) AS len FROM n{p} JOIN ow{p} w USING (run_id, pos) GROUP BY 1, 2),
n{p + 1} AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY size DESC, of) AS pos FROM g{p})"""
    way = " ".join(f"JOIN ow{p} ON ow{p}.run_id = n0.run_id AND ow{p}.pos = {'n0' if not p else f'n{p}'}.pos JOIN n{p + 1} ON n{p + 1}.run_id = n0.run_id AND n{p + 1}.of = ow{p}.own" for p in range(passes))
    return f"{out}, en AS (SELECT n0.run_id, n0.name AS was, n{passes}.name, n{passes}.pos, n{passes}.size FROM n0 {way}) SELECT mb.run_id, job_id, en.name AS cluster_id, en.pos AS cluster_no, en.size FROM mb JOIN en ON mb.run_id = en.run_id AND mb.cluster_id = en.was"


DOC_CLUSTERS = f"SELECT run_id, substr(sha256(sig), 1, 16) AS cluster_id, job_id, job_ord, sig, text FROM (SELECT lang AS run_id, doc_id AS job_id, doc_id AS job_ord, text, {SIGNATURE_SQL} AS sig FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)"
RUNS = f"{SIGNALS}, rn AS (SELECT CAST(CAST(job_id AS BIGINT) % 40 AS VARCHAR) AS run_id, count(DISTINCT job_id) AS total_jobs, count(DISTINCT CASE WHEN signal_type = 'crash' THEN job_id END) AS failed_jobs FROM (SELECT lines.job_id, signal_type FROM lines LEFT JOIN sg USING (job_id, line_no)) GROUP BY 1)"
HEALTH_SQL = """SELECT run_id, total_jobs, failed_jobs, greatest(total_jobs - failed_jobs, 0) AS passed_jobs, failed_jobs / total_jobs AS failure_ratio,
 CAST(round_even(failed_jobs / total_jobs * 100, 0)::INT AS VARCHAR) || '%' AS pct,
 CASE WHEN failed_jobs / total_jobs >= 0.7 THEN 'mass_failure' WHEN failed_jobs / total_jobs >= 0.2 THEN 'partial_failure' ELSE 'isolated' END AS classification FROM rn"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty runs of the generated jobs; a job failed if it has a crash line."""
    rows = lines(spark, sf_dir).withColumn("signal_type", extract.signal_type(F.col("line")))
    run = (F.col("job_id").cast("long") % 40).cast("string").alias("run_id")
    return rows.groupBy(run).agg(F.countDistinct("job_id").alias("total_jobs"), F.countDistinct(F.when(F.col("signal_type") == "crash", F.col("job_id"))).alias("failed_jobs"))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).withColumn("signature", clusters.signature(F.col("text")))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the cluster of their signature, all as one run."""
    return clusters.assigned(signed(spark, sf_dir).withColumn("run_id", F.lit("all")))


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a table, where a query reads them more than once."""
    return Tables(rows.sparkSession, name).put(rows, "rows")


def grouped_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, job_id, size, first_ord) of each job."""
    rows = written(members(spark, sf_dir), "members")
    return rows.select("run_id", "cluster_id", "job_id").join(clusters.exact_clusters(rows).select("run_id", "cluster_id", "size", "first_ord"), ["run_id", "cluster_id"]).drop("run_id")


def fanned_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each cluster's representative for all its jobs."""
    rows = written(members(spark, sf_dir), "members")
    reps = clusters.exact_clusters(rows).select("run_id", "cluster_id", F.col("representative_job_id").alias("job_id"))
    return clusters.fan_out(rows, verdicts.verdicts(rows.join(reps, ["run_id", "cluster_id", "job_id"])).select("run_id", "cluster_id", "failure_type", "severity"))


def results_of_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with a verdict where they have more than two members."""
    heads = written(line_heads(spark, sf_dir), "heads")
    found = heads.where("size > 1").select("run_id", "cluster_id", (F.col("size") > 2).alias("success"), F.lit("high").alias("severity"), verdicts.inferred_type(F.col("signature")).alias("failure_type"), F.format_string("seen %d", "size").alias("root_cause"))
    return clusters.with_results(heads, found).select("run_id", "cluster_id", "severity", "failure_type", "root_cause")


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages, of which every third shows the address of a log."""
    link = F.concat(F.format_string(rules.LOG_URL, F.concat(F.lit("run-"), F.col("page_id").cast("string")), F.lit("7")), F.lit("'>log</a>"))
    html = F.when(F.col("page_id") % 3 == 0, F.concat(F.coalesce("html", F.lit("")), F.lit("<a href='"), link)).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))


def suite_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): a suite page for each user, with a dated run for each type of event; its failures are the type's events, but for views."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    fails = F.when(F.col("event_type") == "view", "all pass").otherwise(F.format_string("%d fail", "n"))
    row = F.format_string('<tr><td><a href="/u%d-2024-01-02_10:00:%s/">run</a></td><td>b</td><td>c</td><td>d</td><td>%s</td></tr>', "user_id", "event_type", fails)
    rows = rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("html"))
    return rows.select(F.format_string("https://runs.example/?suite=s%d", "user_id").alias("url"), "html")


def stored_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, status, bytes, sha256): the generated logs written as files with their index, and read back; every 7th was not fetched."""
    folder = f"{Tables(spark, 'logs').folder}/store"
    text = F.when(F.col("job_ord") % 7 > 0, F.col("raw_log"))
    rows = whole_logs(spark, sf_dir).select("job_id", F.when(text.isNotNull(), "ok").otherwise("fetch_failed").alias("status"), text.alias("log_text"), F.lit("u").alias("source_url"), F.lit("a.log").alias("log_name"), F.lit(0.5).alias("elapsed_s"), F.lit("").alias("error_message"))
    report.write_logs(rows, folder)
    return logs.stored_logs(spark, folder).select("job_id", "status", "bytes", F.sha2(F.col("log_text").cast("binary"), 256).alias("sha256"))


def late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, line_no, line): the last line of each stored log, found by positions and read last."""
    folder = f"{Tables(spark, 'logs').folder}/store"
    store.write_log_files(whole_logs(spark, sf_dir).select("job_id", F.col("raw_log").alias("log_text")), folder)
    last = store.line_positions(spark, folder).groupBy("job_id").agg(F.max_by(F.struct("path", "line_no", "offset", "length"), "line_no").alias("x"))
    return store.with_text(last.select("job_id", "x.*"), "line").select("job_id", "line_no", "line")


def csv_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as CSV with their texts quoted, read back as texts."""
    folder = f"{Tables(spark, 'csv').folder}/verdicts.csv"
    report.write_csv(judged(spark, sf_dir).select("job_id", "severity", "failure_type", "error_category", "root_cause"), folder)
    return spark.read.option("header", True).option("escape", '"').csv(folder)


def line_members(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """Single failing lines, whose signatures are short enough to be similar, in four runs, or a run for each signal type."""
    rows = failing_lines(spark, sf_dir).withColumn("signature", clusters.signature(F.col("text")))
    return clusters.assigned(rows.withColumn("run_id", F.col("signal_type") if by_type else (F.split("job_id", ":")[0].cast("long") % 4).cast("string")))


def line_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.exact_clusters(line_members(spark, sf_dir))


def merged_members(members: DataFrame) -> DataFrame:
    """A row for each member with its merged cluster's name, number and size; members are found once and written."""
    members = Tables(members.sparkSession, "members").put(members, "rows")
    mapped = clusters.merge_map(clusters.exact_clusters(members))
    rows = members.select("run_id", "cluster_id", "job_id").join(mapped, ["run_id", "cluster_id"])
    return rows.select("run_id", "job_id", F.col("head").alias("cluster_id"), "cluster_no", "size")


def doc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as failures, a run for each language: many signatures, of which near copies are similar."""
    rows = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    return clusters.assigned(rows.select(F.col("lang").alias("run_id"), F.col("doc_id").alias("job_id"), F.col("doc_id").alias("job_ord"), "text", clusters.signature(F.col("text")).alias("signature")))


def run_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html): a run page for each user, with a row for each of their events; its status is the event's type."""
    row = F.format_string("<tr><td><a href='/j'>%d</a></td><td>%s</td></tr>", F.col("event_id") + 10_000, F.col("event_type"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("html"))
    return rows.select(F.format_string("https://runs.example/run-%d/", "user_id").alias("url"), "html")


def page_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = run_pages(spark, sf_dir)
    failed = logs.failed_jobs(pages).groupBy("url").agg(F.count("*").alias("failed_jobs"))
    return logs.job_counts(pages).join(failed, "url", "left").select("url", "total_jobs", F.coalesce("failed_jobs", F.lit(0)).alias("failed_jobs"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in four forms, as they are, fenced, with a comma too many, and none, judged beside one text."""
    plain = F.format_string('{"root_cause": "disk %d", "severity": "SEV2", "failure_type": "oom", "confidence": 0.7, "fix_suggestions": "a, b"}', "event_id")
    form = F.col("event_id") % 4
    reply = F.when(form == 0, plain).when(form == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).when(form == 2, F.replace(plain, F.lit('b"}'), F.lit('b",}'))).otherwise("no reply")
    rows = table(spark, sf_dir, "events").select("event_id", reply.alias("raw_reply"), F.lit("write: No space left on device").alias("text"))
    return verdicts.from_replies(rows).select("event_id", "json_valid", "root_cause", "severity", "failure_type", "confidence", (F.size("fix_suggestions").cast("long")).alias("suggestions"))


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logs_of_docs with the columns of a fetch."""
    text_or_error = F.when(F.col("status") == "ok", "").otherwise("gone")
    return logs_of_docs(spark, sf_dir).withColumns({"source_url": F.lit("u"), "log_name": F.lit("a.log"), "elapsed_s": F.lit(1.25), "error_message": text_or_error})


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, job_id, job_ord, status, log_text): the generated logs as those of two runs, both with job ids 0 to n; every 7th was not fetched."""
    number = F.col("job_ord")
    rows = written(whole_logs(spark, sf_dir), "logs").select((number % 2).cast("string").alias("run_id"), F.floor(number / 2).cast("long").alias("job_ord"), "raw_log", (number % 7).alias("m"))
    return rows.select("run_id", F.col("job_ord").cast("string").alias("job_id"), "job_ord", F.when(F.col("m") > 0, "ok").otherwise("fetch_failed").alias("status"), F.when(F.col("m") > 0, F.col("raw_log")).alias("log_text"))


def run_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of four runs in one table, each with its run and user; jobs are found once and written."""
    rows = written(jobs(spark, sf_dir).select("run_id", "job_id"), "jobs")
    of = {r: rows.where(F.col("run_id") == r).select("job_id") for r in ("0", "1", "2", "3")}
    return report.multi_run(of, {"0": "ann", "1": "bo"}).select("job_id", "run", "user", F.col("run_ord").cast("long").alias("run_ord"))


def run_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each job of two runs."""
    found = triage.triage(two_runs(spark, sf_dir))
    return found.verdicts.select("run_id", "job_id", "cluster_id", "severity", "failure_type", "root_cause", "confidence", "fallback")


def stored_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache gives for every document after two writes: of even ids, then of ids divisible by 3, which fail where 5 divides them."""
    cache = store.VerdictCache(spark, f"{Tables(spark, 'verdicts').folder}/cache")
    key = report.cache_key(F.coalesce("text", F.lit("")), MODEL, VERSION).alias("text_hash")
    results = lambda rows, mark: rows.select(key, F.col("doc_id").alias("job_ord"), F.concat(F.lit(mark), F.col("doc_id").cast("string")).alias("root_cause"), (F.col("doc_id") % 5 != 0).alias("success"))
    rows = docs(spark, sf_dir)
    cache.put(results(rows.where("doc_id % 2 = 0"), "a").withColumn("success", F.lit(True)), 1000.0)
    cache.put(results(rows.where("doc_id % 3 = 0"), "b"), 2000.0)
    return cache.get(rows.select("doc_id", key), 3000.0).select("doc_id", "root_cause", "severity", "cached")


def renewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of the documents of even id, renewed with results for those of ids divisible by 3, which fail where 5 divides them."""
    cache = doc_cache(spark, sf_dir)
    results = cache.where("answer % 3 = 0").withColumns({"answer": -F.col("answer"), "success": F.col("answer") % 5 != 0})
    return report.updated_cache(cache.where("answer % 2 = 0"), results)


def whole_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, job_ord, raw_log): the generated logs as texts."""
    rows = lines(spark, sf_dir).groupBy("job_id").agg(extract.joined_text())
    return rows.select("job_id", F.col("job_id").cast("long").alias("job_ord"), F.col("text").alias("raw_log"))


def doc_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).select(report.cache_key(F.coalesce("text", F.lit("")), MODEL, VERSION).alias("text_hash"), (F.col("doc_id") * 1000.0).alias("cached_at"), F.col("doc_id").alias("answer"))
    return report.last_by_key(rows, ["text_hash"], "cached_at")


def logs_of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as fetched logs: those without a label count as failed fetches."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("status", F.lit("ok"))
    rows = docs(spark, sf_dir).join(known, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("job_id"), F.coalesce("status", F.lit("fetch_failed")).alias("status"), F.col("text").alias("log_text"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("user", F.concat(F.lit("User"), (F.col("job_ord") % 11).cast("string")))
    return report.filtered(rows, text="failure", severity="high", users="user1; user5")


Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "log_lines": (lines, f"WITH {LINES} SELECT job_id, line_no, line FROM lines"),
    "split_lines_docs": (lambda s, d: logs.text_lines(docs(s, d), "doc_id", "text"), f"WITH {DOC_LINES} SELECT doc_id, line_no, line FROM dl"),
    "error_hits": (lambda s, d: extract.error_hits(lines(s, d)), f"WITH {ERRORS} SELECT job_id, line_no, line FROM hits"),
    "signal_rows": (lambda s, d: extract.signals(lines(s, d)), f"WITH {SIGNALS} SELECT job_id, line_no, line, signal_type FROM sg"),
    "signal_counts": (
        lambda s, d: lines(s, d).groupBy(F.coalesce(extract.signal_type(F.col("line")), F.lit("none")).alias("signal_type")).agg(F.count("*").alias("n"), F.countDistinct("job_id").alias("jobs")),
        f"WITH {LINES} SELECT coalesce({signal_sql()}, 'none') AS signal_type, count(*) AS n, count(DISTINCT job_id) AS jobs FROM lines GROUP BY 1",
    ),
    "signal_top5_per_type": (
        lambda s, d: extract.first_signals(lines(s, d)).select("job_id", "signal_type", F.col("type_no").cast("long").alias("type_no"), F.col("item_no").cast("long").alias("item_no"), "line"),
        f"""WITH {SIGNALS}, u AS (SELECT job_id, signal_type, {STRIP("line")} AS line, min(line_no) AS pos FROM sg GROUP BY 1, 2, 3),
a AS (SELECT *, min(pos) OVER (PARTITION BY job_id, signal_type) AS started, row_number() OVER (PARTITION BY job_id, signal_type ORDER BY pos) AS item_no FROM u),
b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY started, item_no) AS n FROM a WHERE item_no <= 5)
SELECT job_id, signal_type, dense_rank() OVER (PARTITION BY job_id ORDER BY started) AS type_no, item_no, line FROM b WHERE n <= 15""",
    ),
    "error_blocks": (lambda s, d: extract.error_blocks(lines(s, d)), f"WITH {BLOCKS} SELECT * FROM bl"),
    "error_block_dedup": (
        lambda s, d: extract.deduplicated(extract.error_blocks(lines(s, d))),
        f"""WITH {BLOCKS}, f AS (SELECT *, {fingerprint_sql("text")} AS fp FROM bl),
g AS (SELECT *, count(*) OVER (PARTITION BY job_id, fp) AS repeats, row_number() OVER (PARTITION BY job_id, fp ORDER BY start_line) AS rn FROM f)
SELECT job_id, start_line, end_line, repeats, fp, CASE WHEN repeats > 1 THEN '[Repeated ' || repeats || 'x] ' ELSE '' END || text AS text FROM g WHERE rn = 1""",
    ),
    "context_windows": (
        lambda s, d: extract.context_windows(lines(s, d)),
        f"""WITH {LINES}, st AS (SELECT * FROM lines WHERE {STRONG}), {islands_sql("st", 30, 10, 5)}
SELECT sp.job_id, CAST(island AS BIGINT) AS window_no, start_line, end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM sp JOIN lines ON sp.job_id = lines.job_id AND line_no BETWEEN start_line AND end_line
WHERE island <= 5 AND NOT {matches("line", rules.NOISE)} GROUP BY 1, 2, 3, 4""",
    ),
    "stderr_lookback": (
        lambda s, d: extract.command_stderr(lines(s, d)),
        f"""WITH {LINES}, w AS (SELECT *, regexp_extract(line, {quoted(rules.REMOTE_HOST)}, 1) AS h, {matches("line", rules.COMMAND_FAILED)} AS cf FROM lines),
n AS (SELECT *, coalesce(nullif(lag(h, 3) OVER o, ''), nullif(lag(h, 2) OVER o, ''), nullif(lag(h, 1) OVER o, '')) AS near FROM w WINDOW o AS (PARTITION BY job_id ORDER BY line_no)),
f AS (SELECT job_id, line_no AS fail_line, CASE WHEN cf THEN regexp_extract(line, {quoted(rules.COMMAND_FAILED)}, 1) ELSE near END AS host,
  try_cast(CASE WHEN cf THEN regexp_extract(line, {quoted(rules.COMMAND_FAILED)}, 2) ELSE regexp_extract(line, {quoted(rules.EXIT_CODE)}, 1) END AS BIGINT) AS status, cf FROM n),
g AS (SELECT * FROM f WHERE cf OR (status > 0 AND host IS NOT NULL)),
b AS (SELECT g.job_id, fail_line, host, status, line_no, line, regexp_extract(line, {quoted(rules.REMOTE_STDERR)}, 1) = host AS own, {STRIP(f"regexp_extract(line, {quoted(rules.REMOTE_STDERR)}, 2)")} AS content
  FROM g JOIN lines ON g.job_id = lines.job_id AND line_no < fail_line AND line_no >= fail_line - 50),
c AS (SELECT *, NOT own AND contains(line, 'run.' || host || ':>') AS cmd FROM b),
e AS (SELECT *, max(CASE WHEN cmd THEN line_no END) OVER (PARTITION BY job_id, fail_line) AS stop, own AND content <> '' AND NOT {matches("line", rules.NOISE)} AS taken,
  NOT own AND NOT cmd AND {matches("line", rules.REMOTE_COMMAND)} AND NOT contains(line, host) AS other FROM c),
h AS (SELECT *, max(CASE WHEN taken AND line_no > coalesce(stop, -1) THEN line_no END) OVER (PARTITION BY job_id, fail_line) AS nearest FROM e),
i AS (SELECT *, greatest(coalesce(stop, -1), coalesce(max(CASE WHEN other AND line_no < nearest THEN line_no END) OVER (PARTITION BY job_id, fail_line), -1)) AS cut FROM h)
SELECT job_id, fail_line, host, status, coalesce(max(CASE WHEN cmd AND line_no = stop AND stop = cut THEN {STRIP(f"regexp_extract(line, {quoted(rules.COMMAND_TEXT)}, 1)")} END), '') AS command,
  count(*) FILTER (taken AND line_no > cut) AS n_stderr, string_agg(content, chr(10) ORDER BY line_no) FILTER (taken AND line_no > cut) AS stderr
FROM i GROUP BY 1, 2, 3, 4 HAVING count(*) FILTER (taken AND line_no > cut) > 0""",
    ),
    "failure_reason_last": (
        lambda s, d: extract.failure_reason(lines(s, d)),
        f"""WITH {LINES}, q AS (SELECT *, max(line_no) OVER (PARTITION BY job_id) + 1 AS n FROM lines),
r AS (SELECT *, max(line_no) FILTER (starts_with(trim(line), 'failure_reason:') AND (n < 500 OR line_no >= n - 499)) OVER (PARTITION BY job_id) AS pos FROM q),
s AS (SELECT *, min(line_no) FILTER (line_no > pos AND NOT starts_with(line, '  ')) OVER (PARTITION BY job_id) AS stop FROM r WHERE line_no >= pos)
SELECT job_id, string_agg(trim(line), ' ' ORDER BY line_no) AS reason FROM s WHERE stop IS NULL OR line_no < stop GROUP BY 1""",
    ),
    "tail_summary": (
        lambda s, d: extract.tail_summary(lines(s, d)),
        f"""WITH {LINES}, a AS (SELECT *, max(line_no) OVER (PARTITION BY job_id) + 1 AS n, {matches("trim(line)", rules.SUMMARY_DATA)} AS data FROM lines),
b AS (SELECT *, max(line_no) FILTER (data AND (n < 500 OR line_no > n - 500)) OVER (PARTITION BY job_id) AS last,
  max(line_no) FILTER ({matches("line", rules.SUMMARY_HEADER)} AND (n < 2000 OR line_no > n - 2000)) OVER (PARTITION BY job_id) AS head FROM a),
c AS (SELECT *, max(line_no) FILTER (NOT data AND line_no < last) OVER (PARTITION BY job_id) AS above,
  min(line_no) FILTER (NOT data AND trim(line) <> '' AND NOT starts_with(trim(line), '-') AND line_no > last) OVER (PARTITION BY job_id) AS below FROM b),
e AS (SELECT job_id, line_no, line, CASE WHEN last IS NOT NULL THEN 'data' WHEN head IS NOT NULL THEN 'header' ELSE 'tail' END AS kind,
  CASE WHEN last IS NOT NULL THEN coalesce(above + 1, 0) WHEN head IS NOT NULL THEN head ELSE greatest(n - 150, 0) END AS start_line,
  CASE WHEN last IS NOT NULL THEN least(coalesce(below, n), last + 300, n) WHEN head IS NOT NULL THEN least(head + 300, n) ELSE n END AS stop FROM c)
SELECT job_id, kind, start_line, stop - 1 AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM e WHERE line_no >= start_line AND line_no < stop GROUP BY 1, 2, 3, 4""",
    ),
    "tracebacks": (lambda s, d: extract.tracebacks(lines(s, d)), f"WITH RECURSIVE {TRACES} SELECT job_id, tr AS trace_no, min(line_no) AS start_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM tb GROUP BY 1, 2"),
    "condensed_logs": (lambda s, d: condense.condensed(lines(s, d)), None),
    "fingerprint_docs": (
        lambda s, d: docs(s, d).select("doc_id", text.fingerprint(F.coalesce("text", F.lit(""))).alias("fp")),
        f"SELECT doc_id, {fingerprint_sql("coalesce(text, '')")} AS fp FROM documents",
    ),
    "dedup_with_count": (
        lambda s, d: logs.text_lines(docs(s, d), "doc_id", "text").groupBy("line").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1"),
        f"WITH {DOC_LINES} SELECT line, count(*) AS n, min(doc_id) AS first_doc FROM dl GROUP BY 1 HAVING count(*) > 1",
    ),
    "signature_hash_groups": (
        grouped_members,
        f"WITH {CLUSTERED} SELECT cluster_id, job_id, count(*) OVER (PARTITION BY cluster_id) AS size, min(job_ord) OVER (PARTITION BY cluster_id) AS first_ord FROM cl",
    ),
    "cluster_representative": (
        lambda s, d: clusters.exact_clusters(members(s, d)).select("cluster_id", "representative_job_id", "text_length"),
        f"""WITH {CLUSTERED} SELECT cluster_id, job_id AS representative_job_id, length(text) AS text_length
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY length(text) DESC, job_ord) AS rn FROM cl) WHERE rn = 1""",
    ),
    "jaccard_pairs": (
        lambda s, d: clusters.similar_pairs(failing_lines(s, d), "text"),
        f"""WITH {FAILING}, {TOKEN_SETS} SELECT x.head AS a, y.head AS b, len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) AS similarity FROM hd x JOIN hd y ON x.head < y.head
WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) >= 0.7""",
    ),
    "jaccard_members": (
        lambda s, d: clusters.token_sets(failing_lines(s, d), "text"),
        f"WITH {FAILING}, {TOKEN_SETS} SELECT text, head FROM ts JOIN hd USING (t)",
    ),
    "cluster_merge": (lambda s, d: merged_members(line_members(s, d)), f"WITH RECURSIVE {LINE_CLUSTERS}, {merge_sql('SELECT run_id, cluster_id, job_id, job_ord, sig, text FROM lc')}"),
    "cluster_merge_docs": (lambda s, d: merged_members(doc_members(s, d)), f"WITH RECURSIVE {merge_sql(DOC_CLUSTERS)}"),
    "run_health": (lambda s, d: report.run_health(runs(s, d)), f"WITH {RUNS} {HEALTH_SQL}"),
    "run_health_by_type": (
        lambda s, d: report.run_health(runs(s, d)).groupBy("classification").agg(F.count("*").alias("runs"), F.sum("failed_jobs").alias("failed_jobs")),
        f"WITH {RUNS} SELECT classification, count(*) AS runs, sum(failed_jobs)::BIGINT AS failed_jobs FROM ({HEALTH_SQL}) GROUP BY 1",
    ),
    "usable_vs_fallback": (
        lambda s, d: report.usable(logs_of_docs(s, d)).select("job_id", F.lit("usable").alias("kind")).unionByName(report.fallbacks(logs_of_docs(s, d)).select("job_id", F.lit("fallback").alias("kind"))),
        "SELECT doc_id AS job_id, CASE WHEN coalesce(text, '') <> '' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) THEN 'usable' ELSE 'fallback' END AS kind FROM documents",
    ),
    "verdict_fanout": (
        fanned_out,
        f"""WITH {CLUSTERED}, rp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY length(text) DESC, job_ord) AS rn FROM cl) WHERE rn = 1),
v AS (SELECT cluster_id, {TYPE_SQL} AS t, {PSEV_SQL} AS ps FROM rp)
SELECT 'all' AS run_id, cl.cluster_id, cl.job_id, t AS failure_type, CASE WHEN t IN ('crash', 'config', 'resource', 'permission', 'test_bug') AND coalesce(ps, 'medium') = 'medium' THEN 'high' ELSE coalesce(ps, 'medium') END AS severity
FROM cl JOIN v USING (cluster_id)""",
    ),
    "infer_failure_type": (lambda s, d: failing_lines(s, d).select("job_id", verdicts.inferred_type(F.col("text")).alias("failure_type")), f"WITH {FAILING} SELECT job_id, {TYPE_SQL} AS failure_type FROM fl"),
    "concrete_pattern": (
        lambda s, d: failing_lines(s, d).select("job_id", verdicts.concrete(F.col("text"), 0).alias("failure_type"), verdicts.concrete(F.col("text"), 1).alias("severity")),
        f"WITH {FAILING} SELECT job_id, {PTYPE_SQL} AS failure_type, {PSEV_SQL} AS severity FROM fl",
    ),
    "heuristic_verdict": (
        lambda s, d: verdicts.verdicts(failing_lines(s, d)).select("job_id", "job_ord", "root_cause", "severity", "failure_type", "error_category", "confidence"),
        f"WITH {VERDICTS} SELECT * FROM v2",
    ),
    "severity_breakdown": (lambda s, d: report.breakdown(judged(s, d), "severity"), f"WITH {JUDGED} SELECT severity AS value, count(*) AS n FROM jd GROUP BY 1"),
    "type_breakdown": (lambda s, d: report.breakdown(judged(s, d), "failure_type"), f"WITH {JUDGED} SELECT failure_type AS value, count(*) AS n FROM jd GROUP BY 1"),
    "needs_attention": (
        lambda s, d: report.needs_attention(judged(s, d)).select("job_id", "severity", "failure_type", "confidence", "fallback"),
        f"WITH {JUDGED} SELECT job_id, severity, failure_type, confidence, fallback FROM jd WHERE NOT success OR fallback OR confidence < 0.6 OR failure_type = 'unknown'",
    ),
    "snapshot_cards": (
        lambda s, d: report.snapshot(judged(s, d)),
        f"""WITH {JUDGED} SELECT count(*) AS jobs, count(*) FILTER (success) AS ok, count(*) FILTER (fallback) AS fallback, count(*) FILTER (success AND confidence < 0.6) AS low_confidence,
count(*) FILTER (success AND failure_type = 'unknown') AS unknown_type, count(*) FILTER (contains(lower(error_category), 'artifact availability')) AS unavailable,
count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM jd""",
    ),
    "severity_sorted_topn": (
        lambda s, d: report.top_by_severity(judged(s, d), "failure_type", 10).select("job_id", "failure_type", "severity", F.col("place").cast("long").alias("place")),
        f"WITH {JUDGED} SELECT * FROM (SELECT job_id, failure_type, severity, row_number() OVER (PARTITION BY failure_type ORDER BY {RANK_SQL.format('severity')}, job_ord) AS place FROM jd) WHERE place <= 10",
    ),
    "multi_run_union": (
        run_union,
        f"WITH {JOBS} SELECT job_id, run_id AS run, CASE run_id WHEN '0' THEN 'ann' WHEN '1' THEN 'bo' ELSE '' END AS user, CAST(run_id AS BIGINT) AS run_ord FROM jb",
    ),
    "normalize_aliases": (
        lambda s, d: table(s, d, "events").select("event_id", verdicts.normal_severity(F.concat(F.lit(" SEV"), (F.col("event_id") % 7).cast("string"))).alias("severity"), verdicts.normal_type(F.element_at(F.array(*(F.lit(x) for x in ("Connection", "test-failure", "o.o.m", "infra issue", "banana"))), (F.col("event_id") % 5 + 1).cast("int"))).alias("failure_type")),
        "SELECT event_id, CASE event_id % 7 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 4 THEN 'low' ELSE 'medium' END AS severity, (['network', 'test_bug', 'resource', 'infra', 'unknown'])[event_id % 5 + 1] AS failure_type FROM events",
    ),
    "json_props_validate": (
        lambda s, d: table(s, d, "events").select("event_id", F.try_variant_get(verdicts.parsed_reply(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "$.k", "bigint").alias("k"), verdicts.valid_reply(verdicts.parsed_reply(F.col("props"))).alias("valid")),
        "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS valid FROM events",
    ),
    "url_validate_slug": (
        lambda s, d: logs.url_parts(table(s, d, "pages").select("page_id", "url")).select("page_id", "valid", "suite_page", "slug"),
        r"""SELECT page_id, regexp_matches(url, '(?i)^https?://[^/?#]+') AS valid, regexp_matches(url, '[?&](suite|branch|machine_type|status|sha1)=') OR b = '' OR (regexp_matches(b, '^[A-Za-z-]+$') AND length(b) < 30) AS suite_page,
coalesce(nullif(substr(regexp_replace(string_split(b, '/')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80), ''), 'run') AS slug
FROM (SELECT *, regexp_replace(regexp_extract(url, '^[^:/]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS b FROM pages)""",
    ),
    "page_links": (links, """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages) GROUP BY 1, 2"""),
    "clip_middle_docs": (
        lambda s, d: docs(s, d).select("doc_id", text.clip_middle(F.coalesce("text", F.lit("")), 300).alias("clipped")),
        f"""SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE CASE WHEN strpos(reverse(h), chr(10)) > 0 THEN substr(h, 1, 200 - strpos(reverse(h), chr(10))) ELSE h END || replace({quoted(rules.CLIP_MARK.replace(chr(10), "~"))}, '~', chr(10)) ||
CASE WHEN strpos(e, chr(10)) > 0 THEN substr(e, strpos(e, chr(10))) ELSE e END END AS clipped FROM (SELECT doc_id, coalesce(text, '') AS t, substr(coalesce(text, ''), 1, 200) AS h, right(coalesce(text, ''), 100) AS e FROM documents)""",
    ),
    "truncate_docs": (
        lambda s, d: docs(s, d).select("doc_id", text.truncated(F.coalesce("text", F.lit("")), 500).alias("text")),
        "SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 500 THEN coalesce(text, '') ELSE substr(text, 1, 500) || replace('~~... [truncated for HTML report size] ...~(showing first 500 of ', '~', chr(10)) || format('{:,}', length(text)) || ' chars)' END AS text FROM documents",
    ),
    "cache_key": (
        lambda s, d: docs(s, d).select("doc_id", report.cache_key(F.coalesce("text", F.lit("")), MODEL, VERSION).alias("text_hash")),
        f"SELECT doc_id, substr(sha256('{MODEL}' || chr(10) || '{VERSION}' || chr(10) || coalesce(text, '')), 1, 32) AS text_hash FROM documents",
    ),
    "cached_left_join": (
        lambda s, d: report.from_cache(docs(s, d).select("doc_id", report.cache_key(F.coalesce("text", F.lit("")), MODEL, VERSION).alias("text_hash")), doc_cache(s, d).where("answer % 2 = 0"), 1e6).select("doc_id", "answer", "cached"),
        """WITH c AS (SELECT coalesce(text, '') AS t, max(doc_id) AS answer FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN hit THEN answer END AS answer, coalesce(hit, false) AS cached FROM (SELECT doc_id, answer, answer % 2 = 0 AND answer * 1000.0 > 1e6 - 604800 AS hit FROM documents d JOIN c ON coalesce(d.text, '') = c.t)""",
    ),
    "user_filter": (
        lambda s, d: users(s, d).select("job_id", "severity", "user"),
        f"""WITH {JUDGED} SELECT job_id, severity, 'User' || CAST(job_ord % 11 AS VARCHAR) AS user FROM jd
WHERE contains(lower(concat_ws(' ', job_id, root_cause, error_category)), 'failure') AND severity = 'high' AND (contains('user' || CAST(job_ord % 11 AS VARCHAR), 'user1') OR contains('user' || CAST(job_ord % 11 AS VARCHAR), 'user5'))""",
    ),
    "run_page_jobs": (
        page_jobs,
        "SELECT 'https://runs.example/run-' || user_id || '/' AS url, count(DISTINCT event_id) AS total_jobs, count(DISTINCT event_id) FILTER (event_type = 'error') AS failed_jobs FROM events GROUP BY user_id",
    ),
    "log_urls": (
        lambda s, d: logs.log_urls(table(s, d, "events").select(F.lit("run").alias("run_name"), F.col("user_id").cast("string").alias("job_id")).distinct()),
        """SELECT 'run' AS run_name, job_id, place, 'https://qa-proxy.ceph.com/teuthology/run/' || job_id || '/' || log_name AS url, log_name
FROM (SELECT DISTINCT user_id::VARCHAR AS job_id FROM events), (VALUES (0::BIGINT, 'teuthology.log'), (1, 'ansible.log')) v(place, log_name)""",
    ),
    "run_names": (
        lambda s, d: logs.run_names(linked_pages(s, d)).select("page_id", "run_name"),
        r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'run-' || page_id ELSE nullif(regexp_extract(regexp_replace(regexp_extract(url, '^[^:/]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/([^/]+)$', 1), '') END AS run_name FROM pages",
    ),
    "reply_verdicts": (
        replies,
        """SELECT event_id, f < 3 AS json_valid, CASE WHEN f < 3 THEN 'disk ' || event_id ELSE 'Likely resource failure (heuristic)' END AS root_cause, 'high' AS severity, 'resource' AS failure_type,
CASE WHEN f < 3 THEN 0.7 ELSE 0.65 END::DOUBLE AS confidence, CASE WHEN f < 3 THEN 2 ELSE 1 END::BIGINT AS suggestions FROM (SELECT event_id, event_id % 4 AS f FROM events)""",
    ),
    "ungrounded_causes": (
        lambda s, d: table(s, d, "events").select("event_id", verdicts.ungrounded(F.element_at(F.array(F.lit("boto3 broke"), F.lit("the 'missing thing' broke"), F.concat(F.lit("a '"), "event_type", F.lit("' came"))), (F.col("event_id") % 3 + 1).cast("int")), F.concat(F.lit("an "), "event_type", F.lit(" event"))).alias("ungrounded")),
        "SELECT event_id, event_id % 3 < 2 AS ungrounded FROM events",
    ),
    "parse_stats": (
        lambda s, d: condense.parse_stats(condense.parsed(written(whole_logs(s, d), "logs"))).drop("condensed_chars"),
        f"""WITH RECURSIVE {TRACES}, hits AS (SELECT * FROM lines WHERE {matches('line', rules.ERROR_WORD)} AND NOT {matches('line', rules.NOISE)}), {islands_sql("hits", 5, 5, 1)},
bl AS (SELECT sp.job_id, start_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM sp JOIN lines ON sp.job_id = lines.job_id AND line_no BETWEEN start_line AND end_line GROUP BY 1, 2),
bn AS (SELECT job_id, count(DISTINCT {fingerprint_sql("text")}) AS error_blocks FROM bl GROUP BY 1), tn AS (SELECT job_id, count(DISTINCT tr) AS tracebacks FROM tb GROUP BY 1),
ln2 AS (SELECT job_id, count(*) AS total_lines, length(string_agg(line, chr(10))) AS total_chars FROM lines GROUP BY 1)
SELECT job_id, total_lines, total_chars, coalesce(tracebacks, 0) AS tracebacks, coalesce(error_blocks, 0) AS error_blocks FROM ln2 LEFT JOIN tn USING (job_id) LEFT JOIN bn USING (job_id)""",
    ),
    "systemic_warnings": (
        lambda s, d: report.systemic_warning(clusters.exact_clusters(line_members(s, d, by_type=True))),
        f"""WITH {LINE_CLUSTERS}, g AS (SELECT signal_type, cluster_id, count(*) AS size FROM lc GROUP BY 1, 2), r AS (SELECT signal_type AS run_id, count(*) AS c, sum(size) AS j, max(size) AS m FROM g GROUP BY 1)
SELECT run_id, CASE WHEN c = 1 AND m > 5 THEN 'single cause' ELSE 'few causes' END AS warning FROM r WHERE (c = 1 AND m > 5) OR (c <= 3 AND j > 20)""",
    ),
    "cluster_numbers": (
        lambda s, d: clusters.number(line_heads(s, d)).select("run_id", "cluster_id", F.col("cluster_no").cast("long").alias("cluster_no"), "size"),
        f"""WITH {LINE_CLUSTERS}, g AS (SELECT run_id, cluster_id, count(*) AS size, min(job_ord) AS o FROM lc GROUP BY 1, 2)
SELECT run_id, cluster_id, row_number() OVER (PARTITION BY run_id ORDER BY size DESC, o) AS cluster_no, size FROM g""",
    ),
    "cluster_job_links": (
        lambda s, d: clusters.job_links(line_members(s, d)).select("run_id", "cluster_id", "links", "more"),
        f"""WITH {LINE_CLUSTERS}, g AS (SELECT *, row_number() OVER o AS p, count(*) OVER (PARTITION BY run_id, cluster_id) AS n FROM lc WINDOW o AS (PARTITION BY run_id, cluster_id ORDER BY job_ord))
SELECT run_id, cluster_id, string_agg(job_id, ', ' ORDER BY p) FILTER (p <= 10) AS links, CASE WHEN any_value(n) > 10 THEN '+' || any_value(n) - 10 || ' more' ELSE '' END AS more FROM g GROUP BY 1, 2""",
    ),
    "calls_saved": (
        lambda s, d: clusters.calls_saved(line_heads(s, d)),
        f"WITH {LINE_CLUSTERS} SELECT run_id, count(*) AS jobs, count(DISTINCT cluster_id) AS clusters, count(*) - count(DISTINCT cluster_id) AS saved FROM lc GROUP BY 1",
    ),
    "cluster_results": (
        results_of_clusters,
        f"""WITH {LINE_CLUSTERS}, g AS (SELECT run_id, cluster_id, any_value(sig) AS sig, count(*) AS n FROM lc GROUP BY 1, 2), t AS (SELECT *, sig AS text FROM g),
v AS (SELECT run_id, cluster_id, sig, n, {TYPE_SQL} AS kind FROM t)
SELECT run_id, cluster_id, CASE WHEN n > 2 THEN 'high' ELSE '?' END AS severity, CASE WHEN n > 2 THEN kind ELSE chr(8212) END AS failure_type,
CASE WHEN n > 2 THEN 'seen ' || n ELSE substr(sig, 1, 120) END AS root_cause FROM v""",
    ),
    "suite_runs": (
        lambda s, d: logs.suite_runs(suite_pages(s, d)).select("suite_url", "run_url", F.col("fail_count").cast("long").alias("fail_count"), "user"),
        """WITH g AS (SELECT user_id, event_type, CASE WHEN event_type = 'view' THEN 0 ELSE count(*) END AS n FROM events GROUP BY 1, 2), a AS (SELECT user_id, max(n) AS most FROM g GROUP BY 1)
SELECT 'https://runs.example/?suite=s' || user_id AS suite_url, '/u' || user_id || '-2024-01-02_10:00:' || event_type || '/' AS run_url, n AS fail_count, 'u' || user_id AS user FROM g JOIN a USING (user_id) WHERE n > 0 OR most = 0""",
    ),
    "stored_logs": (
        stored_and_read,
        f"""WITH {LINES}, t AS (SELECT job_id, string_agg(line, chr(10) ORDER BY line_no) AS t, CAST(job_id AS BIGINT) % 7 > 0 AS k FROM lines GROUP BY 1)
SELECT job_id, CASE WHEN k THEN 'ok' ELSE 'fetch_failed' END AS status, CASE WHEN k THEN octet_length(encode(t)) ELSE 0 END AS bytes, CASE WHEN k THEN sha256(t) END AS sha256 FROM t""",
    ),
    "late_lines": (late_lines, f"WITH {LINES} SELECT job_id, max(line_no) AS line_no, arg_max(line, line_no) AS line FROM lines GROUP BY 1"),
    "csv_round_trip": (csv_and_back, f"WITH {JUDGED} SELECT job_id, severity, failure_type, error_category, root_cause FROM jd"),
    "job_filter": (lambda s, d: logs.only_jobs(lines(s, d), "1, 3,,12"), f"WITH {LINES} SELECT job_id, line_no, line FROM lines WHERE job_id IN ('1', '3', '12')"),
    "html_escape_docs": (
        lambda s, d: docs(s, d).select("doc_id", text.html_escape(F.coalesce("text", F.lit(""))).alias("text")),
        "SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS text FROM documents",
    ),
    "recommended_actions": (
        lambda s, d: verdicts.verdicts(failing_lines(s, d)).select("job_id", "recommended_action", F.element_at("fix_suggestions", 1).alias("suggestion")),
        f"WITH {VERDICTS}, x AS (SELECT job_id, {map_sql('failure_type', rules.ACTIONS, quoted(rules.ACTIONS['unknown']))} AS a FROM v2) SELECT job_id, a AS recommended_action, a AS suggestion FROM x",
    ),
    "verdicts_with_logs": (
        lambda s, d: report.with_logs(judged(s, d).select("job_id", "root_cause"), whole_logs(s, d).select("job_id", "job_ord", F.length("raw_log").cast("long").alias("total_chars"))).select("job_id", "root_cause", "total_chars"),
        f"WITH {JUDGED}, sz AS (SELECT job_id, length(string_agg(line, chr(10))) AS total_chars FROM lines GROUP BY 1) SELECT jd.job_id, root_cause, total_chars FROM jd LEFT JOIN sz USING (job_id)",
    ),
    "effective_totals": (
        lambda s, d: report.effective_totals(runs(s, d).withColumn("total_jobs", F.lit(3).cast("long")), lines(s, d).select((F.col("job_id").cast("long") % 40).cast("string").alias("run_id"), "job_id").distinct()),
        f"WITH {RUNS} SELECT run_id, greatest(3, total_jobs) AS total_jobs, failed_jobs FROM rn",
    ),
    "status_bands": (
        lambda s, d: report.status_pill(judged(s, d)).select("job_id", "status", "band"),
        f"""WITH {JUDGED} SELECT job_id, CASE WHEN fallback THEN 'fallback analysis' ELSE 'analysis available' END AS status,
CASE WHEN trunc(confidence * 100) >= 75 THEN 'high' WHEN trunc(confidence * 100) >= 50 THEN 'medium' ELSE 'low' END AS band FROM jd""",
    ),
    "run_facets": (
        lambda s, d: report.run_facets(judged(s, d).withColumns({"user": F.when(F.col("job_ord") % 3 > 0, F.concat(F.lit("u"), (F.col("job_ord") % 3).cast("string"))), "run": (F.col("job_ord") % 2).cast("string")})),
        f"WITH {JUDGED} SELECT string_agg(DISTINCT failure_type, ',' ORDER BY failure_type) AS failure_types, string_agg(DISTINCT 'u' || job_ord % 3, ',' ORDER BY 'u' || job_ord % 3) FILTER (job_ord % 3 > 0) AS users, count(DISTINCT CASE WHEN job_ord % 3 > 0 THEN job_ord % 3 END) > 1 OR count(DISTINCT job_ord % 2) > 1 AS multi_run FROM jd",
    ),
    "attention_limit": (lambda s, d: report.left_out(report.needs_attention(judged(s, d)), 5), f"WITH {JUDGED} SELECT '+' || count(*) - 5 || ' more' AS more FROM jd WHERE NOT success OR fallback OR confidence < 0.6 OR failure_type = 'unknown'"),
    "log_index": (
        lambda s, d: report.index_rows(fetched(s, d)),
        """SELECT doc_id AS job_id, CASE WHEN k THEN 'ok' ELSE 'fetch_failed' END AS status, CASE WHEN k THEN doc_id || '.log' ELSE '' END AS log_path, 'u' AS fetched_from, 'a.log' AS log_name,
CASE WHEN k THEN octet_length(encode(text)) ELSE 0 END AS bytes, '1.250' AS elapsed_s, CASE WHEN l THEN '' ELSE 'gone' END AS error_message
FROM (SELECT doc_id, text, lb IS NOT NULL AS l, lb IS NOT NULL AND text IS NOT NULL AS k FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 1 AS lb FROM labels) USING (doc_id))""",
    ),
    "renewed_cache": (
        renewed,
        """WITH c AS (SELECT substr(sha256('rules' || chr(10) || 'v1' || chr(10) || coalesce(text, '')), 1, 32) AS text_hash, max(doc_id) AS answer FROM documents GROUP BY 1),
n AS (SELECT text_hash, answer * 1000.0::DOUBLE AS cached_at, -answer AS answer FROM c WHERE answer % 3 = 0 AND answer % 5 <> 0)
SELECT * FROM n UNION ALL SELECT text_hash, answer * 1000.0::DOUBLE, answer FROM c WHERE answer % 2 = 0 AND text_hash NOT IN (SELECT text_hash FROM n)""",
    ),
    "run_verdicts": (run_verdicts, None),
    "stored_verdicts": (
        stored_verdicts,
        """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT t, 'a' || max(doc_id) AS c FROM t WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT t, 'b' || max(doc_id) AS c FROM t WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0 GROUP BY 1)
SELECT doc_id, coalesce(b.c, a.c) AS root_cause, CASE WHEN coalesce(b.c, a.c) IS NOT NULL THEN 'medium' END AS severity, coalesce(b.c, a.c) IS NOT NULL AS cached FROM t LEFT JOIN a USING (t) LEFT JOIN b USING (t)""",
    ),
    "export_json": (
        lambda s, d: report.export_rows(judged(s, d).drop("root_cause")),
        f"WITH {JUDGED} SELECT json_object('job_id', job_id, 'severity', severity, 'failure_type', failure_type, 'confidence', confidence, 'error_category', error_category)::VARCHAR AS json FROM jd",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: compiled(f) for k, (f, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in Q.items() if sql}
