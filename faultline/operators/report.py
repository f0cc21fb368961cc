"""Run health, breakdowns, rankings, cached results and exports of verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.extract import keys
from faultline.operators.verdicts import rank
from faultline.sources.store import KEPT, write_log_files

FALLBACK = {
    "root_cause": "The job's log could not be fetched.",
    "severity": "medium",
    "failure_type": "infra",
    "error_category": "artifact availability issue",
    "confidence": 1.0,
}


def run_health(runs: DataFrame) -> DataFrame:
    """runs (run_id, total_jobs, failed_jobs) with passed_jobs, failure_ratio, pct and classification."""
    ratio = F.when(F.col("total_jobs") > 0, F.col("failed_jobs") / F.col("total_jobs")).otherwise(0.0)
    out = runs.withColumns({"passed_jobs": F.greatest(F.col("total_jobs") - F.col("failed_jobs"), F.lit(0)), "failure_ratio": ratio})
    kind = F.when(F.col("failure_ratio") >= 0.7, "mass_failure").when(F.col("failure_ratio") >= 0.2, "partial_failure").otherwise("isolated")
    return out.withColumns({"pct": half_even(F.col("failure_ratio")), "classification": kind})


def effective_totals(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """runs (run_id, total_jobs, ...) whose total is at least the number of the run's logs."""
    n = logs.groupBy(F.col("run_id").alias("of_run")).agg(F.count("*").alias("logs"))
    rows = runs.join(n, F.col("run_id") == F.col("of_run"), "left").drop("of_run")
    return rows.withColumn("total_jobs", F.greatest(F.col("total_jobs"), F.coalesce("logs", F.lit(0)))).drop("logs")


def half_even(ratio: Column) -> Column:
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))


def cut_percent(ratio: Column) -> Column:
    return F.concat((ratio * 100).cast("int").cast("string"), F.lit("%"))


def half_up(ratio: Column) -> Column:
    return F.concat(F.floor(ratio * 100 + 0.5).cast("string"), F.lit("%"))


USABLE = "coalesce(status = 'ok' and log_text <> '', false)"


def usable(logs: DataFrame) -> DataFrame:
    return logs.where(USABLE)


def fallbacks(logs: DataFrame) -> DataFrame:
    """A fixed verdict for each log that is not usable, with its run where logs have one."""
    return logs.where(f"not {USABLE}").select(*keys(logs), *(F.lit(v).alias(k) for k, v in FALLBACK.items()))


def with_logs(verdicts: DataFrame, parsed: DataFrame) -> DataFrame:
    """verdicts with what parsing found in their job's log, null without one; of logs that repeat a job the last counts."""
    k = keys(verdicts)
    rest = [c for c in parsed.columns if c not in k]
    last = parsed.groupBy(*k).agg(F.max_by(F.struct(*rest), "job_ord").alias("_log"))
    return verdicts.join(last, k, "left").select(verdicts["*"], *(F.col(f"_log.{c}").alias(c) for c in rest if c not in verdicts.columns))


def breakdown(verdicts: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    """(value, n): counts of a column, most first, then by name; null and empty count as the default."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))
    return verdicts.groupBy(value.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def by_severity(verdicts: DataFrame, order: str = "job_ord") -> DataFrame:
    """Gravest first, equals in input order; no severity of the list comes last."""
    return verdicts.orderBy(rank(F.col("severity")), order)


def top_by_severity(verdicts: DataFrame, group: str, most: int, order: str = "job_ord") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(rank(F.col("severity")), order))
    return verdicts.withColumn("place", place).where(F.col("place") <= most)


def by_confidence(verdicts: DataFrame, order: str = "job_ord") -> DataFrame:
    """Surest first; no confidence counts as none."""
    return verdicts.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), order)


def by_job_id(verdicts: DataFrame) -> DataFrame:
    """In order of job id, runs of digits by their value: job9 before job10."""
    digits = F.regexp_extract_all("job_id", F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    # a number of more digits is the larger one
    value = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    padded = F.transform(digits, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(value(x)).cast("string"), 10, "0"), value(x))).otherwise(F.lower(x)))
    return verdicts.orderBy(padded, "job_id")


def by_user(verdicts: DataFrame, order: str = "job_ord") -> DataFrame:
    """In order of user, gravest first."""
    return verdicts.orderBy(F.coalesce("user", F.lit("")), rank(F.col("severity")), order)


def limited(verdicts: DataFrame, most: int = 30, order: str = "job_ord") -> DataFrame:
    """The gravest rows; `left_out` says how many there are besides."""
    return by_severity(verdicts, order).limit(most)


def left_out(verdicts: DataFrame, most: int = 30) -> DataFrame:
    """(more): "+N more" for what a limit of `most` leaves out, or ""."""
    rest = F.count("*") - most
    return verdicts.agg(F.when(rest > 0, F.concat(F.lit("+"), rest.cast("string"), F.lit(" more"))).otherwise("").alias("more"))


def run_facets(verdicts: DataFrame) -> DataFrame:
    """One row: failure_types and users that occur, sorted and joined by commas, and whether more than one user or run does."""
    of = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    kind = F.coalesce(F.nullif(F.col("failure_type"), F.lit("")), F.lit("unknown"))
    rows = verdicts.agg(F.array_sort(F.collect_set(kind)).alias("t"), of("user").alias("u"), F.countDistinct("run").alias("r"))
    return rows.select(F.array_join("t", ",").alias("failure_types"), F.array_join("u", ",").alias("users"), ((F.col("r") > 1) | (F.size("u") > 1)).alias("multi_run"))


def status_pill(verdicts: DataFrame) -> DataFrame:
    """verdicts with status (fallback before success) and band (confidence of 75 percent or more, of 50, less)."""
    category, percent = F.lower(F.coalesce("error_category", F.lit(""))), (F.col("confidence") * 100).cast("int")
    fallback = category.contains("artifact availability") | category.contains("log fetch failure")
    status = F.when(fallback, "fallback analysis").when(F.col("success"), "analysis available").otherwise("log unavailable")
    return verdicts.withColumns({"status": status, "band": F.when(percent >= 75, "high").when(percent >= 50, "medium").otherwise("low")})


def needs_attention(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(~F.col("success") | F.col("fallback") | (F.col("confidence") < 0.6) | (F.col("failure_type") == "unknown"))


def cards() -> dict[str, Column]:
    """Counts over all verdicts; low confidence and unknown types count successes only."""
    ok, fallback = F.col("success"), F.col("fallback")
    of = {
        "jobs": F.lit(True), "ok": ok, "fallback": fallback, "low_confidence": ok & (F.col("confidence") < 0.6), "unknown_type": ok & (F.col("failure_type") == "unknown"),
        "unavailable": F.lower("error_category").contains("artifact availability"), **{s: F.col("severity") == s for s in ("critical", "high", "medium", "low")},
    }
    return {k: F.count_if(c) for k, c in of.items()}


def snapshot(verdicts: DataFrame) -> DataFrame:
    """One row of `cards`. On verdicts that are written anyway, observe `cards` there and save this pass."""
    return verdicts.agg(*(c.alias(k) for k, c in cards().items()))


def systemic_warning(clusters: DataFrame) -> DataFrame:
    """(run_id, warning): a run whose many failures are one cluster, or few."""
    rows = clusters.groupBy("run_id").agg(F.count("*").alias("clusters"), F.sum("size").alias("jobs"), F.max("size").alias("most"))
    one = (F.col("clusters") == 1) & (F.col("most") > 5)
    few = (F.col("clusters") <= 3) & (F.col("jobs") > 20)
    return rows.select("run_id", F.when(one, "single cause").when(few, "few causes").alias("warning")).where("warning is not null")


def filtered(verdicts: DataFrame, text: str = "", severity: str = "", failure_type: str = "", users: str = "") -> DataFrame:
    """Verdicts that contain a text, have a severity and type, and whose user contains one of several names."""
    if text:
        verdicts = verdicts.where(F.lower(F.concat_ws(" ", "job_id", "root_cause", "error_category")).contains(text.lower()))
    if severity:
        verdicts = verdicts.where(F.col("severity") == severity)
    if failure_type:
        verdicts = verdicts.where(F.col("failure_type") == failure_type)
    names = [u.lower() for u in users.replace(",", " ").replace(";", " ").split()]
    if names:
        verdicts = verdicts.where(F.exists(F.array(*map(F.lit, names)), lambda u: F.lower("user").contains(u)))
    return verdicts


def multi_run(runs: dict[str, DataFrame], users: dict[str, str]) -> DataFrame:
    """All runs' verdicts in one table, each with its run and user."""
    out = None
    for n, (run, rows) in enumerate(runs.items()):
        rows = rows.withColumns({"run": F.lit(run), "user": F.lit(users.get(run, "")), "run_ord": F.lit(n)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    last = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def cache_key(text: Column, model: str, version: str) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", F.lit(model), F.lit(version), text), 256), 1, 32)


def from_cache(rows: DataFrame, cache: DataFrame, now: float, ttl: float = 7 * 86400.0) -> DataFrame:
    """rows (text_hash, ...) with the cached columns of entries younger than ttl; `cached` tells which had one."""
    fresh = last_by_key(cache.where(F.col("cached_at") > now - ttl), ["text_hash"], "cached_at")
    return rows.join(fresh.withColumn("cached", F.lit(True)), "text_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def updated_cache(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache with successful results put in; the last result of a key replaces its entry. sources.store keeps such a table."""
    new = last_by_key(results.where("success"), ["text_hash"], "cached_at").select(*cache.columns)
    return cache.join(new.select("text_hash"), "text_hash", "left_anti").unionByName(new)


def export_rows(verdicts: DataFrame) -> DataFrame:
    """(json): an object for each verdict, its confidence with two decimals, gravest first."""
    columns = [c for c in ("job_id", "severity", "failure_type", "confidence", "error_category", "root_cause", "explanation", "recommended_action", "fix_suggestions", "user", "run") if c in verdicts.columns]
    cells = [F.round("confidence", 2).alias("confidence") if c == "confidence" else F.col(c) for c in columns]
    return by_severity(verdicts).select(F.to_json(F.struct(*cells)).alias("json"))


def write_csv(verdicts: DataFrame, path: str) -> None:
    flat = verdicts.select(*(F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in verdicts.dtypes))
    flat.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def log_name(job_id: Column) -> Column:
    """The name that the log of a job is stored under."""
    plain = job_id.cast("string")
    odd = plain.rlike(f"[^A-Za-z0-9{re.escape(KEPT)}]")
    encoded = F.replace(F.url_encode(plain), F.lit("+"), F.lit(" "))
    for c in KEPT:
        if (code := f"%{ord(c):02X}") != "%20":
            encoded = F.replace(encoded, F.lit(code), F.lit(c))
    encoded = F.replace(encoded, F.lit("*"), F.lit("%2A"))
    return F.concat(F.when(odd, encoded).otherwise(plain), F.lit(".log"))


def index_rows(logs: DataFrame) -> DataFrame:
    """The index of fetched logs: bytes are those of the UTF-8 text; a log without text is a failed fetch of none."""
    ok = (F.col("status") == "ok") & F.col("log_text").isNotNull()
    return logs.select(
        "job_id", F.when(ok, "ok").otherwise("fetch_failed").alias("status"), F.when(ok, log_name(F.col("job_id"))).otherwise("").alias("log_path"),
        F.col("source_url").alias("fetched_from"), "log_name", F.when(ok, F.octet_length("log_text")).otherwise(0).cast("long").alias("bytes"),
        F.format_string("%.3f", "elapsed_s").alias("elapsed_s"), "error_message",
    )


def write_logs(logs: DataFrame, path: str) -> None:
    """The texts of fetched logs as path/logs/X.log for each job X, byte for byte, and their index under path/index.csv.

    sources.logs.log_folder reads path/logs back; log_path of the index is relative to path.
    """
    write_log_files(logs.where("status = 'ok' and log_text is not null"), f"{path}/logs")
    index = index_rows(logs).withColumn("log_path", F.when(F.col("log_path") != "", F.concat(F.lit("logs/"), F.col("log_path"))).otherwise(""))
    index.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/index.csv")
