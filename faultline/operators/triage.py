"""From fetched logs to a verdict for every job, in one call: parse, cluster, judge one job of each cluster, fan out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from faultline.operators import clusters, condense, report
from faultline.operators.tables import Tables
from faultline.operators.verdicts import from_replies, verdicts
from faultline.sources.store import VerdictCache

VERDICT = ("root_cause", "severity", "failure_type", "error_category", "confidence", "explanation", "recommended_action", "fix_suggestions")


class Triage(NamedTuple):
    parsed: DataFrame
    members: DataFrame
    clusters: DataFrame
    verdicts: DataFrame
    health: DataFrame
    counts: dict[str, int]


def judged(reps: DataFrame, replies: DataFrame | None, cache: VerdictCache | None, model: str, version: str, now: float) -> DataFrame:
    """reps (run_id, job_id, text, ...) with VERDICT, success and cached.

    A text with a live entry in the cache takes its verdict from there. For the others the reply of replies (run_id,
    job_id, raw_reply) is read and corrected; without one, or with one that can't be read, the rules judge alone. What
    was not cached is put there.
    """
    rows = reps.withColumn("text_hash", report.cache_key(F.col("text"), model, version))
    reply = F.lit(None).cast("string")
    if replies is not None:
        rows, reply = rows.join(replies.select("run_id", "job_id", F.col("raw_reply").alias("_raw")), ["run_id", "job_id"], "left"), F.col("_raw")
    rows = rows.withColumn("raw_reply", reply).drop("_raw")
    if cache is None:
        known, open_ = None, rows
    else:
        rows = Tables(rows.sparkSession, "triage").put(cache.get(rows.withColumnRenamed("job_id", "of"), now).drop("job_id").withColumnRenamed("of", "job_id"), "cached")
        known, open_ = rows.where("cached"), rows.where("not cached").drop("cached", *VERDICT)
    fresh = verdicts(open_.drop("raw_reply")) if replies is None else from_replies(open_).drop("raw_reply", "json_valid")
    fresh = fresh.withColumns({"success": F.lit(True), "cached": F.lit(False)})
    if cache is None:
        return fresh
    fresh = Tables(rows.sparkSession, "triage").put(fresh, "judged")
    cache.put(fresh, now)
    return fresh.unionByName(known.drop("raw_reply").withColumn("success", F.lit(True)))


def triage(logs: DataFrame, totals: DataFrame | None = None, replies: DataFrame | None = None, cache: VerdictCache | None = None, model: str = "rules", version: str = "v1", now: float = 0.0) -> Triage:
    """Everything about the runs of logs (run_id, job_id, job_ord, status, log_text).

    parsed, members (run_id, job_id, cluster_id, cluster_no), clusters (as `merged_clusters`), verdicts (run_id, job_id,
    job_ord, cluster_id, VERDICT, success, cached, fallback; one for each log) and health of each run. totals (run_id,
    total_jobs) are the jobs of a run's page; without them a run has as many as it has logs. Equal job ids of two runs
    are two jobs. Every table is written, so later steps read and don't compute. counts are taken while the tables are
    written, without a pass of their own: the size of what was parsed, jobs, clusters, the verdicts that clustering and the
    cache saved, and `report.snapshot` of all verdicts.
    """
    tables, counts = Tables(logs.sparkSession, "triage"), {}

    def observed(rows: DataFrame, name: str, **metrics) -> DataFrame:
        seen = Observation(name)
        out = tables.put(rows.observe(seen, *(c.alias(k) for k, c in metrics.items())), name)
        counts.update({k: v or 0 for k, v in seen.get.items()})
        return out

    every = F.count(F.lit(1))
    k = ["run_id", "job_id"]
    logs = logs.withColumns({c: F.col(c).cast("string") for c in k})
    parsed = condense.parsed(report.usable(logs).select(*k, "job_ord", F.col("log_text").alias("raw_log")))
    sizes = {"tracebacks": F.size("tracebacks"), "error_blocks": F.size("error_blocks"), "total_lines": F.col("total_lines"), "total_chars": F.col("total_chars"), "condensed_chars": F.length("condensed_text")}
    parsed = observed(parsed, "parsed", **{c: F.sum(x) for c, x in sizes.items()})
    signed = parsed.select(*k, "job_ord", F.col("condensed_text").alias("text"), clusters.signature(F.col("condensed_text"), F.col("tracebacks"), F.col("error_blocks")).alias("signature"))
    assigned = observed(clusters.assigned(signed), "assigned", jobs_to_judge=every)
    heads = tables.put(clusters.exact_clusters(assigned), "heads")
    mapped = tables.put(clusters.merge_map(heads), "mapped")
    merged = observed(clusters.merged_clusters(heads, mapped=mapped), "merged", clusters=every)
    members = assigned.join(mapped, ["run_id", "cluster_id"]).select(*k, "job_ord", F.col("head").alias("cluster_id"), "cluster_no")
    reps = merged.select("run_id", "cluster_id", F.col("representative_job_id").alias("job_id")).join(assigned.select(*k, "job_ord", "text"), k)
    found = observed(judged(reps, replies, cache, model, version, now).select("run_id", "cluster_id", *VERDICT, "success", "cached"), "found", from_cache=F.count_if("cached"))
    counts["saved"] = counts["jobs_to_judge"] - counts["clusters"]
    fanned = members.drop("cluster_no").join(found, ["run_id", "cluster_id"]).withColumn("fallback", F.lit(False))
    lost = report.fallbacks(logs).join(logs.where(f"not {report.USABLE}").select(*k, "job_ord"), k).distinct().withColumns({"success": F.lit(True), "cached": F.lit(False), "fallback": F.lit(True)})
    pages = logs.groupBy("run_id").agg(F.count("*").alias("failed_jobs"))
    if totals is not None:
        pages = pages.join(totals.select("run_id", "total_jobs"), "run_id", "left")
    total = F.greatest(F.coalesce("total_jobs", F.lit(0)), F.col("failed_jobs")) if totals is not None else F.col("failed_jobs")
    health = report.run_health(pages.select("run_id", total.cast("long").alias("total_jobs"), "failed_jobs"))
    every_verdict = observed(fanned.unionByName(lost, allowMissingColumns=True), "verdicts", **report.cards())
    return Triage(parsed, members, merged, every_verdict, health, counts)
