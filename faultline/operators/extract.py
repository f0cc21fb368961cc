"""Extractors over `lines` (job_id, line_no, line): every result is computed for all jobs at once.

Where lines also have a run_id, a job is known by run and job id together. Lines without a job or run id belong to no
job and are left out.

An extractor first finds places: rules are evaluated line by line, without an exchange, and leave few rows. Places
become spans by scans of two levels: a job is cut into stretches of STRETCH lines, each is scanned apart, and a row for
each stretch is scanned along the job, so a job of any size is many tasks. Last, the lines of the spans are fetched by
job and line number, a key without skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faultline.functions import rules
from faultline.functions.text import fingerprint, has, java, strip
from faultline.operators.tables import Tables

STRETCH = 20_000


def keys(rows: DataFrame) -> list[str]:
    """The columns that a job is known by."""
    return [c for c in ("run_id", "job_id") if c in rows.columns]


def known(lines: DataFrame) -> DataFrame:
    """Lines of known jobs, ids as strings."""
    k = keys(lines)
    rows = lines.select(*(F.col(c).cast("string").alias(c) for c in k), F.col("line_no").cast("long").alias("line_no"), "line")
    return rows.dropna(subset=k)


def stretch(at: Column) -> Column:
    return F.floor(at / STRETCH).cast("long")


def along(rows: DataFrame) -> WindowSpec:
    """The stretches of a job in order."""
    return Window.partitionBy(*keys(rows)).orderBy("part")


def inside(rows: DataFrame) -> WindowSpec:
    """The lines of a stretch in order."""
    return Window.partitionBy(*keys(rows), "part").orderBy("line_no")


def signal_type(line: Column) -> Column:
    """The first signal that a line has, else null; noise has none."""
    chain = F.when(F.lit(False), "")
    for s in rules.SIGNALS:
        test = F.upper(line).contains(s.needs) if s.needs else None
        test = has(line, s.pattern) if test is None else test & has(line, s.pattern)
        for word in s.without:
            test = test & ~line.contains(word)
        chain = chain.when(test, s.name)
    # few lines have a signal, so noise is looked for in those alone
    return F.when(chain.isNotNull() & ~has(line, rules.NOISE), chain)


def signals(lines: DataFrame) -> DataFrame:
    return lines.withColumn("signal_type", signal_type(F.col("line"))).where("signal_type is not null")


def first_signals(lines: DataFrame, each: int = 5, most: int = 15) -> DataFrame:
    """(job_id, signal_type, type_no, item_no, line): distinct stripped lines of each type, types in order of appearance."""
    return listed_signals(signals(lines), each, most)


def listed_signals(found: DataFrame, each: int = 5, most: int = 15) -> DataFrame:
    k = keys(found)
    rows = found.withColumn("line", strip(F.col("line"))).groupBy(*k, "signal_type", "line").agg(F.min("line_no").alias("at"))
    rows = rows.withColumn("item_no", F.row_number().over(Window.partitionBy(*k, "signal_type").orderBy("at"))).where(F.col("item_no") <= each)
    # from here on a job has a few rows a type
    rows = rows.withColumn("started", F.min("at").over(Window.partitionBy(*k, "signal_type")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*k).orderBy("started", "item_no"))).where(F.col("n") <= most)
    rows = rows.withColumn("type_no", F.dense_rank().over(Window.partitionBy(*k).orderBy("started")))
    return rows.select(*k, "signal_type", "type_no", "item_no", "line")


def is_error(line: Column) -> Column:
    return has(line, rules.ERROR_WORD) & ~has(line, rules.NOISE)


def is_strong(line: Column) -> Column:
    """A failed command, an exception seen by the framework, or a task's warning of a failure."""
    strong = has(line, rules.COMMAND_FAILED) | (line.contains("ERROR:teuthology") & line.contains("Saw exception"))
    return strong | (has(line, rules.TASK_WARNING) & (F.lower(line).contains("failed") | F.lower(line).contains("error")))


def error_hits(lines: DataFrame) -> DataFrame:
    return lines.where(is_error(F.col("line")))


def islands(hits: DataFrame, reach: int) -> DataFrame:
    """(job_id, island, lo, hi) of hits (job_id, line_no): hits up to `reach` lines apart are one island, numbered from 1.

    Islands of each stretch are found apart. A job's stretches, a row each, then tell which of them go on into the next
    and how many islands began before.
    """
    k = keys(hits)
    rows = hits.select(*k, "line_no").withColumn("part", stretch(F.col("line_no")))
    rows = rows.withColumn("new", (F.col("line_no") - F.lag("line_no").over(inside(rows)) > reach).cast("int"))
    rows = rows.withColumn("own", F.coalesce(F.sum("new").over(inside(rows)), F.lit(0)))
    runs = rows.groupBy(*k, "part", "own").agg(F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    ends = runs.groupBy(*k, "part").agg(F.count("*").alias("n"), F.min("lo").alias("first"), F.max("hi").alias("last"))
    ends = ends.withColumn("more", F.coalesce(F.col("first") - F.lag("last").over(along(ends)) <= reach, F.lit(False)).cast("int"))
    before = F.sum(F.col("n") - F.col("more")).over(along(ends).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*k, "part", "more", F.coalesce(before, F.lit(0)).alias("before"))
    runs = runs.join(ends, [*k, "part"]).withColumn("island", F.col("before") + F.col("own") + 1 - F.col("more"))
    return runs.groupBy(*k, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def line_numbers(spans: DataFrame) -> DataFrame:
    """A row for each line_no of spans (..., lo, hi), both ends included; arrays have a stretch's length at most."""
    parts = spans.where("lo <= hi").withColumn("part", F.explode(F.sequence(stretch(F.col("lo")), stretch(F.col("hi")))))
    first, last = F.greatest("lo", F.col("part") * STRETCH), F.least("hi", (F.col("part") + 1) * STRETCH - 1)
    return parts.withColumn("line_no", F.explode(F.sequence(first, last))).drop("part", "lo", "hi")


def shown(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """The lines of spans (job_id, ..., lo, hi), with what the spans tell."""
    return lines.join(line_numbers(spans), [*keys(lines), "line_no"])


def joined_text(keep: Column | None = None) -> Column:
    item = F.struct("line_no", "line") if keep is None else F.when(keep, F.struct("line_no", "line"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["line"]), "\n").alias("text")


def block_spans(hits: DataFrame, context: int = 5) -> DataFrame:
    """(job_id, no, lo, hi): error lines with their surroundings, touching spans as one."""
    found = islands(hits, 2 * context + 1)
    return found.select(*keys(hits), F.col("island").alias("no"), F.greatest(F.col("lo") - context, F.lit(0)).alias("lo"), (F.col("hi") + context).alias("hi"))


def window_spans(strong: DataFrame, most: int = 5) -> DataFrame:
    """(job_id, no, lo, hi): the first windows of 30 lines before to 10 after strong failures, those up to 5 lines apart as one."""
    found = islands(strong, 45).where(F.col("island") <= most)
    return found.select(*keys(strong), F.col("island").alias("no"), F.greatest(F.col("lo") - 30, F.lit(0)).alias("lo"), (F.col("hi") + 10).alias("hi"))


def block_texts(rows: DataFrame) -> DataFrame:
    k = keys(rows)
    return rows.groupBy(*k, "no").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), joined_text()).drop("no")


def window_texts(rows: DataFrame) -> DataFrame:
    k, quiet = keys(rows), ~has(F.col("line"), rules.NOISE)
    rows = rows.withColumn("quiet", quiet).groupBy(*k, F.col("no").alias("window_no"))
    rows = rows.agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), joined_text(F.col("quiet")), F.count_if("quiet").alias("kept"))
    return rows.where("kept > 0").drop("kept")


def error_blocks(lines: DataFrame, context: int = 5) -> DataFrame:
    """(job_id, start_line, end_line, text): error lines with their surroundings, touching spans merged."""
    lines = known(lines)
    return block_texts(shown(lines, block_spans(error_hits(lines), context)))


def deduplicated(blocks: DataFrame) -> DataFrame:
    """(job_id, start_line, end_line, repeats, fp, text): the first block of each fingerprint, marked with its count."""
    rows = blocks.withColumn("fp", fingerprint(F.col("text"))).groupBy(*keys(blocks), "fp")
    rows = rows.agg(F.count("*").alias("repeats"), F.min(F.struct("start_line", "end_line", "text")).alias("x"))
    text = F.when(F.col("repeats") > 1, F.concat(F.lit("[Repeated "), F.col("repeats").cast("string"), F.lit("x] "), F.col("x.text"))).otherwise(F.col("x.text"))
    return rows.select(*keys(blocks), "x.start_line", "x.end_line", "repeats", "fp", text.alias("text"))


def context_windows(lines: DataFrame, most: int = 5) -> DataFrame:
    """(job_id, window_no, start_line, end_line, text): 30 lines before to 10 after strong failures, without noise."""
    lines = known(lines)
    return window_texts(shown(lines, window_spans(lines.where(is_strong(F.col("line"))), most)))


def failing(line: Column) -> dict[str, Column]:
    """failed, host and status of a failed command's line; status alone of a remote exit code; else null."""
    failed = has(line, rules.COMMAND_FAILED)
    group = lambda pattern, n: F.regexp_extract(line, java(pattern), n)
    code = F.when(failed, group(rules.COMMAND_FAILED, 2)).when(line.contains("got remote process result: "), group(rules.EXIT_CODE, 1))
    return {"failed": failed, "host": F.when(failed, group(rules.COMMAND_FAILED, 1)), "status": code.try_cast("long")}


def failures(lines: DataFrame) -> DataFrame:
    """(job_id, fail_line, failed, host, status): failed commands, and exit codes over 0, whose host is yet unknown."""
    rows = lines.withColumns(failing(F.col("line"))).where("failed or status > 0")
    return rows.select(*keys(lines), F.col("line_no").alias("fail_line"), "failed", "host", "status")


def failure_spans(fails: DataFrame, back: int = 50) -> DataFrame:
    return fails.withColumns({"lo": F.greatest(F.col("fail_line") - back, F.lit(0)), "hi": F.col("fail_line") - 1})


def command_stderr(lines: DataFrame, back: int = 50) -> DataFrame:
    """(job_id, fail_line, host, status, command, n_stderr, stderr): what a failed command wrote on its host.

    An exit code's host is the first that the three lines before it name. The look-back ends at the host's own command
    line, which is the command, or at another host's command line once something was collected. Both ends are the
    largest line number of their kind, so no line is walked.
    """
    lines = known(lines)
    return stderr_texts(shown(remote(lines), failure_spans(failures(lines), back)))


def remote(lines: DataFrame) -> DataFrame:
    """The lines that stderr_texts() reads: all that it looks for stands behind "run."."""
    return lines.where(F.col("line").contains("run."))


def stderr_texts(near: DataFrame) -> DataFrame:
    """command_stderr() of the lines before failures, each with its failure's columns."""
    line, k = F.col("line"), keys(near)
    key = Window.partitionBy(*k, "fail_line")
    named = F.when(~F.col("failed") & (F.col("line_no") >= F.col("fail_line") - 3), F.nullif(F.regexp_extract("line", java(rules.REMOTE_HOST), 1), F.lit("")))
    near = near.withColumn("named", F.when(named.isNotNull(), F.struct(F.col("line_no").alias("at"), named.alias("host"))))
    near = near.withColumn("host", F.coalesce("host", F.min("named").over(key)["host"])).where("host is not null")
    own = (F.regexp_extract(line, java(rules.REMOTE_STDERR), 1) == F.col("host")) & (F.col("host") != "")
    content = strip(F.regexp_extract(line, java(rules.REMOTE_STDERR), 2))
    taken = own & (content != "") & ~has(line, rules.NOISE)
    command = ~own & line.contains(F.concat(F.lit("run."), F.col("host"), F.lit(":>")))
    other = ~own & ~command & has(line, rules.REMOTE_COMMAND) & ~line.contains(F.col("host"))
    near = near.withColumns({"content": F.when(taken, content), "is_command": command, "is_other": other})
    near = near.withColumn("stop", F.max(F.when(F.col("is_command"), F.col("line_no"))).over(key))
    near = near.withColumn("nearest", F.max(F.when(F.col("content").isNotNull() & (F.col("line_no") > F.coalesce("stop", F.lit(-1))), F.col("line_no"))).over(key))
    near = near.withColumn("cut", F.max(F.when(F.col("is_other") & (F.col("line_no") < F.col("nearest")), F.col("line_no"))).over(key))
    reached = F.col("line_no") > F.greatest(F.coalesce("stop", F.lit(-1)), F.coalesce("cut", F.lit(-1)))
    # the command is read only if the walk came that far
    text = F.when(F.col("is_command") & (F.col("line_no") == F.col("stop")) & (F.col("stop") > F.coalesce("cut", F.lit(-1))), strip(F.regexp_extract(line, java(rules.COMMAND_TEXT), 1)))
    rows = near.groupBy(*k, "fail_line", "host", "status").agg(
        F.max(text).alias("command"),
        F.array_sort(F.collect_list(F.when(reached & F.col("content").isNotNull(), F.struct("line_no", "content")))).alias("found"),
    )
    rows = rows.where(F.size("found") > 0)
    return rows.select(
        *k, "fail_line", "host", "status", F.coalesce("command", F.lit("")).alias("command"), F.size("found").cast("long").alias("n_stderr"),
        F.array_join(F.transform("found", lambda x: x["content"]), "\n").alias("stderr"),
    )


def job_ends(lines: DataFrame) -> DataFrame:
    """(job_id, n, told): each job's number of lines and its last failure_reason line, counted before the exchange."""
    told = F.col("line").contains("failure_reason:") & strip(F.col("line")).startswith("failure_reason:")
    return lines.groupBy(*keys(lines)).agg((F.max("line_no") + 1).alias("n"), F.max(F.when(told, F.col("line_no"))).alias("told"))


def largest(rows: Column, test, field: str = "at") -> Column:
    return F.array_max(F.transform(F.filter(rows, test), lambda x: x[field]))


def failure_reason(lines: DataFrame, most: int = 499, ends: DataFrame | None = None) -> DataFrame:
    """(job_id, reason): the last failure_reason line of the final 499, with the indented lines that follow it.

    A job that has one gives the lines from there on to one row, 499 at most, and that row is searched. ends is
    job_ends() where it is at hand.
    """
    lines = known(lines)
    ends = job_ends(lines) if ends is None else ends
    line, k = F.col("line"), keys(lines)
    rows = lines.join(ends.where(F.col("told") >= F.col("n") - most).select(*k, F.col("told").alias("from")), k).where(F.col("line_no") >= F.col("from"))
    item = F.struct(F.col("line_no").alias("at"), strip(line).alias("text"), (line.startswith("  ") | line.startswith("\t")).alias("indented"))
    rows = rows.groupBy(*k, "from").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    rows = rows.withColumn("stop", F.array_min(F.transform(F.filter("xs", lambda x: (x["at"] > F.col("from")) & ~x["indented"]), lambda x: x["at"])))
    kept = F.filter("xs", lambda x: F.col("stop").isNull() | (x["at"] < F.col("stop")))
    return rows.select(*keys(rows), F.array_join(F.transform(kept, lambda x: x["text"]), " ").alias("reason"))


def tail_summary(lines: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(job_id, kind, start_line, end_line, text): the summary at a log's end.

    `data`: the run of key lines around the last one of the final 499 lines, down to the first other line within
    300; else `header`: from the last heading in the final 1,999 lines, 300 lines; else `tail`: the last 150 lines.

    A job gives its last 1,999 lines at most to one row, and that row is searched. Where a run of key lines begins
    before them, the lines above are fetched besides. ends (job_id, n), where given, are the jobs that are read.
    """
    lines = known(lines)
    k, line, text = keys(lines), F.col("line"), strip(F.col("line"))
    ends = (job_ends(lines) if ends is None else ends).select(*k, "n")
    rows = lines.join(ends, k).where(F.col("line_no") >= F.col("n") - 1999).withColumns({"bare": text}).withColumn("data", has(F.col("bare"), rules.SUMMARY_DATA))
    breaks = (F.col("bare") != "") & ~F.col("bare").startswith("-") & ~F.col("data")
    item = F.struct(F.col("line_no").alias("at"), "line", "data", has(line, rules.SUMMARY_HEADER).alias("head"), breaks.alias("breaks"))
    rows = rows.groupBy(*k, "n").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    rows = rows.withColumns({"last": largest(F.col("xs"), lambda x: x["data"] & (x["at"] > F.col("n") - 500)), "head": largest(F.col("xs"), lambda x: x["head"])})
    above = largest(F.col("xs"), lambda x: ~x["data"] & (x["at"] < F.col("last")))
    below = F.array_min(F.transform(F.filter("xs", lambda x: x["breaks"] & (x["at"] > F.col("last"))), lambda x: x["at"]))
    rows = rows.withColumns({"above": above, "below": below, "since": F.get("xs", F.lit(0))["at"]})
    kind = F.when(F.col("last").isNotNull(), "data").when(F.col("head").isNotNull(), "header").otherwise("tail")
    start = F.when(F.col("last").isNotNull(), F.coalesce(F.col("above") + 1, "since")).when(F.col("head").isNotNull(), F.col("head")).otherwise(F.greatest(F.col("n") - 150, F.lit(0)))
    capped = F.least(F.coalesce("last", "head") + 300, "n")
    stop = F.when(F.col("last").isNotNull(), F.least(F.coalesce("below", "n"), capped)).when(F.col("head").isNotNull(), capped).otherwise(F.col("n"))
    rows = rows.withColumns({"kind": kind, "start_line": start, "stop": stop})
    kept = F.filter("xs", lambda x: (x["at"] >= F.col("start_line")) & (x["at"] < F.col("stop")))
    open_ = F.coalesce(F.col("last").isNotNull() & F.col("above").isNull() & (F.col("since") > 0), F.lit(False))
    rows = rows.select(*k, "kind", "start_line", (F.col("stop") - 1).alias("end_line"), F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("text"), open_.alias("open"))
    rows = Tables(lines.sparkSession, "summary").put(rows, "tails")
    open_rows = rows.where("open")
    if open_rows.isEmpty():
        return rows.drop("open")
    over = lines.join(open_rows.select(*k, "start_line"), k).where("line_no < start_line").withColumn("data", has(text, rules.SUMMARY_DATA))
    begun = over.groupBy(*k).agg((F.coalesce(F.max(F.when(~F.col("data"), F.col("line_no"))), F.lit(-1)) + 1).alias("begun"))
    over = over.join(begun, k).where("line_no >= begun").groupBy(*k, "begun").agg(joined_text())
    more = rows.join(over.withColumnRenamed("text", "upper"), k, "left")
    return more.select(*k, "kind", F.coalesce("begun", "start_line").alias("start_line"), "end_line", F.concat_ws("\n", "upper", "text").alias("text"))


def trace_marks(lines: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """(job_id, part, line_no, start, kind, follow): lines that start a trace or may end one, from a job's first start on.

    Whether a line ends a trace depends on itself and on the next line that isn't blank: `end` after an exception's
    line, `jump` where a chained trace follows at `follow`, `stop` before a flush-left line. Of marks in a row that
    start nothing only the first can matter, and only that one is kept. since (job_id, since) are the jobs' first
    starts where they are at hand.
    """
    k = keys(lines)
    if since is None:
        since = lines.where(has(F.col("line"), rules.TRACEBACK_START)).groupBy(*k).agg(F.min("line_no").alias("since"))
    rows = lines.join(since, k).where("line_no >= since").withColumn("bare", strip(F.col("line"))).where("bare <> ''")
    start, chain = has(F.col("line"), rules.TRACEBACK_START), has(F.col("bare"), rules.TRACEBACK_CHAIN)
    rows = rows.select(
        *k, stretch(F.col("line_no")).alias("part"), "line_no", start.alias("start"), has(F.col("bare"), rules.TRACEBACK_END).alias("final"),
        F.struct("line_no", (start | chain).alias("linked"), F.substring("line", 1, 1).isin(" ", "\t").alias("indented")).alias("own"), F.col("bare").rlike(r"^(File |\.\.\.)").alias("inner"),
    )
    # the first line of each later stretch, beside the stretch before it; jobs of one stretch have none
    heads = rows.where(F.col("line_no") >= STRETCH).groupBy(*k, "part").agg(F.min("own").alias("later"))
    heads = heads.withColumn("part", F.coalesce(F.lag("part").over(along(heads)), F.lit(0).cast("long")))
    rows = rows.withColumn("next", F.lead("own").over(inside(rows))).join(heads, [*k, "part"], "left").withColumn("next", F.coalesce("next", "later"))
    linked = F.coalesce(F.col("next.linked"), F.lit(False))
    kind = F.when(F.col("inner"), None).when(F.col("final"), F.when(linked, "jump").otherwise("end"))
    kind = kind.when((F.col("next.line_no") == F.col("line_no") + 1) & ~F.col("next.indented") & ~linked, "stop")
    marks = rows.withColumn("kind", kind).where("start or kind is not null")
    marks = marks.withColumn("idle", ~F.col("start") & F.coalesce(~F.lag("start").over(inside(marks)), F.lit(False))).where("not idle")
    return marks.select(*k, "part", "line_no", "start", "kind", F.col("next.line_no").alias("follow"))


OUTSIDE, WITHIN, WAITING = range(3)


class TraceWalk:
    """Reads marks in turn and says which spans (trace, first line, from, to) are over. Three states and a few numbers.

    What follows a chained exception belongs to its trace, unread up to the next start. A walk may begin amid a job, in
    any state: first and lo are then None until the marks set them.
    """

    def __init__(self, extra: int, state: int = OUTSIDE, traces: int = 0, first: int | None = None, lo: int | None = None):
        self.extra, self.state, self.traces, self.first, self.lo = extra, state, traces, first, lo

    def read(self, at: int, start: bool, kind: str | None, follow: int | None) -> tuple[int, int | None, int | None, int] | None:
        if self.state == OUTSIDE:
            if start:
                self.state, self.first, self.lo = WITHIN, at, at
                self.traces += 1
            return None
        if self.state == WAITING:
            if not start:
                return None
            self.state = WITHIN
        if kind is None:
            return None
        over = (self.traces - 1, self.first, self.lo, at + (self.extra if kind == "stop" else 0))
        if kind == "jump":
            self.state, self.lo = WAITING, follow
        else:
            self.state = OUTSIDE
        return over


def grouped(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, tuple, bool]]:
    """(first n columns, the others, whether another group begins) of each row of sorted batches."""
    last = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield row[:n], row[n:], row[:n] != last
            last = row[:n]


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 5_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held) if held else [[]] * len(schema), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield out()
            held = []
    yield out()


def trace_spans(marks: DataFrame, ends: DataFrame, tail: str = "parity") -> DataFrame:
    """(job_id, no, start_line, lo, hi) of a trace's parts; marks are those of trace_marks(), ends (job_id, n) the jobs' sizes.

    The walk over a stretch is a map from the state before it to the state after it. Each stretch is walked from all
    three states, a job's maps, one row for each stretch, are composed in order, and each stretch is walked once more
    from the state that it is entered in.
    """
    k, extra = keys(marks), int(tail == "complete")
    n = len(k) + 1
    names, strings, longs = [*k, "part"], ", ".join(f"{c} string" for c in k), pa.list_(pa.int64())
    fields = [*((c, pa.string()) for c in k), ("part", pa.int64())]
    maps = pa.schema([*fields, *((c, longs) for c in ("states", "traces", "firsts", "los"))])
    entries = pa.schema([*fields, *((c, pa.int64()) for c in ("state", "traces", "first", "lo"))])
    spans = pa.schema([*fields[:-1], *((c, pa.int64()) for c in ("no", "start_line", "lo", "hi"))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            group, walks = None, []
            result = lambda: (*group, *([getattr(w, x) for w in walks] for x in ("state", "traces", "first", "lo")))
            for key, mark, new in grouped(batches, n):
                if new:
                    if walks:
                        yield result()
                    group, walks = key, [TraceWalk(extra, state) for state in (OUTSIDE, WITHIN, WAITING)]
                for w in walks:
                    w.read(*mark)
            if walks:
                yield result()

        return batched(rows(), maps)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            job, state, traces, first, lo = None, OUTSIDE, 0, None, None
            for key, (part, states, counts, firsts, los), new in grouped(batches, n - 1):
                if new:
                    if state != OUTSIDE:
                        yield (*job, None, state, traces, first, lo)
                    job, state, traces, first, lo = key, OUTSIDE, 0, None, None
                yield (*key, part, state, traces, first, lo)
                first = first if firsts[state] is None else firsts[state]
                lo = lo if los[state] is None else los[state]
                state, traces = states[state], traces + counts[state]
            if state != OUTSIDE:
                yield (*job, None, state, traces, first, lo)

        return batched(rows(), entries)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            walk = None
            for key, (at, start, kind, follow, state, traces, first, lo), new in grouped(batches, n):
                if new:
                    walk = TraceWalk(extra, state, traces, first, lo)
                if over := walk.read(at, start, kind, follow):
                    yield (*key[:-1], *over)

        return batched(rows(), spans)

    dealt = marks.select(*names, "line_no", "start", "kind", "follow").repartition(*names).sortWithinPartitions(*names, "line_no")
    each = dealt.mapInArrow(mapped, f"{strings}, part long, states array<long>, traces array<long>, firsts array<long>, los array<long>")
    entered = each.repartition(*k).sortWithinPartitions(*names).mapInArrow(composed, f"{strings}, part long, state long, traces long, first long, lo long")
    entered = Tables(marks.sparkSession, "traces").put(entered, "entries")
    again = marks.join(entered.where("part is not null"), names).select(*names, "line_no", "start", "kind", "follow", "state", "traces", "first", "lo")
    over = again.repartition(*names).sortWithinPartitions(*names, "line_no").mapInArrow(walked, f"{strings}, no long, start_line long, lo long, hi long")
    # a trace that nothing ends goes on to the end of its job
    rest = entered.where("part is null").join(ends, k).select(*k, (F.col("traces") - 1).alias("no"), F.col("first").alias("start_line"), "lo", (F.col("n") - 1).alias("hi"))
    return over.unionByName(rest)


def trace_texts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*keys(rows), F.col("no").alias("trace_no"), "start_line").agg(joined_text())


def tracebacks(lines: DataFrame, tail: str = "parity") -> DataFrame:
    """(job_id, trace_no, start_line, text): exception traces.

    Marks are found and written first, a few bytes each; spans come from `trace_spans`, and their lines are fetched.
    tail="parity" ends a trace before a flush-left line that follows a source line; "complete" takes that line along,
    which usually names the exception.
    """
    if tail not in ("parity", "complete"):
        raise ValueError("tail is parity or complete")
    lines = known(lines)
    marks = Tables(lines.sparkSession, "traces").put(trace_marks(lines), "marks")
    jobs = marks.select(*keys(lines)).distinct()
    ends = lines.join(jobs, keys(lines), "left_semi").groupBy(*keys(lines)).agg((F.max("line_no") + 1).alias("n"))
    return trace_texts(shown(lines, trace_spans(marks, ends, tail)))
