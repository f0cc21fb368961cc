"""One condensed text per job: sections of the extractors in order of priority, clipped to a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faultline.functions import rules
from faultline.functions.text import LINE_BREAK, clip_middle, fingerprint, has, split_lines
from faultline.operators import extract
from faultline.operators.extract import keys
from faultline.operators.tables import Tables

BUDGET = 24_000
ORDER = ("reason", "stderr", "context", "traces", "signals", "summary", "blocks")


def _job(rows: DataFrame) -> WindowSpec:
    return Window.partitionBy(*keys(rows))


def _unique(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each fingerprint of a job: times it occurs, place from 1, rows (all) and kinds of the job."""
    k = keys(rows)
    rest = [c for c in rows.columns if c not in (*k, order)]
    rows = rows.withColumn("fp", fingerprint(F.col(text))).groupBy(*k, "fp").agg(F.count("*").alias("times"), F.min(F.struct(order, *rest)).alias("x")).select(*k, "times", "x.*")
    return _placed(rows, order).withColumn("rows", F.sum("times").over(_job(rows)))


def _placed(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumns({"place": F.row_number().over(_job(rows).orderBy(order)), "kinds": F.count("*").over(_job(rows))})


def _section(name: str, rows: DataFrame, item: Column, most: int, *counts: Column) -> DataFrame:
    """(job_id, section, text): heading, the first items by place, and an empty line at the end."""
    k = keys(rows)
    rows = rows.where(F.col("place") <= most).select(*k, F.struct("place", item.alias("text")).alias("x"), *(c.alias(f"n{i}") for i, c in enumerate(counts)))
    head = F.lit(rules.HEADINGS[name]) if not counts else F.format_string(rules.HEADINGS[name], *(F.col(f"n{i}") for i in range(len(counts))))
    rows = rows.groupBy(*k, *(f"n{i}" for i in range(len(counts)))).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return rows.select(*k, F.lit(ORDER.index(name)).alias("section"), F.concat_ws("\n", head, F.array_join("xs.text", "\n"), F.lit("")).alias("text"))


def _listed(name: str, rows: DataFrame, item: Column, most: int, *counts: Column) -> DataFrame:
    """A section whose items bring their own empty line."""
    return _section(name, rows, item, most, *counts).withColumn("text", F.expr("substring(text, 1, length(text) - 1)"))


class Findings:
    """What a log's lines hold, found once and written: marks of all rules, traces' spans, and the lines that are shown.

    One pass evaluates the rules line by line and keeps the few lines that have a mark. The spans of blocks, windows,
    look-backs and traces follow from the marks, and their lines are fetched. Lines are a written table, for they are
    read several times; it goes with `close`.
    """

    def __init__(self, lines: DataFrame):
        line, k = F.col("line"), keys(lines)
        self.tables = tables = Tables(lines.sparkSession, "condense")
        self.lines = lines = tables.put(lines, "lines")
        self.ends = tables.put(extract.job_ends(lines), "ends")
        flags = {"error": extract.is_error(line), "strong": extract.is_strong(line), "signal_type": extract.signal_type(line), "start": has(line, rules.TRACEBACK_START), **extract.failing(line)}
        marks = lines.withColumns(flags).where("error or strong or signal_type is not null or start or failed or status > 0")
        self.marks = tables.put(marks.withColumn("line", F.when(F.col("signal_type").isNotNull(), line)), "marks")
        fails = self.marks.where("failed or status > 0").select(*k, F.col("line_no").alias("fail_line"), "failed", "host", "status")
        since = self.marks.where("start").groupBy(*k).agg(F.min("line_no").alias("since"))
        trace_marks = tables.put(extract.trace_marks(lines, since), "traces")
        spans = [
            extract.block_spans(self.marks.where("error")).withColumn("kind", F.lit("block")),
            extract.window_spans(self.marks.where("strong")).withColumn("kind", F.lit("window")),
            extract.trace_spans(trace_marks, self.ends).withColumn("kind", F.lit("trace")),
        ]
        self.shown = tables.put(extract.shown(lines, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), spans)), "shown")
        self.near = extract.shown(extract.remote(lines), extract.failure_spans(fails))
        self.blocks = tables.put(extract.deduplicated(extract.block_texts(self.of("block"))), "blocks")
        self.traces = tables.put(extract.trace_texts(self.of("trace")), "trace_texts")

    def of(self, kind: str) -> DataFrame:
        return self.shown.where(F.col("kind") == kind)

    def windows(self) -> DataFrame:
        return extract.window_texts(self.of("window"))

    def stderr(self) -> DataFrame:
        return extract.stderr_texts(self.near)

    def close(self) -> None:
        self.tables.drop("lines")


def sections(found: Findings) -> DataFrame:
    """(job_id, section, text): the sections that a job has, numbered in their order."""
    lines, k, ends = found.lines, keys(found.lines), F.lit("")
    reason = found.tables.put(extract.failure_reason(lines, ends=found.ends), "reasons")
    stderr = _unique(found.stderr(), "stderr", "fail_line")
    last = F.slice(F.split("stderr", "\n"), -F.least(F.lit(20), F.col("n_stderr")).cast("int"), 20)
    note = F.when(F.col("times") > 1, F.format_string(rules.STDERR_REPEATS, "times")).otherwise("")
    failed = F.concat_ws(
        "\n", F.format_string(rules.STDERR_ITEM, "place", "host", "status", note), F.when(F.col("command") != "", F.concat(F.lit(rules.STDERR_COMMAND), "command")), F.lit(rules.STDERR_LINES),
        F.array_join(F.transform(last, lambda x: F.concat(F.lit("  "), x)), "\n"), ends,
    )
    windows = _placed(found.windows().where("text <> ''"), "window_no")
    traces = _unique(found.traces, "text", "trace_no")
    blocks = _placed(found.blocks, "start_line")
    marked = found.marks.where("signal_type is not null")
    signals = extract.listed_signals(marked).withColumn("place", F.col("type_no") * 100 + F.col("item_no"))
    signals = signals.join(marked.groupBy(*k).agg(F.count("*").alias("rows")), k)
    summary = extract.tail_summary(lines, found.ends.join(reason.select(*k), k, "left_anti")).where("text <> ''")
    one = lambda rows: rows.withColumn("place", F.lit(1))
    titled = lambda form: F.concat_ws("\n", F.format_string(form, "place"), F.col("text"), ends)
    block = F.concat_ws("\n", F.format_string(rules.BLOCK_ITEM, "place", "start_line", "end_line"), F.col("text"), ends)
    # lists end with the empty line of their last item, so theirs are cut to it
    parts = [
        _section("reason", one(reason), F.col("reason"), 1),
        _listed("stderr", stderr, failed, 5, F.col("rows"), F.col("kinds")),
        _listed("context", windows, titled(rules.CONTEXT_ITEM), 3, F.col("kinds")),
        _listed("traces", traces, titled(rules.TRACE_ITEM), 5, F.col("kinds"), F.col("rows") - F.col("kinds")),
        _section("signals", signals, F.format_string(rules.SIGNAL_ITEM, "signal_type", "line"), 10**6, F.col("rows")),
        _section("summary", one(summary), F.col("text"), 1),
        _listed("blocks", blocks, block, 10, F.least(F.lit(10), "kinds"), F.col("kinds")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _condensed(found: Findings, most: int) -> DataFrame:
    k = keys(found.lines)
    rows = sections(found).groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("section", "text"))).alias("xs"))
    # only a job of one empty line has no section
    rows = found.ends.select(*k).join(rows, k, "left")
    text = F.coalesce(F.array_join("xs.text", "\n"), F.lit(rules.HEADINGS["tail"] + "\n"))
    return rows.select(*k, clip_middle(text, most).alias("condensed_text"))


def condensed(lines: DataFrame, most: int = BUDGET) -> DataFrame:
    """(job_id, condensed_text): one row for each job that has a line.

    Tokens of the headings and labels are part of the text that verdicts and signatures read. The lines are a table
    while this runs; its result is written.
    """
    found = Findings(extract.known(lines))
    texts = Tables(lines.sparkSession, "condensed").put(_condensed(found, most), "texts")
    found.close()
    return texts


def parsed(raw: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """raw (job_id, job_ord, raw_log) with condensed_text, tracebacks, error_blocks, total_lines and total_chars.

    Where raw has a run_id, equal job ids of two runs are two jobs. What logs hold is found once; raw is read for its lines
    and again by the result, so it should be a table or read from one.
    """
    k = keys(raw)
    raw = raw.select(*(F.col(c).cast("string").alias(c) for c in k), "job_ord", F.coalesce("raw_log", F.lit("")).alias("raw"))
    log = F.col("raw")
    if lines is None:
        lines = raw.select(*k, F.posexplode(split_lines(log)).alias("line_no", "line"))
    found = Findings(extract.known(lines))
    in_order = lambda order: F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    traces = found.traces.groupBy(*k).agg(in_order("trace_no").alias("tracebacks"))
    blocks = found.blocks.groupBy(*k).agg(in_order("start_line").alias("error_blocks"))
    texts = Tables(raw.sparkSession, "parsed").put(_condensed(found, BUDGET), "texts")
    found.close()
    rows = raw.select(*k, "job_ord", F.size(split_lines(log)).cast("long").alias("total_lines"), F.length(log).cast("long").alias("total_chars"), F.substring(log, 1, 2).alias("raw"))
    rows = rows.join(texts, k, "left").join(traces, k, "left").join(blocks, k, "left")
    none = F.array().cast("array<string>")
    # a log without a line, or of one line break, has no section; it is its own text
    bare = (F.col("total_lines") <= 1) & (F.regexp_replace("raw", LINE_BREAK, "") == "")
    text = F.when(bare, F.concat(F.lit(rules.HEADINGS["tail"] + "\n"), "raw")).otherwise(F.col("condensed_text"))
    return rows.withColumns({"condensed_text": text, "tracebacks": F.coalesce("tracebacks", none), "error_blocks": F.coalesce("error_blocks", none)}).drop("raw")


def parse_stats(parsed_jobs: DataFrame) -> DataFrame:
    """(job_id, total_lines, total_chars, tracebacks, error_blocks, condensed_chars): the size of what a log gave."""
    n = lambda c: F.size(c).cast("long").alias(c)
    return parsed_jobs.select(*keys(parsed_jobs), "total_lines", "total_chars", n("tracebacks"), n("error_blocks"), F.length("condensed_text").cast("long").alias("condensed_chars"))
