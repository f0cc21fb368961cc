"""Rule-based verdicts on the failure text of a job: type, severity, reason, and the corrections to a model's reply."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import rules
from faultline.functions.text import has, java, split_lines, strip

RANK = {s: i for i, s in enumerate(rules.SEVERITIES)}


def lookup(column: Column, table: dict[str, str], default: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, column), default)


def rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 99 for anything else."""
    return reduce(lambda chain, item: chain.when(severity == item[0], item[1]), RANK.items(), F.when(F.lit(False), 99)).otherwise(99)


def normal_severity(value: Column) -> Column:
    plain = F.lower(strip(value))
    named = lookup(plain, rules.SEVERITY_ALIASES, plain)
    return F.when(named.isin(*rules.SEVERITIES), named).otherwise("medium")


def normal_type(value: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(strip(value)), "[- ]", "_"), "[^a-z0-9_]", "")
    named = lookup(plain, rules.TYPE_ALIASES, plain)
    return F.when(named.isin(*rules.FAILURE_TYPES), named).otherwise("unknown")


def inferred_type(text: Column) -> Column:
    small = F.lower(text)
    return reduce(lambda chain, r: chain.when(has(small, r[1]), r[0]), rules.TYPE_RULES, F.when(F.lit(False), "")).otherwise("unknown")


def concrete(text: Column, field: int) -> Column:
    """Type (field 0) or severity (field 1) of the gravest known form, else null."""
    return reduce(lambda chain, r: chain.when(has(text, "(?i)" + r[2]), r[field]), rules.CONCRETE_RULES, F.when(F.lit(False), ""))


def _first(lines: Column, pick) -> Column:
    return F.get(F.filter(F.transform(lines, pick), lambda x: x.isNotNull() & (x != "")), F.lit(0))


def reason(text: Column) -> Column:
    """The failure reason that a text gives: a decisive line at once, else stderr, else its own field, else a failed command."""
    lines = F.transform(split_lines(text), strip)
    group = lambda x, pattern: F.nullif(F.regexp_extract(x, java(pattern), 1), F.lit(""))
    decisive = lambda x: F.coalesce(
        group(x, r"(No module named '[^']+')"),
        F.when(F.lower(x).contains("failed to fetch package version") | F.lower(x).contains("error reimaging"), F.substring(x, 1, 300)),
        F.substring(group(x, r"(?i)(valgrind error:.*)"), 1, 300),
    )
    stderr = lambda x: F.when(F.lower(x).contains("stderr"), F.substring(strip(F.coalesce(*(group(x, f"(?i)({p})") for p in rules.STDERR_REASONS))), 1, 300))
    field = lambda x: F.when(F.lower(x).startswith("failure_reason:"), F.substring(F.regexp_replace(F.substring(x, 16, 1 << 20), r"^[' ]+|[' ]+$", ""), 1, 300))
    command = lambda x: F.substring(group(x, r"(?i)^.*?(Command failed\s*(?:\(.*?\))?\s*(?:on \w+\s*)?with status \d+.*)"), 1, 300)
    fields = F.filter(F.transform(lines, field), lambda x: x.isNotNull())
    last = F.nullif(F.get(fields, F.size(fields) - 1), F.lit(""))
    err = _first(lines, stderr)
    told = F.when(err.isNotNull(), F.when(last.isNotNull(), F.concat(err, F.lit(" ("), F.substring(last, 1, 100), F.lit(")"))).otherwise(err))
    return F.coalesce(_first(lines, decisive), told, last, _first(lines, command))


def first_signal_line(text: Column) -> Column:
    lines = F.transform(split_lines(text), strip)
    return F.substring(F.get(F.filter(lines, lambda x: (x != "") & ~has(x, rules.METADATA) & has(x, rules.ERROR_LINE)), F.lit(0)), 1, 300)


def ungrounded(cause: Column, text: Column) -> Column:
    """Whether a stated cause names things that the text lacks: known inventions, or a quotation of 5 or more characters."""
    low, log = F.lower(cause), F.lower(text)
    known = reduce(lambda a, b: a | b, (low.contains(w) & ~log.contains(w) for w in rules.HALLUCINATIONS))
    quotes = F.regexp_extract_all(cause, F.lit(r"['\"]([^'\"]{5,})['\"]"), F.lit(1))
    return known | F.exists(quotes, lambda q: ~log.contains(F.lower(q)))


def verdicts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with root_cause, severity, failure_type, error_category, confidence, explanation, recommended_action, fix_suggestions.

    Columns of these names that rows has already are a model's reply and are corrected; what is missing counts as
    no reply. Each step reads the step before it, so steps are staged in selects.
    """
    blank = {"root_cause": "", "severity": "medium", "failure_type": "unknown", "error_category": "", "explanation": "", "recommended_action": ""}
    given = {c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in blank.items()}
    given["confidence"] = F.coalesce(F.col("confidence"), F.lit(0.0)) if "confidence" in rows.columns else F.lit(0.0)
    given["fix_suggestions"] = F.coalesce(F.col("fix_suggestions"), F.array().cast("array<string>")) if "fix_suggestions" in rows.columns else F.array().cast("array<string>")
    text = F.col(text_col)
    out = rows.withColumns(given).withColumns({"_lie": ungrounded(F.col("root_cause"), text), "_type": inferred_type(text), "_ptype": concrete(text, 0), "_psev": concrete(text, 1)})
    for c, empty in (("root_cause", ""), ("explanation", ""), ("error_category", ""), ("confidence", 0.0)):
        out = out.withColumn(c, F.when(F.col("_lie"), F.lit(empty)).otherwise(F.col(c)))
    kind = F.when(F.col("failure_type") != "unknown", F.col("failure_type")).when(F.col("_type") != "unknown", F.col("_type")).otherwise(F.coalesce("_ptype", F.lit("unknown")))
    worse = F.when(F.col("_psev").isNotNull() & (rank(F.col("_psev")) < rank(F.col("severity"))), F.col("_psev")).otherwise(F.col("severity"))
    out = out.withColumns({"failure_type": kind, "severity": F.when(worse.isin(*rules.SEVERITIES), worse).otherwise("medium")})
    grave, light = F.col("failure_type").isin("crash", "config", "resource", "permission", "test_bug"), F.col("failure_type").isin("network", "timeout", "infra")
    lifted = F.when(grave & F.col("severity").isin("medium", "low"), "high").when(light & (F.col("severity") == "low"), "medium").otherwise(F.col("severity"))
    category = F.when(F.lower("error_category").isin("", "unknown"), lookup(F.col("failure_type"), rules.CATEGORIES, F.lit("unknown issue"))).otherwise(F.col("error_category"))
    guess = F.coalesce(reason(text), first_signal_line(text), F.concat(F.lit("Likely "), F.col("failure_type"), F.lit(" failure (heuristic)")))
    cause = F.when(F.lower("root_cause").isin("", "unknown", "n/a", "none"), guess).otherwise(F.col("root_cause"))
    out = out.withColumns({"severity": lifted, "error_category": category, "root_cause": cause})
    told = F.concat(F.lit("Heuristic classification: "), F.col("failure_type"), F.lit(". Root cause: "), F.substring("root_cause", 1, 200))
    out = out.withColumn("explanation", F.when(strip(F.col("explanation")) == "", told).otherwise(F.col("explanation")))
    action = F.when(strip(F.col("recommended_action")) == "", lookup(F.col("failure_type"), rules.ACTIONS, F.lit(rules.ACTIONS["unknown"]))).otherwise(F.col("recommended_action"))
    sure = F.when(F.col("confidence") <= 0, F.when(F.col("failure_type") != "unknown", 0.65).otherwise(0.4))
    sure = sure.when((F.col("failure_type") != "unknown") & (F.col("confidence") < 0.5), 0.5).otherwise(F.col("confidence"))
    out = out.withColumns({"recommended_action": action, "confidence": sure})
    out = out.withColumn("fix_suggestions", F.when(F.size("fix_suggestions") == 0, F.array("recommended_action")).otherwise(F.col("fix_suggestions")))
    return out.drop("_lie", "_type", "_ptype", "_psev")


def parsed_reply(reply: Column) -> Column:
    """A model's reply as a VARIANT object: as it is, else its last object with a verdict's key, else repaired, else null."""
    bare = F.regexp_replace(strip(F.coalesce(reply, F.lit(""))), r"(?is)^```(?:json)?\s*|\s*```$", "")
    as_object = lambda x: F.when(strip(x).rlike(r"(?s)^\{.*\}$"), F.try_parse_json(x))
    inner = F.filter(F.regexp_extract_all(bare, F.lit(r"(?s)\{(?:[^{}]|\{[^{}]*\})*\}"), F.lit(0)), lambda x: x.rlike(r'"(?:root_cause|failure_type|severity)"') & F.try_parse_json(x).isNotNull())
    last = F.try_parse_json(F.get(inner, F.size(inner) - 1))
    wide = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    repaired = F.try_parse_json(F.regexp_replace(wide, r",\s*([}\]])", "$1"))
    return F.coalesce(as_object(bare), last, F.try_parse_json(F.nullif(wide, F.lit(""))), repaired)


def valid_reply(v: Column) -> Column:
    """All four keys, a confidence that is a number, and severity and type that are not blank."""
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    filled = lambda k: F.coalesce(strip(text(k)) != "", F.lit(False))
    return F.coalesce(v.isNotNull() & text("root_cause").isNotNull() & F.try_variant_get(v, "$.confidence", "double").isNotNull() & filled("severity") & filled("failure_type"), F.lit(False))


def from_replies(rows: DataFrame, reply_col: str = "raw_reply", text_col: str = "text") -> DataFrame:
    """rows with the verdict that a reply gives after validation and correction."""
    v = F.col("_reply")
    text = lambda k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    listed = F.try_variant_get(v, "$.fix_suggestions", "array<string>")
    plain = text("fix_suggestions")
    split = F.filter(F.transform(F.split(plain, F.when(plain.contains(","), ",").otherwise("\n")), strip), lambda x: x != "")
    out = rows.withColumn("_reply", parsed_reply(F.col(reply_col)))
    out = out.withColumns(
        {
            "json_valid": valid_reply(v),
            "root_cause": text("root_cause"),
            "severity": normal_severity(F.try_variant_get(v, "$.severity", "string")),
            "failure_type": normal_type(F.try_variant_get(v, "$.failure_type", "string")),
            "error_category": text("error_category"),
            "explanation": F.when(valid_reply(v), text("explanation")).otherwise(""),
            "recommended_action": text("recommended_action"),
            "fix_suggestions": F.coalesce(listed, split),
            "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_variant_get(v, "$.confidence", "double"), F.lit(0.0)))),
        }
    )
    return verdicts(out.drop("_reply"), text_col)
