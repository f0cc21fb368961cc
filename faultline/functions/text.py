"""Column helpers for log text. Patterns are Java's with (?dU): only a line feed ends a line, classes are Unicode."""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import rules

LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def java(pattern: str) -> str:
    return "(?dU)" + pattern


@cache
def literals(pattern: str) -> tuple[str, ...]:
    """For each alternative of a pattern a text that all its matches contain; none if some alternative has no text of three characters.

    Read from left to right: what stands in a group of its own, in a class or under a quantifier is left out, and of the
    runs that stay the longest is taken. A group around all alternatives is opened first.
    """
    body = re.sub(r"^\(\?i\)", "", pattern)
    body = re.sub(r"^\^|\\b", "", body)
    if (whole := re.fullmatch(r"\((?!\?)([^()]*)\)", body)) is not None:
        body = whole[1]
    found: list[list[str]] = [[""]]
    at = depth = 0
    while at < len(body):
        c, step = body[at], 1
        if c == "\\":
            c, step = body[at + 1], 2
            plain = not c.isalnum()
        else:
            plain = c not in ".^$*+?{}[]()|"
        if depth == 0 and c == "|" and step == 1:
            found.append([""])
        elif depth == 0 and plain and body[at + step : at + step + 1] not in ("?", "*", "{"):
            found[-1][-1] += c
        else:
            found[-1].append("")
        if step == 1 and c in "([":
            depth += 1
        elif step == 1 and c in ")]":
            depth -= 1
        at += step
    best = [max(runs, key=len) for runs in found]
    return tuple(best) if all(len(x) >= 3 for x in best) else ()


def may_have(column: Column, pattern: str) -> Column | None:
    """What a text must fulfil to match a pattern, by plain search; texts with other than ASCII characters always may."""
    words = literals(pattern)
    if not words:
        return None
    if pattern.startswith("(?i)"):
        small = F.lower(column)
        held = reduce(lambda a, b: a | b, (small.contains(w.lower()) for w in words))
        return held | (F.octet_length(column) != F.length(column))
    return reduce(lambda a, b: a | b, (column.contains(w) for w in words))


def has(column: Column, pattern: str) -> Column:
    """Whether a text matches; the pattern is tried only on texts that hold a text all its matches need."""
    match, may = column.rlike(java(pattern)), may_have(column, pattern)
    return match if may is None else may & match


def strip(column: Column) -> Column:
    return F.regexp_replace(column, SPACE, "")


def split_lines(column: Column) -> Column:
    """Lines of a text; the last break ends a line and starts none."""
    parts = F.split(column, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def fingerprint(column: Column) -> Column:
    """What stays of an error text when times, addresses, hosts and numbers are taken out; 200 characters."""
    return F.substring(reduce(lambda c, step: F.regexp_replace(c, java(step[0]), step[1]), rules.FINGERPRINT_STEPS, strip(column)), 1, 200)


def without_volatile(column: Column) -> Column:
    return strip(F.regexp_replace(column, java(rules.VOLATILE), ""))


def tokens(column: Column) -> Column:
    found = F.regexp_extract_all(column, F.lit(java(r"[a-zA-Z_][a-zA-Z0-9_]{2,}")), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def short_hash(column: Column) -> Column:
    return F.substring(F.sha2(column, 256), 1, 16)


def clip_middle(column: Column, most: int) -> Column:
    """Head of two thirds cut back to a line feed, mark, and tail cut forward to one, where a text is too long."""
    head, tail = most * 2 // 3, most - most * 2 // 3
    start = F.substring(column, 1, head)
    back = F.instr(F.reverse(start), "\n")
    kept = F.when(back > 0, F.substring(start, F.lit(1), F.lit(head) - back)).otherwise(start)
    end = F.substring(column, F.length(column) - tail + 1, F.lit(tail))
    ahead = F.instr(end, "\n")
    rest = F.when(ahead > 0, F.substring(end, ahead, F.length(end))).otherwise(end)
    return F.when(F.length(column) <= most, column).otherwise(F.concat(kept, F.lit(rules.CLIP_MARK), rest))


def truncated(column: Column, most: int) -> Column:
    """The text, or its start with a note of both lengths."""
    note = F.format_string(rules.TRUNCATED, F.lit(f"{most:,}"), F.format_number(F.length(column), 0))
    return F.when(F.length(column) <= most, column).otherwise(F.concat(F.substring(column, 1, most), note))


def html_escape(column: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        column = F.replace(column, F.lit(plain), F.lit(safe))
    return column
