"""Near-duplicate lines by a segment-partition edit join, from Spark functions alone.

Lines within `edits` edits of each other: a line is cut into edits + 1 even segments, and of any two such lines some
segment of the shorter (or equal) one stands unbroken in the longer one, near its own place. Each distinct line
files its segments under (length, segment number, text), and looks up the substrings of itself that could match
a segment of a line up to `edits` shorter. Lines that meet and whose letter counts allow it are compared by a
bit-parallel automaton over the band of 2 * edits + 1 diagonals, between their common start and their common end.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Workspace, fresh

EDITS = 2
LEAST_CHARS = 20
BROADCAST_IDS = 200_000
PAIRS_A_TASK = 1_000
MOST_TASKS = 8  # times the number of shuffle partitions
SKETCH = "etaonirshldcumfp"
HEAD = 24  # characters after which most unlike lines are told apart


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def segments(n: Column, edits: int) -> list[tuple[Column, Column]]:
    """(start from 1, length) of each even segment of a line of n characters; the last ones take the rest."""
    parts = edits + 1
    short, rest = F.floor(n / parts).cast("int"), n % parts
    out, start = [], F.lit(1)
    for i in range(parts):
        size = short + (rest >= parts - i).cast("int")
        out.append((start, size))
        start = start + size
    return out


def part(wide: Column, start: Column, size: Column) -> Column:
    """size characters from start of a line in four-byte characters, where every place is found at once."""
    return F.substring(wide, start * 4 - 3, size * 4)


def filed(wide: Column, n: Column, edits: int) -> list[Column]:
    """Keys of a line's own segments."""
    return [F.hash(n, F.lit(i), part(wide, start, size)) for i, (start, size) in enumerate(segments(n, edits))]


def sought(wide: Column, n: Column, edits: int) -> list[Column]:
    """Keys of all substrings that a segment of a line of n - edits to n characters could have become."""
    keys = []
    for less in range(edits + 1):
        for i, (start, size) in enumerate(segments(n - less, edits)):
            # i edits at most before segment i, edits - i at most after it
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                keys.append(F.hash(n - less, F.lit(i), part(wide, start + shift, size)))
    return keys


def sketch(line: Column) -> Column:
    """Counts of sixteen letters modulo 4, two bits each; an edit moves two of them by one at most.

    Each letter is counted by what its removal takes from a line without the letters before it.
    """
    bits, rest = [], line
    for k, c in enumerate(SKETCH):
        less = F.replace(rest, F.lit(c), F.lit(""))
        bits.append(F.shiftleft((F.octet_length(rest) - F.octet_length(less)).bitwiseAND(3).cast("long"), 2 * k))
        rest = less
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def apart(a: Column, b: Column) -> Column:
    """The least number of letters that two sketches differ by, going round the 4.

    For all letters at once: of a difference modulo 4 the low bit is 1 for one letter more or less, and the high bit
    alone for two.
    """
    ones = F.lit(0x55555555)
    low = a.bitwiseXOR(b).bitwiseAND(ones)
    high = F.shiftright(a, 1).bitwiseXOR(F.shiftright(b, 1)).bitwiseAND(ones)
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(low.bitwiseXOR(ones)))


def shared(a: Column, b: Column, most: Column, from_end: bool) -> Column:
    """How many characters, at most `most`, two lines in four-byte characters share at their start or end.

    The number is found bit by bit from the top: of each power of two, whether so many more characters agree.
    """
    chars = lambda x: F.octet_length(x) / 4
    tail = lambda x, at, k: F.substring(x, ((chars(x) - at - k) * 4 + 1).cast("int"), (k * 4).cast("int"))
    head = lambda x, at, k: F.substring(x, (at * 4 + 1).cast("int"), (k * 4).cast("int"))
    piece = tail if from_end else head
    powers = F.reverse(F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int")), lambda i: F.call_function("shiftleft", F.lit(1), i)))
    return F.aggregate(powers, F.lit(0), lambda at, k: F.when((at + k <= most) & (piece(a, at, k) == piece(b, at, k)), at + k).otherwise(at))


def automaton(s: Column, t: Column, edits: int, steps: Column) -> Column:
    """The mask of diagonals reached with at most `edits` edits after so many characters of t; s and t are arrays."""
    band, full = range(-edits, edits + 1), (1 << (2 * edits + 1)) - 1
    start = F.struct(*(F.lit(sum(1 << (d + edits) for d in range(e + 1))).alias(f"r{e}") for e in range(edits + 1)))

    def step(state: Column, j: Column) -> Column:
        here = F.get(t, j)
        match = reduce(add, (F.when(F.get(s, j + d) == here, 1 << (d + edits)).otherwise(0) for d in band))
        new: list[Column] = []
        for e in range(edits + 1):
            r = state[f"r{e}"].bitwiseAND(match)
            if e:
                last = state[f"r{e - 1}"]
                r = r.bitwiseOR(last).bitwiseOR(F.shiftright(last, 1)).bitwiseOR(F.shiftleft(new[-1], 1).bitwiseAND(full))
            new.append(r)
        return F.struct(*(r.alias(f"r{e}") for e, r in enumerate(new)))

    return F.aggregate(F.sequence(F.lit(0), steps - 1), start, step, lambda x: x[f"r{edits}"])


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most `edits` edits apart.

    What the strings share at their starts and ends doesn't count. Over the rest a bit mask holds, for each number of
    edits, the diagonals that can be reached; each character of b moves all of them at once, and diagonals beyond
    the band need more edits than allowed. Where no diagonal is left after HEAD characters, the rest isn't read.
    """
    small = F.least(F.length(a), F.length(b))
    wide = lambda x: F.encode(x, "UTF-32")

    def core(cut: Column) -> Column:
        rest = lambda x: F.substring(x, cut["p"] + 1, F.length(x) - cut["p"] - cut["q"])
        return let(F.struct(rest(a).alias("a"), rest(b).alias("b")), compared)

    def compared(x: Column) -> Column:
        n, m = F.length(x["a"]), F.length(x["b"])
        letters = lambda s, k: F.split(F.substring(s, F.lit(1), k), "")
        head = let(letters(x["a"], F.lit(HEAD + edits)), lambda s: let(letters(x["b"], F.lit(HEAD)), lambda t: automaton(s, t, edits, F.size(t))))
        whole = let(F.split(x["a"], ""), lambda s: let(F.split(x["b"], ""), lambda t: automaton(s, t, edits, F.size(t))))
        reached = F.call_function("shiftright", whole, n - m + edits).bitwiseAND(1) == 1
        return F.when(F.least(n, m) == 0, F.greatest(n, m) <= edits).when((m > HEAD) & (head == 0), F.lit(False)).otherwise(reached)

    def cuts(w: Column) -> Column:
        start = let(shared(w["a"], w["b"], small, False), lambda p: F.struct(p.alias("p"), shared(w["a"], w["b"], small - p, True).alias("q")))
        return let(start, core)

    close = F.abs(F.length(a) - F.length(b)) <= edits
    return F.when(close, let(F.struct(wide(a).alias("a"), wide(b).alias("b")), cuts)).otherwise(False)


def keyed_lines(lines: DataFrame, edits: int) -> DataFrame:
    """(h, s, keys): hash, sketch and keys of each distinct line; first its own keys, then the sought ones."""
    wide, n = F.col("wide"), F.col("n")
    rows = lines.select("line", F.encode("line", "UTF-32").alias("wide"))
    rows = rows.select(F.xxhash64("line").alias("h"), sketch(F.col("line")).alias("s"), "wide", (F.octet_length("wide") / 4).cast("int").alias("n"))
    return rows.select("h", "s", F.array(*filed(wide, n, edits), *sought(wide, n, edits)).alias("keys")).distinct()


def candidates(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): hashes of distinct lines that share a segment and may be within `edits` edits, a < b.

    A row that meets others is two numbers: a line's hash, and a key of 32 bits before the sketch. Keys that are equal
    by chance cost a comparison.
    """
    keyed = keyed_lines(lines, edits)

    # both sides slice one array, so that they read one and the same exchange
    def side(keys: Column, h: str, mark: str) -> DataFrame:
        rows = keyed.select(F.col("h").alias(h), "s", F.explode(keys).alias("key"))
        return rows.select(h, F.shiftleft(F.col("key").cast("long"), 32).bitwiseOR(F.col("s")).alias(mark))

    own, look = side(F.slice("keys", 1, edits + 1), "x", "xk"), side(F.slice("keys", edits + 2, F.size("keys")), "y", "yk")
    maybe = (F.shiftright("xk", 32) == F.shiftright("yk", 32)) & (F.col("x") != F.col("y")) & (apart(F.col("xk"), F.col("yk")) <= 2 * edits)
    met = own.join(look, maybe).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return met.distinct()


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, no, line, at): lines that are not blank; at orders them by id and place."""
    rows = keyed(docs, id_col, text_col)
    lines = rows.select("k1", "k2", "id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where(F.col("line").rlike(r"\S"))
    place = F.coalesce("id", F.lit(-(2**63))).cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("no").cast("decimal(11,0)")
    return lines.select("k1", "k2", "no", "line", place.cast("decimal(38,0)").alias("at"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select(F.xxhash64("id", "text").alias("k1"), F.xxhash64(F.lit(1), "id", "text").alias("k2"), "id", "text")


def hashed(lines: DataFrame) -> DataFrame:
    return lines.select("*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def near_links(lines: DataFrame, work: Workspace, edits: int) -> DataFrame:
    """(h1, h2): lines within `edits` edits of another line that comes first earlier."""
    pairs = work.table(candidates(lines.select("line"), edits), "pairs")
    ids = work.table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:  # 8 bytes each
        ids = F.broadcast(ids)
    texts = lines.join(ids, F.xxhash64("line") == F.col("id"), "left_semi").groupBy("line").agg(F.min("at").alias("first"))
    texts = work.table(hashed(texts), "texts")
    side = lambda c: texts.select(*(F.col(x).alias(f"{c}_{x}") for x in texts.columns))
    both = pairs.join(side("a"), F.col("a") == F.col("a_h1")).join(side("b"), F.col("b") == F.col("b_h1"))
    # pairs are few bytes but much work: deal them by number, where their size would leave them to a few tasks, and to
    # a bounded number of tasks however many they are
    tasks = min(pairs.count() // PAIRS_A_TASK + 1, MOST_TASKS * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = both.select("a_line", "b_line", *(f"{s}_{c}" for s in "ab" for c in ("first", "h1", "h2"))).repartition(tasks, "a_h1", "b_h1")
    both = both.where(within(F.col("a_line"), F.col("b_line"), edits))
    later = lambda c: F.when(F.col("a_first") > F.col("b_first"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
    return both.where("a_first <> b_first").select(later("h1"), later("h2")).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(k1, k2, gone): for each row key with any, the numbers (from 0) of its lines that repeat an earlier one."""
    if not 0 <= edits <= 15 or least_chars <= edits:
        raise ValueError("edits must be from 0 to 15, and lines longer than that")
    work = Workspace(docs.sparkSession, "lines")
    lines = numbered(docs, id_col, text_col)
    late = work.table(near_links(lines.where(F.length("line") >= least_chars), work, edits).withColumn("late", F.lit(True)), "late")
    short = hashed(lines).select("k1", "k2", "no", "at", "h1", "h2")
    first = short.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n")).join(late, ["h1", "h2"], "left")
    first = work.table(first.where("n > 1 or late").select("h1", "h2", "first", F.coalesce("late", F.lit(False)).alias("late")), "first")
    gone = short.join(first, ["h1", "h2"]).where("late or at > first")
    return work.table(gone.groupBy("k1", "k2").agg(F.collect_set("no").alias("gone")), "gone")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The rows with n_lines, removed (line numbers from 0) and kept (the text without them) added.

    A line goes if an earlier line, by id and then by place, equals it, or is within `edits` edits of it where both
    have at least least_chars characters (in a shorter line two edits are another word); what comes earlier is judged
    on the input, so the first line of each kind stays. Blank lines stay. Lines end at line feeds. Null counts as an
    empty text of one empty line; a null id counts as the smallest. Rows equal in id and text are one document and
    get one result. A very long line is hashed and compared whole; a very long text is one array of lines in a task.
    Columns named like the added ones are replaced, others kept, whatever their names.
    """
    k1, k2, cut = fresh(docs, "k1", "k2", "cut")
    gone = repeated_lines(docs, id_col, text_col, edits, least_chars).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(cut))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    the_id = F.col(id_col).cast("long")
    rows = docs.select("*", F.xxhash64(the_id, text).alias(k1), F.xxhash64(F.lit(1), the_id, text).alias(k2))
    rows = rows.join(gone, [k1, k2], "left").withColumn("removed", F.array_sort(F.coalesce(cut, F.array().cast("array<int>"))))
    stay = let(F.split(text, "\n", -1), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i)), "\n"))
    kept = F.when(F.size("removed") == 0, text).otherwise(stay)
    size = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return rows.withColumns({"n_lines": size.cast("long"), "kept": kept}).drop(k1, k2, cut)
