"""Secret scans from Spark functions alone.

Rules find assignments, access keys and hexadecimal runs. Beside them, candidate strings outside those spans are
scanned with a sliding window by character class: a fold over the characters keeps the count of each symbol in the
window and the sum of count * log2(count), adds the one that enters, takes off the one that leaves, and so has each
window's Shannon entropy in constant work; counts are five bits each in a few words. A candidate with a window over
its class's threshold is added whole, unless the allow-list names it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}+"  # a run of 16 or more starts where the run starts


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of one class: what they look like, their alphabet, window, and the entropy in bits that marks a window."""

    form: str
    alphabet: str
    window: int
    bits: float


UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
# The first class whose form a candidate has; digits alone are of no class.
CLASSES = (
    CharacterClass(r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]{16,}$", DIGITS + "ABCDEF", 16, 2.9),
    CharacterClass(r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]{20,}$", DIGITS + UPPER, 20, 3.6),
    CharacterClass(r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]{20,}$", DIGITS + LOWER, 20, 3.6),
    CharacterClass(r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]{24,}$", UPPER + LOWER, 24, 4.2),
    CharacterClass(r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).{20,}$", UPPER + LOWER + DIGITS + "+/_-", 20, 3.6),
)
BLOCK = 64
# Strings of high entropy that are no secrets: paths and addresses, dotted or dashed words, unique ids by form.
ALLOWED = (r"^[A-Za-z]+(?:[/_-][A-Za-z]+)+$", r"^(?:https?|ftp|www|file|data)[:/]", r"(?i)example|placeholder|changeme|dummy|redacted", r"^(.{1,4}?)\1{3,}")


def gaps(text: Column, pattern: str) -> Column:
    """Lengths of the stretches before, between and after the matches, in code points."""
    return F.transform(F.split(text, pattern, -1), lambda x: F.length(x))


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def placed(text: Column, pattern: str, part: int = 0) -> Column:
    """Matches of a pattern as array<struct<s, e, x>>: start, end, and the text of a group.

    Matches never are empty, so matches and the stretches between them take turns, and places are running sums of
    their lengths. A fold that appends copies what it has, so sums run within blocks of BLOCK matches, and then over
    the blocks.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(part)) if part else found
    rows = F.arrays_zip(gaps(text, pattern).alias("gap"), found.alias("m"), groups.alias("g"))
    kind = "array<struct<s:int,e:int,x:string>>"

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + row["gap"]
        end = start + F.length(row["m"])
        span = F.array(F.struct(start.alias("s"), end.alias("e"), row["g"].alias("x")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(row["m"].isNull(), state["out"]).otherwise(F.concat(state["out"], span)).alias("out"))

    def summed(all_rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(all_rows, b * BLOCK + 1, F.lit(BLOCK)), start, step))
        return let(blocks, moved)

    def moved(blocks: Column) -> Column:
        after = lambda state, b: F.struct((state["at"] + b["at"]).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        offsets = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), after, lambda s: s["out"])
        shift = lambda b, o: F.transform(b["out"], lambda x: F.struct((x["s"] + o).alias("s"), (x["e"] + o).alias("e"), x["x"].alias("x")))
        return F.flatten(F.zip_with(blocks, offsets, shift))

    return F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(let(rows, summed))


def masked(text: Column, pattern: str, least: int, part: int = 0) -> Column:
    """The text with each match whose group has at least `least` characters blanked, length unchanged."""
    group = lambda m: F.regexp_extract(m, pattern, part) if part else m
    blank = lambda m: F.when(F.length(group(m)) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m)

    def cut(found: Column) -> Column:
        rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"))
        return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.transform(rows, lambda r: F.concat(r["gap"], F.coalesce(blank(r["m"]), F.lit("")))), ""))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), cut)


def entropic(string: Column, kind: CharacterClass) -> Column:
    """Whether a window of the string reaches the class's entropy."""
    size, most = kind.window, kind.bits
    a_word = 12  # counts of five bits in a long
    words = range(-(-len(kind.alphabet) // a_word))
    # c * log2(c) of each count that a window can hold
    weight = F.array(F.lit(0.0), *(F.lit(float(c)) * F.log2(F.lit(float(c))) for c in range(1, size + 1)))
    # the place of a character in the alphabet, from 0
    code = lambda i: F.call_function("instr", F.lit(kind.alphabet), F.substring(string, i, F.lit(1))) - 1
    shift = lambda name, x, k: F.call_function(name, x, k)

    def step(state: Column, i: Column) -> Column:
        return let(F.struct(code(i).alias("into"), F.when(i > size, code(i - size)).otherwise(-1).alias("out")), lambda c: moved(state, i, c["into"], c["out"]))

    def count(state: Column, c: Column) -> Column:
        word = F.get(F.array(*(state[f"w{w}"] for w in words)), F.floor(c / a_word).cast("int"))
        return shift("shiftright", word, c % a_word * 5).bitwiseAND(F.lit(31)).cast("int")

    def moved(state: Column, i: Column, into: Column, out: Column) -> Column:
        change, old = into != out, out >= 0
        n, m = count(state, into), count(state, out)
        more = F.when(change, F.get(weight, n + 1) - F.get(weight, n)).otherwise(0.0)
        less = F.when(change & old, F.get(weight, m) - F.get(weight, m - 1)).otherwise(0.0)
        total = state["sum"] + more - less
        one = lambda c, w: F.when(F.floor(c / a_word) == w, shift("shiftleft", F.lit(1).cast("long"), c % a_word * 5)).otherwise(F.lit(0).cast("long"))
        bits = F.when(i >= size, F.log2(F.lit(float(size))) - total / size).otherwise(0.0)
        return F.struct(*((state[f"w{w}"] + one(into, w) - F.when(old, one(out, w)).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words), total.alias("sum"), F.greatest(state["best"], bits).alias("best"))

    start = F.struct(*(F.lit(0).cast("long").alias(f"w{w}") for w in words), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.length(string)), start, step, lambda s: s["best"] >= most)


def keep(spans: Column, test) -> Column:
    return F.filter(spans, lambda x: test(x["x"]))


def tagged(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e")))


def shown(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans): base and spans are "kind:start:end,..." by start, then kind.

    Offsets are code points, ends exclusive. Null and empty texts have no spans. One row for each input row, also
    where ids repeat or are null. A very long text is scanned whole; work grows with its length and its matches.
    Other columns are ignored.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(
        "id",
        "text",
        keep(placed(text, ASSIGN, 1), lambda x: F.length(x) >= 12).alias("assign"),
        keep(placed(text, ACCESS), lambda x: F.length(x) >= 18).alias("access"),
        placed(text, HEX).alias("hex"),
    )
    base = F.concat(tagged(F.col("assign"), 0), tagged(F.col("access"), 1), tagged(F.col("hex"), 2))
    rows = rows.select("id", "text", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), base.alias("base"))
    blanked = let(masked(text, ASSIGN, 12, 1), lambda t: let(masked(t, ACCESS, 18), lambda u: masked(u, HEX, 16)))
    rows = rows.withColumn("found", placed(F.when(F.size("base") == 0, text).otherwise(blanked), CANDIDATE))
    plain = lambda x: ~x["x"].rlike("|".join(f"(?:{a})" for a in ALLOWED))

    def marked(x: Column) -> Column:
        chain = F.when(x["x"].rlike("^[0-9]+$"), False)
        for c in classes:
            chain = chain.when(x["x"].rlike(c.form), entropic(x["x"], c))
        return chain.otherwise(False)

    more = tagged(F.filter(F.filter("found", plain), marked), 3)
    rows = rows.select("id", "n_assign", "n_access", "n_hex", "base", more.alias("more"))
    return rows.select("id", "n_assign", "n_access", "n_hex", shown(F.col("base")).alias("base"), shown(F.concat("base", "more")).alias("spans"))
