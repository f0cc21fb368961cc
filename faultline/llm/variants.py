"""Spelling variants: words of a corpus, which of them differ by one edit, and the form that each is a variant of.

An edit lies in the first or in the second half of a word, so the other half is matched exactly: the first from the
root of a minimal acyclic automaton of the words, the second from that of the words read backward, and what remains is
completed with one error. States carry numbers that add up to a word's place in order, so a match needs no copy of the
words. The vocabulary is dealt by ranges of bounded size, each an automaton of its own, and a word is sought in the
ranges that its exact half falls into; of ranges that many words ask for there are several copies.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import Workspace

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
EVERY = 97
LEAST_CHARS, LEAST_COUNT = 5, 3
RANGE_WORDS = 50_000
MOST_RANGES = 65_536
ASKED = 200_000
EDGE = 64
HELD = 200_000
LAST = "\U0010ffff"


def with_slips(text: str, doc: bytes) -> Counter:
    """The text's runs with A to Z lower-cased, and how often; those whose crc32 with the document's id 97 divides lose a letter."""
    low: Counter = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        low[run.lower() if run.isascii() else run.translate(SMALL)] += n
    out: Counter = Counter()
    start = zlib.crc32(doc)
    for run, n in low.items():
        h = zlib.crc32(run.encode(), start)
        if h % EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = LEAST_CHARS, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of at least `chars` code points that occur at least `least` times; a task counts before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                for word, n in with_slips(text.as_py() or "", f"{doc.as_py() or ''}:".encode()).items():
                    if len(word) >= chars:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of distinct words in order, with their numbers.

    A state's edges lead to (state, words before): the numbers along a word's way add up to its place in order. A
    word's last states are looked up among those that are finished as soon as the next word leaves them.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.words: list[int] = []
        known: dict[tuple, int] = {}

        def finish(final: bool, edges: list[tuple[str, int]]) -> int:
            mark = (final, *edges)
            if (state := known.get(mark)) is None:
                state = known[mark] = len(self.edges)
                before, out = int(final), {}
                for c, child in edges:
                    out[c] = (child, before)
                    before += self.words[child]
                self.edges.append(out)
                self.final.append(final)
                self.words.append(before)
            return state

        # the way of the last word: [final, finished edges] of each state, and the letters between them
        way: list[list] = [[False, []]]
        last = ""
        for word in words:
            common = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                common += 1
            while len(way) > common + 1:
                final, edges = way.pop()
                way[-1][1].append((last[len(way) - 1], finish(final, edges)))
            way += [[False, []] for _ in range(len(word) - common)]
            way[-1][0], last = True, word
        while len(way) > 1:
            final, edges = way.pop()
            way[-1][1].append((last[len(way) - 1], finish(final, edges)))
        self.root = finish(*way[0])

    def rest(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that ends with word[at:] from a state, or -1."""
        edges = self.edges
        for c in word[at:]:
            if (edge := edges[state].get(c)) is None:
                return -1
            state, number = edge[0], number + edge[1]
        return number if self.final[state] else -1

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that begin with word[:half] and differ from the word by one edit behind it."""
        state, number, found = self.root, 0, set()
        for c in word[:half]:
            if (edge := self.edges[state].get(c)) is None:
                return found
            state, number = edge[0], number + edge[1]
        for at in range(half, len(word) + 1):
            own = word[at] if at < len(word) else ""
            for c, (child, before) in self.edges[state].items():
                # a letter more in a row of equal ones comes behind them, a letter less is the first of them
                if c != own:
                    found.add(self.rest(child, number + before, word, at))
                    if own:
                        found.add(self.rest(child, number + before, word, at + 1))
            if own and (at == half or word[at - 1] != own):
                found.add(self.rest(state, number, word, at + 1))
            if (edge := self.edges[state].get(own)) is None:
                break
            state, number = edge[0], number + edge[1]
        found.discard(-1)
        return found


FOUND = "word string, n_near long, form_n long, form string"


def half_of(word: str) -> int:
    return len(word) // 2


def one_way(words: DataFrame, work: Workspace, backward: bool, range_words: int = RANGE_WORDS, asked: int = ASKED) -> DataFrame:
    """FOUND rows of words (word, n): how many near words share the word's first half, or its second but not its first.

    form is the near word of largest n among them, the first in order of equals. A range's automaton and its words are
    held by a task: about a kilobyte a word.
    """
    name = "backward" if backward else "forward"
    read = F.reverse("word") if backward else F.col("word")
    size = words.count()
    ranges = max(1, min(MOST_RANGES, -(-size // range_words)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int64())], names=["key", "n", "part"])

    dealt = words.select(read.alias("key"), "n").repartitionByRange(ranges, "key").mapInArrow(number, "key string, n long, part long")
    dealt = work.table(dealt, f"{name}-ranges")
    # a row for each range, 65,536 at most: its number and the start of its first word
    starts = sorted(dealt.groupBy("part").agg(F.substring(F.min("key"), 1, EDGE).alias("first")).collect(), key=lambda r: r["part"])
    parts, firsts = [r["part"] for r in starts], [r["first"] for r in starts]

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], []]
            for word in batch.column(0).to_pylist():
                exact = word[half_of(word) :][::-1] if backward else word[: half_of(word)]
                low = max(0, bisect_left(firsts, exact[:EDGE]) - 1)
                for part in parts[low : bisect_right(firsts, exact + LAST)]:
                    out[0].append(word)
                    out[1].append(part)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64())], names=["word", "part"])

    sought = work.table(words.select("word").mapInArrow(seek, "word string, part long"), f"{name}-sought")
    copies = F.broadcast(sought.groupBy("part").agg(F.ceil(F.count("*") / asked).cast("long").alias("copies")))
    sought = sought.join(copies, "part").select("part", F.pmod(F.xxhash64("word"), "copies").alias("copy"), "word")
    dealt = dealt.join(copies, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "key", "n")
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])

    def match(held: pa.Table, asking: pa.Table) -> pa.Table:
        held = held.sort_by("key")
        keys, counts = held["key"].to_pylist(), held["n"].to_pylist()
        automaton, out = Automaton(keys), []
        for word in asking["word"].to_pylist():
            half = half_of(word)
            if backward:
                near = automaton.near(word[::-1], len(word) - half)
                # what shares the first half too is found by the other automaton
                near = [(i, x) for i in near if not (x := keys[i][::-1]).startswith(word[:half])]
            else:
                near = [(i, keys[i]) for i in automaton.near(word, half)]
            if near:
                n, form = min((-counts[i], x) for i, x in near)
                out.append((word, len(near), -n, form))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)

    return dealt.groupBy("part", "copy").cogroup(sought.groupBy("part", "copy")).applyInArrow(match, FOUND)


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms, by doubling the steps; a chain doubles its counts, so it is short."""
    ways = work.table(forms.select("word", "form"), "chains0")
    turn = 0
    while True:
        on = ways.select(F.col("word").alias("form"), F.col("form").alias("next"))
        ways = work.table(ways.join(on, "form", "left").select("word", F.coalesce("next", "form").alias("form"), F.col("next").isNotNull().alias("moved")), f"chains{turn + 1}")
        work.drop(f"chains{turn}")
        turn += 1
        if ways.where("moved").isEmpty():
            return ways.select("word", F.col("form").alias("root"))
        ways = ways.drop("moved")


def variants(words: DataFrame, more: float = 2.0, range_words: int = RANGE_WORDS, asked: int = ASKED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n); one row for each.

    Two words are near if one inserted, deleted or replaced code point tells them apart. A word's form is its near word
    of largest n, the first in code-point order of equals, if that n is `more` times its own; root follows forms to
    the last. Words without near words have n_near 0. Words of under two code points are near nothing. A word of any
    length is one way through an automaton. An empty table gives no rows.
    """
    work = Workspace(words.sparkSession, "variants")
    words = work.table(words.select("word", "n"), "words")
    found = None
    for backward in (False, True):
        rows = one_way(words.where(F.length("word") > 1), work, backward, range_words, asked)
        found = rows if found is None else found.unionByName(rows)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    large: Column = -F.col("best.m") >= F.col("n") * more
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.form")).alias("form"), F.when(large, -F.col("best.m")).alias("form_n")
    )
    judged = work.table(judged, "judged")
    ends = roots(judged.where("form is not null"), work)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants() of the words of whole texts.

    Null and empty texts have no words; a null id counts as an empty one; rows that repeat an id, or are equal, count
    each. A very long text is read by one task, which holds its distinct words. Other columns are ignored.
    """
    return variants(counted(docs, id_col, text_col))
