"""Benchmark decontamination by winnowing, from Spark functions alone.

Every text's k-grams are hashed, and of each run of consecutive hashes the smallest (the last of equals) is its
fingerprint. Two texts that share a window of `window` words share all its grams, so they choose the same gram at
the same place of it. Documents' fingerprints join the benchmark's, and each hit is extended to the windows around
it by comparing words. Items shorter than a window are looked up whole, at every place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, GRAM = 10, 5
BROADCAST_ROWS = 100_000
BROADCAST_WORDS = 5_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A to Z lower-cased; lower() does the same where all characters are ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    small = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(small, NOT_WORD, -1), "")


def let(value: Column, use) -> Column:
    """use(value) with value computed once: the optimizer may copy a column into a lambda, but not a lambda's variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grams(w: Column, size: int, tag: int) -> Column:
    """array<struct<g, h, p>>: tag, hash, and minus the place (from 1) of every gram of a number of words."""
    n = F.size(w) - size + 1
    # elements one by one: slice() copies the whole array at every call
    hashed = lambda i: F.xxhash64(*(F.get(w, i + (j - 1)) for j in range(size)))
    made = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit(tag).alias("g"), hashed(i).alias("h"), (-i).alias("p")))
    return F.when(n >= 1, made).otherwise(F.array().cast("array<struct<g:int,h:bigint,p:int>>"))


def winnowed(made: Column, run: int) -> Column:
    """Of each run of consecutive grams the least hash, the last of equals; each chosen gram once."""
    starts = F.size(made) - run + 1
    least_of = lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0]
    least = F.transform(F.sequence(F.lit(1), starts), lambda i: least_of(*(F.get(made, i + (j - 1)) for j in range(run))))
    least = F.when(starts >= 1, least).otherwise(F.filter(made, lambda x: F.lit(False)))
    return let(least, lambda m: F.filter(m, lambda x, i: (i == 0) | (x["p"] != F.get(m, i - 1)["p"])))


def prints(w: Column, window: int, gram: int, short: list[int], last: bool = False) -> Column:
    """array<struct<n, g, h, p, c>>: fingerprints, and all grams of the short items' lengths.

    n is the text's number of words. A print brings along the words c around it, as far as a window over it can
    reach and null beyond the text: so rows made from prints need no copy of the whole text. With last, an entry
    without print ends the array.
    """
    chosen = let(grams(w, gram, 0), lambda made: winnowed(made, window - gram + 1))
    chosen = reduce(F.concat, (grams(w, n, n) for n in short), chosen)
    near = lambda x: F.array(*(F.get(w, -x["p"] - 1 + j) for j in range(gram - window, window)))
    count = F.size(w).alias("n")
    out = F.transform(chosen, lambda x: F.struct(count, x["g"].alias("g"), x["h"].alias("h"), x["p"].alias("p"), near(x).alias("c")))
    none = F.struct(count, F.lit(-1).alias("g"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("array<string>").alias("c"))
    return F.concat(out, F.array(none)) if last else out


def judged(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """contamination() with the hash of each row's text; of a very long text a task holds its words and their hashes."""
    if not 0 < gram <= window:
        raise ValueError("a gram must fit into a window")
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    short = [r.n for r in items.select(F.size("w").alias("n")).where(F.col("n") < window).distinct().collect()]  # fewer than window
    parts = [(F.size("w") >= window, []), *((F.size("w") == n, [n]) for n in short)]
    keys = reduce(DataFrame.unionByName, (items.where(of).withColumn("f", F.explode(prints(F.col("w"), window, gram, lengths))) for of, lengths in parts))
    keys = keys.select("item", F.col("w").alias("iw"), F.col("f.g").alias("ig"), F.col("f.h").alias("ih"), F.col("f.p").alias("iq"))
    size = keys.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("iw")), F.lit(0)).alias("words")).first()
    small = size.rows <= BROADCAST_ROWS and size.words <= BROADCAST_WORDS

    # a row for each fingerprint, and one without for each input row
    every = let(words(F.col(text_col)), lambda w: prints(w, window, gram, short, last=True))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"), F.monotonically_increasing_id().alias("row"), every.alias("every"))
    rows = rows.select("row", "id", "hash", F.explode("every").alias("f")).select("row", "id", "hash", "f", F.col("f.n").alias("n"), F.col("f.g").alias("g"), F.coalesce("f.h", "row").alias("h"))
    # a benchmark too large to send everywhere meets the fingerprints in a shuffle
    found = rows.join(F.broadcast(keys) if small else keys, (F.col("g") == F.col("ig")) & (F.col("h") == F.col("ih")), "left")
    found = found.where("ih is not null or g < 0")

    # a hit at item place q: windows over the gram start at most window - gram words before it
    q, span = -F.col("iq"), F.least(F.lit(window), F.size("iw"))
    low, high = F.greatest(F.lit(1), q - (window - gram)), F.least(F.size("iw") - span + 1, q)
    same = lambda s: F.forall(F.sequence(F.lit(0), span - 1), lambda j: F.get("f.c", s - q + j + (window - gram)).eqNullSafe(F.get("iw", s + j - 1)))
    begins = F.when(high >= low, F.filter(F.sequence(low, high), same))
    found = found.select("row", "id", "hash", "n", "item", "ih", span.alias("span"), F.transform(begins, lambda s: s - q - F.col("f.p")).alias("begins"))
    found = found.where("ih is null or size(begins) > 0")
    cover = F.flatten(F.transform("begins", lambda s: F.sequence(s, s + F.col("span") - 1)))
    done = found.groupBy("row").agg(
        F.first("id").alias("id"), F.first("hash").alias("hash"), F.first("n").alias("n_words"), F.collect_list(F.array_distinct(cover)).alias("cover"), F.collect_set(F.when(F.col("ih").isNotNull(), F.col("item"))).alias("items")
    )
    return done.select("id", "hash", F.col("n_words").cast("long").alias("n_words"), F.size(F.array_distinct(F.flatten("cover"))).cast("long").alias("n_hit"), F.array_sort("items").alias("items"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """(id, n_words, n_hit, items): one row for each input row; items holds ids as strings, in their order.

    A window is `window` consecutive words of an item; a shorter item is one window, one without words is none. A
    word is hit if an occurrence of a window covers it. Null and empty texts have no words. Rows that repeat an id
    are judged each on their own; items that repeat an id are one item; a null item id hits words but is not
    listed. Of a very long text a task holds the words and their hashes. Other columns are ignored.
    """
    return judged(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram).drop("hash")
