"""Queries of the numbered operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import bpe, decontaminate, embeddings, lines, merkle, packing, pii, quality, secrets, simhash, substring, variants, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.spans(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def secrets_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_secret_scan over documents, each third with a random-looking token of its own behind its text; the token's place is where added spans are."""
    docs = table(spark, sf_dir, "documents")
    token = F.base64(F.unhex(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" bearer "), F.substring(F.regexp_replace(token, "[^A-Za-z0-9]", "x"), 1, 40), F.lit(" end"))
    rows = secrets.spans(docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, text).otherwise(F.col("text"))))
    return rows.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(table(spark, sf_dir, "pages"))
    return rows.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


def warc_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_warc over the pages and two copies of each third of them under new ids, before and after their own: most records of those revisit."""
    pages = table(spark, sf_dir, "pages")
    some = pages.where("page_id % 3 = 0")
    more = [some.withColumn("page_id", F.col("page_id") + shift) for shift in (-1_000_000_000, 1_000_000_000)]
    found = warc.round_trip(pages.unionByName(more[0]).unionByName(more[1]))
    return found.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 1 + 10 * (i // 8)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM f
"""


COPIES_SQL = OP6_SQL.replace("FROM pages)", "FROM (SELECT page_id, html FROM pages UNION ALL SELECT page_id + s, html FROM pages, (VALUES (-1000000000), (1000000000)) v(s) WHERE page_id % 3 = 0))")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(10, len(w)) AS k, w[s:s + least(10, len(w)) - 1] AS g FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(s) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM i),
x AS (SELECT doc_id, s, k, w[s:s + k - 1] AS g FROM d, ks, unnest(range(1, len(w) - k + 2)) t(s)),
h AS (SELECT doc_id, s, k, item FROM x JOIN i USING (k, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM h, unnest(range(s, s + k)) t(p) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
       sha256(coalesce(m.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.without_repeats(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS g FROM d, unnest(range(1, len(w) - 18)) t(s) WHERE len(w) >= 20),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1 AS late FROM x),
r AS (SELECT DISTINCT doc_id, p FROM f, unnest(range(s, s + 20)) u(p) WHERE late),
n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1),
e AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) v(p)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM e ANTI JOIN r USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.spans(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of a string: the bits of each byte in turn, by the reversed polynomial."""
    bits = "list_reduce(list_concat([xor({0}, {1})], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 1 + 2 * i, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: {bits.format('c', 'b')}), 4294967295)"


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


# near words share what one of them leaves when a letter goes: the same letter's place in both, or the other word itself
OP12_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, n, {crc32_sql("doc_id || ':' || run")} AS h FROM r),
s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM s GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
x AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS less FROM w, unnest(range(1, length(word) + 1)) t(i)),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM x a JOIN x b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT x.word, w.word, w.n FROM x JOIN w ON x.less = w.word UNION SELECT w.word, x.word, x.n FROM x JOIN w ON x.less = w.word),
q AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY 1),
f AS (SELECT q.word, min(near) AS form, any_value(q.m) AS form_n FROM q JOIN p ON q.word = p.word AND q.m = p.m JOIN w ON q.word = w.word WHERE q.m >= 2 * w.n GROUP BY 1),
c AS (SELECT word, word AS root, 0 AS k FROM w UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON c.root = f.word)
SELECT w.word, f.form, e.root, w.n, coalesce(q.n_near, 0) AS n_near, f.form_n
FROM w JOIN (SELECT word, arg_max(root, k) AS root FROM c GROUP BY 1) e USING (word) LEFT JOIN q USING (word) LEFT JOIN f USING (word)
"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = merkle.manifest(docs, given=merkle.without_line_feeds(docs))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


def fields_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# nodes of all levels; leaves of groups at level 0, then the groups' roots as leaves of the last tree; each level's runs of three
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {fields_sql("text")} AS leaf,
  {fields_sql("CASE WHEN " + crc32_sql("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS given FROM documents),
e AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
lv AS (SELECT source, 0 AS lvl, n, pos, leaf AS h FROM e
  UNION ALL SELECT source, lvl + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY source, lvl, n, pos // 3),
sr AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, lvl AS high FROM lv WHERE n = 1),
tv AS (SELECT 0 AS lvl, n, pos, subroot AS h FROM sr
  UNION ALL SELECT lvl + 1, (n + 2) // 3, pos // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tv WHERE n > 1 GROUP BY lvl, n, pos // 3),
nodes AS (SELECT source, lvl, pos, h FROM lv WHERE n > 1 UNION ALL SELECT s.source, s.high + t.lvl, t.pos, t.h FROM tv t, (SELECT DISTINCT source, high FROM sr) s WHERE t.n > 1),
way AS (SELECT e.doc_id, e.leaf, e.source, e.pos AS start, l.i AS lvl, e.pos // power(3, l.i)::BIGINT AS at FROM e JOIN sr ON e.source IS NOT DISTINCT FROM sr.source, unnest(range(sr.high)) l(i)
  UNION ALL SELECT e.doc_id, e.leaf, e.source, e.pos, sr.high + l.i, sr.pos // power(3, l.i)::BIGINT FROM e JOIN sr ON e.source IS NOT DISTINCT FROM sr.source, unnest(range((SELECT max(lvl) FROM tv))) l(i)),
sib AS (SELECT w.source, w.start, w.lvl, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos < w.at), '') AS lft, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos > w.at), '') AS rgt
  FROM way w JOIN nodes n ON w.source IS NOT DISTINCT FROM n.source AND w.lvl = n.lvl AND w.at // 3 = n.pos // 3 GROUP BY 1, 2, 3),
prf AS (SELECT source, start, sha256(string_agg(lft || rgt, '' ORDER BY lvl)) AS proof FROM sib GROUP BY 1, 2),
fold AS (SELECT source, pos AS start, 0 AS lvl, given AS h FROM e
  UNION ALL SELECT f.source, f.start, f.lvl + 1, sha256(s.lft || f.h || s.rgt) FROM fold f JOIN sib s ON f.source IS NOT DISTINCT FROM s.source AND f.start = s.start AND f.lvl = s.lvl),
ends AS (SELECT source, start, arg_max(h, lvl) AS folded FROM fold GROUP BY 1, 2),
rt AS (SELECT h AS root FROM tv WHERE n = 1)
SELECT e.doc_id, e.leaf, sr.subroot, rt.root, coalesce(p.proof, sha256('')) AS proof_sha256, x.folded AS folded_root, x.folded = rt.root AS verified
FROM e JOIN sr ON e.source IS NOT DISTINCT FROM sr.source, rt, ends x LEFT JOIN prf p ON x.source IS NOT DISTINCT FROM p.source AND x.start = p.start
WHERE e.source IS NOT DISTINCT FROM x.source AND e.pos = x.start
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_embedding_near_dedup": op2_embedding_near_dedup,
        "op3_secret_scan": op3_secret_scan,
        "secrets_planted": secrets_planted,
        "op4_line_dedup": op4_line_dedup,
        "op5_packing": op5_packing,
        "op6_warc": op6_warc,
        "warc_copies": warc_copies,
        "op7_decontamination": op7_decontamination,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_pii": op9_pii,
        "op10_quality": op10_quality,
        "op11_bpe": op11_bpe,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_warc": OP6_SQL,
        "warc_copies": COPIES_SQL,
        "op7_decontamination": OP7_SQL,
        "op8_substring_dedup": OP8_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_manifest": OP13_SQL,
    }
