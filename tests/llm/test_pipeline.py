import corpus_pipeline
from test_decontaminate import brute as brute_hits
from test_lines import brute as brute_lines
from test_packing import verify
from test_shingles import brute as brute_near

from faultline.llm import packing

ROOT = "/root/testdata/sf0.001"


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(at)
        out = stage(spark, at, ROOT)
        if name == "packing":
            got = packing.pack(at).collect()
            verify(before, got)
            assert out.count() == len(got)
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        after = pairs(at)
        if name == "quality":
            gone = {d for d, _ in before} - {d for d, _ in after}
            assert set(after) <= set(before) and gone
            assert sum(labels.get(d, 0) for d in gone) <= 0.1 * len(gone) + 1
        elif name == "line_dedup":
            assert after == sorted((d, kept) for d, _, _, kept in brute_lines(before))
        elif name == "simhash_near_dedup":
            component = dict(brute_near(before)[0])
            assert after == [r for r in before if component[r[0]] == r[0]]
        else:
            clean = {d for d, _, hit, _ in brute_hits(before, items) if not hit}
            assert after == [r for r in before if r[0] in clean]


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, ROOT)
        assert docs.collect() == []


def planted(spark):
    """Rows of sf0.001 with null and empty texts, null, repeated and large ids, equal rows, a very long text, and other columns."""
    rows = [tuple(r) for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60).collect()]
    words = " ".join(f"word{i % 977} and other things" for i in range(30_000))
    rows += [(None, rows[0][1], None, None, None), (None, None, "en", "s", 0), (None, None, "en", "s", 0), (10**12, "", "en", "s", 0), (10**12, None, None, "s", None), (10**12 + 1, words, "en", "s", len(words))]
    rows += [rows[1], rows[1], (rows[2][0], "another text under an old id", "en", "s", 5), (10**12 + 2, "short", "en", None, 5)]
    return spark.createDataFrame([(*r, "k", [1], None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, keep array<int>, node long")


def test_stages_on_planted_rows(spark, tmp_path):
    """Each stage keeps the columns, loses no row that it has no reason to lose, and treats equal rows alike."""
    at = planted(spark)
    at.write.parquet(f"{tmp_path}/start")
    at = spark.read.parquet(f"{tmp_path}/start")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    for name, stage in corpus_pipeline.STAGES:
        before = rows(at)
        out = stage(spark, at, ROOT)
        if name == "packing":
            verify([(-1 if d is None else d, t) for d, t in before], packing.pack(at.fillna({"doc_id": -1})).collect())
            return
        assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        after = rows(at)
        assert at.where("key <> 'k' or keep <> array(1) or node is not null").count() == 0
        if name == "quality":
            score = {}
            for r in before:
                score.setdefault(r, []).append(r in after)
            assert all(len(set(x)) == 1 for x in score.values()) and set(after) <= set(before)
        elif name == "line_dedup":
            whole = [(-1 if d is None else d, t) for d, t in before]
            assert len(after) == len(before) and sorted(len(t) for _, t in after) == sorted(len(x[3]) for x in brute_lines(whole))
        elif name == "simhash_near_dedup":
            # one of the empty ones stays, and one of equal rows
            assert len(after) == len(set(after)) and sum(not t for _, t in after) == min(1, sum(not t for _, t in before))
        else:
            assert set(after) <= set(before)
