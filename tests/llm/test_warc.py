import hashlib
import zlib
from base64 import b32encode

import duckdb
import pytest

from faultline.llm import registry, warc
from faultline.llm.common import Workspace


def brute(rows, least=0):
    first: dict = {}
    data = [(i, (h or "").encode()) for i, h in rows]
    for i, b in data:
        if i is not None and len(b) >= least:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, b in data:
        f = first.get(b)
        again = i is not None and f is not None and f < i
        out.append((i, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def test_edges(spark):
    big = "é\r\n\r\nWARC/1.1\r\n" * 40000
    rows = [(5, None), (3, ""), (9, "a"), (4, "a"), (4, "a"), (None, "a"), (7, big), (8, big), (2, "a\n")]
    df = spark.createDataFrame([(i, f"http://x/{i}\n y", h, "z") for i, h in rows], "page_id long, url string, html string, digest string")
    for least in (0, 1, 2):
        got = sorted(((r.id, r.bytes, r.digest, r.type, r.refers_to) for r in warc.round_trip(df, least_bytes=least).collect()), key=str)
        assert got == brute(rows, least)
    assert warc.round_trip(df.limit(0)).collect() == []


def test_archives_hold_the_payloads_once(spark):
    df = spark.createDataFrame([(1, "u", "x" * 9), (2, "u", "x" * 9), (3, None, "y")], "page_id long, url string, html string")
    work = Workspace(spark, "warc-test")
    warc.write(df, f"{work.root}/a")
    got = {r.id: (r.type, r.payload and bytes(r.payload)) for r in warc.read(spark, f"{work.root}/a").collect()}
    assert got == {1: ("response", b"x" * 9), 2: ("revisit", None), 3: ("response", b"y")}


def test_query(spark):
    root = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{root}/pages.parquet").collect()]
    got = [tuple(r) for r in registry.op6_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == brute(rows)


def test_large_pages_cross_pieces_and_batches(spark, monkeypatch):
    """Pages of all sizes, in files and batches of many records; reading holds a piece and a record."""
    monkeypatch.setattr(warc, "FILE_BYTES", 2_000)
    rows = [(i, chr(97 + i % 23) * (i * 137 % 90_000) + str(i % 150)) for i in range(300)] + [(900, "z" * 3_000_000), (901, "z" * 3_000_000)]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = sorted(((r.id, r.bytes, r.digest, r.type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    assert got == brute(rows)
    work = Workspace(spark, "warc-test")
    warc.write(df, f"{work.root}/b")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{work.root}/b").select("content").collect()
    assert len(files) > 10
    # each record is a gzip member of its own
    members = 0
    for r in files:
        data = bytes(r.content)
        while data:
            one = zlib.decompressobj(31)
            record = one.decompress(data)
            assert record.startswith(b"WARC/1.1\r\n") and len(list(warc.parsed(iter([record])))) == 1
            data, members = one.unused_data, members + 1
    assert members == len(rows)


@pytest.mark.parametrize("most", [1, 60, 1_000_000])
def test_groups_of_files(spark, monkeypatch, most):
    """Pages read from files, in groups by their revisits: each page is written once, and no payload is exchanged."""
    monkeypatch.setattr(warc, "GROUP_REVISITS", most)
    rows = [(i, f"page {i % 70}" * (i % 5)) for i in range(400)] + [(None, "page 1"), (3, "page 1"), (3, "page 1")]
    work = Workspace(spark, "warc-test")
    spark.createDataFrame([(i, "u", h, "f") for i, h in rows], "page_id long, url string, html string, file string").repartition(9).write.parquet(f"{work.root}/pages")
    pages = spark.read.parquet(f"{work.root}/pages")
    got = sorted(((r.id, r.bytes, r.digest, r.type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == brute(rows)


def test_copies_query(spark):
    root = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{root}/pages.parquet").collect()]
    rows += [(i + s, h) for i, h in rows if i % 3 == 0 for s in (-(10**9), 10**9)]
    got = registry.warc_copies(spark, root)
    mine = sorted((tuple(r) for r in got.collect()), key=str)
    assert [x[:3] + x[3:] for x in mine] == brute(rows) and sum(r[3] == "revisit" for r in mine) > 30
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{root}/pages.parquet'")
    sql = db.execute(registry.COPIES_SQL)
    assert [c[0] for c in sql.description] == got.columns and sorted(sql.fetchall(), key=str) == mine


def test_stream_of_members():
    import gzip

    import pyarrow as pa

    text = b"".join(b"WARC/1.1\r\nWARC-Record-ID: x\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"q" * n) for n in (0, 5, 3_000_000, 70_000))
    whole, split = gzip.compress(text), b"".join(gzip.compress(text[i : i + 400_001]) for i in range(0, len(text), 400_001))
    for data in (whole, split, b""):
        got = [len(r["block"]) for r in warc.parsed(warc.unzipped(pa.py_buffer(data)))]
        assert got == ([0, 5, 3_000_000, 70_000] if data else [])
