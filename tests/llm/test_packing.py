import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import packing, registry

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sdé1  \x1c")), max_size=40))
def test_same_ids_as_the_vocabulary(text):
    for t in (text, text + "<|endoftext|> " + text):
        assert packing.encode(t, "byte_bpe_50k.tiktoken").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def verify(rows, pieces, sequence=2048):
    want = {d: sorted(x) for d, x in _ids(rows).items()}
    got: dict = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length and p.offset + p.length <= sequence
        if p.start == 0:
            got.setdefault(p.id, []).append([])
        got[p.id][-1].extend(ids.tolist())
        assert len(got[p.id][-1]) == p.start + p.length
    assert {d: sorted(x) for d, x in got.items()} == want
    at = 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * sequence + p.offset == at
        at += p.length
    assert at == sum(len(x) for xs in want.values() for x in xs)


def _ids(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append([*TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids, 1])
    return out


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "word " * 9000, 0), (3, "a", 0), (3, "a", 0), (4, "x <|endoftext|> y", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    verify(rows, packing.pack(df).collect())
    verify(rows, packing.pack(df, sequence=7).collect(), 7)
    assert packing.pack(df.limit(0)).collect() == []


def test_query(spark):
    root = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{root}/documents.parquet").collect()]
    ids = {d: x[0] for d, x in _ids(rows).items()}
    got = registry.op5_packing(spark, root).collect()
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for r in got:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(ids[r.doc_id])
