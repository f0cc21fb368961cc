import random
from hashlib import sha256

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from faultline.llm import bpe, registry

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
END = "<|endoftext|>"
letters = st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \n\t\r'sdrve1é  \x1c\x85") + ["  ", "'ll", "'re", " a", "a ", END, "　"]))


def ids_of(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def cut(text, places):
    body = text.encode()
    at = sorted({0, len(body), *(len(text[:p].encode()) for p in places if p <= len(text))})
    return [body[a:b] for a, b in zip(at, at[1:])]


@settings(max_examples=1500, deadline=None)
@given(st.lists(letters, max_size=30).map("".join), st.lists(st.integers(0, 40), max_size=6))
def test_any_cut_is_repaired(text, places):
    parts = [bpe.encoded_chunk(c, bpe.RANKS) for c in cut(text, places)]
    ids = bpe.joined(parts, bpe.RANKS)
    assert ids.tolist() == ids_of(text)
    assert bpe.decoded(ids, bpe.RANKS).decode() == text == TOKENIZER.decode(ids.tolist(), skip_special_tokens=False)


def test_chunks_follow_the_content():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.randint(1, 8)))
    shared = " ".join(word() for _ in range(3000))
    found = [bpe.chunks((" ".join(word() for _ in range(n)) + shared + word()).encode()) for n in (1, 50, 777)]
    assert all(len(x) > 5 and b"".join(x).decode() for x in found)
    for x in found:
        [c.decode() for c in x]
    common = set(found[0]) & set(found[1]) & set(found[2])
    assert sum(map(len, common)) > 0.8 * len(shared.encode())
    assert bpe.chunks(b"") == [] and bpe.chunks(b"a") == [b"a"]


def held(rows):
    return sorted((r.id is not None, r.id, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist(), r.text) for r in rows)


def want(rows):
    return sorted((d is not None, d, len(ids_of(t or "")), ids_of(t or ""), TOKENIZER.decode(ids_of(t or ""), skip_special_tokens=False)) for d, t in rows)


def test_encoded(spark):
    rng = random.Random(9)
    passages = [" ".join(rng.choice(["the", "naïve", "don't", "we're", "1234", "...", "\n\n", "  ", END, "Grüße", "x" * 90]) for _ in range(700)) for _ in range(6)]
    rows = [(i, rng.choice(["", "a", " ", "x y "]) + "".join(rng.choice(passages)[rng.randint(0, 200) :] for _ in range(rng.randint(1, 3)))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, " "), (4, passages[0]), (4, passages[0]), (4, passages[0]), (5, passages[0]), (6, "z" * 30_000), (7, " " * 9000), (8, "漢字" * 4000), (9, END * 300)]
    df = spark.createDataFrame([(d, t, "k", b"", 1) for d, t in rows], "doc_id long, text string, key string, ids binary, bucket int")
    got = bpe.encoded(df).collect()
    assert held(got) == want(rows)
    # a filter of few bits takes everything for shared
    assert held(bpe.encoded(df, filter_bits=6, bucket_bytes=1000).collect()) == want(rows)
    assert bpe.encoded(df.limit(0)).collect() == []
    back = bpe.decode(spark.createDataFrame(got).select("text", "ids")).collect()
    assert all(r.decoded == r.text for r in back)


def test_shared_chunks_are_encoded_once(spark):
    rng = random.Random(4)
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(4000))
    rows = [(f"{rng.random()} {passage}".encode(),) for _ in range(20)]
    df = spark.createDataFrame(rows, "text binary").repartition(4)
    table = np.frombuffer(bpe.shared_filter(df, 20), "<u8")
    keys = [[bpe.key_of(c) for c in bpe.chunks(t)] for (t,) in rows]
    again = set.intersection(*map(set, keys))
    assert len(again) > 20 and all(bpe.is_set(table, list(again), 20))
    alone = [k for x in keys for k in x if sum(k in y for y in keys) == 1]
    assert alone and sum(bpe.is_set(table, alone, 20)) <= 2


def test_query(spark):
    root = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op11_bpe(spark, root).collect()
    sha = lambda b: sha256(b).hexdigest()
    assert sorted(map(tuple, got)) == sorted((d, n, sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for _, d, n, ids, t in want(rows))
