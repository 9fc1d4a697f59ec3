import random
import hashlib

import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm.data import odd_documents
from quadrille.llm import bpe

TEXTS = [
    "", " ", "a\x1cb\x1d c", "Σας ΟΔΟΣ İx ǅ", "a<|endoftext|>b <|startoftext|><|endoftext", "日本語 １２ ①Ⅷ", "é àb  ́x",
    "\u0085 x​y᠎z", "don't WE'LL i'm 'sx's'", "_a__b_1_", "😀👍🏽 café﻿", "\x00\x01 a", "ﬁ Å ᾳ Ω", "x y　z",
    "it'S I'D", "<|x|>", "x" * 3000, "1234567890" * 5, "naïve coöperate\r\n\tend",
]


def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def test_ids_and_text_equal_the_library():
    lib, own = library(), bpe.WordBpe(bpe.tokenizer_path())
    for text in TEXTS:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_memo_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    own, lib = bpe.WordBpe(bpe.tokenizer_path()), library()
    text = " ".join(f"word{i % 13}, other{i % 7}!" for i in range(300))
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark):
    sf, lib = "/root/testdata/sf0.01", library()
    got = {r.doc_id: r for r in bpe.op2_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = lib.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_round_trip(spark):
    path, lib = bpe.tokenizer_path(), library()
    df = odd_documents(spark)
    texts = [r.text or "" for r in df.collect()]
    encoded = bpe.encode_documents(df, path)
    assert "text" not in encoded.columns and encoded.columns.count("ids") == 1
    assert sorted(r.ids for r in encoded.collect()) == sorted(lib.encode(t, add_special_tokens=False).ids for t in texts)
    back = bpe.decode_documents(encoded, path).collect()
    assert sorted(r.decoded for r in back) == sorted(lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in texts)
    assert bpe.encode_documents(df.limit(0), path).collect() == []


def test_long_words_merge_as_short_ones(monkeypatch):
    bpe_ = bpe.WordBpe(bpe.tokenizer_path())
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdeinorst", k=n)) for n in (1, 2, 3, 40, 255, 256, 257, 258, 900)] + ["a" * 700, "ab" * 300, "\u00e9x" * 200]
    short = []
    monkeypatch.setattr(bpe, "SHORT", 1 << 30)
    short = [bpe_.merge(w) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [bpe_.merge(w) for w in words] == short


def test_one_chunk_of_a_million_characters():
    bpe_ = bpe.WordBpe(bpe.tokenizer_path())
    text = "".join(random.Random(5).choices("abcdeinorst", k=1_000_000))
    ids = bpe_.encode(text)
    assert "".join(bpe_.tokens[i] for i in ids).replace("</w>", "") == text


def test_workers_keep_no_memo_after_their_tasks(spark):
    """Workers are used again; what they kept of one stage would stand beside the memory of the next."""
    path = bpe.tokenizer_path()
    docs = spark.range(64).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 200), x -> concat('w', id * 200 + x))) as text")
    assert bpe.encode_documents(docs.repartition(16), path).count() == 64

    def held(batches):
        for batch in batches:
            n = len(bpe.loaded(path).new) + len(bpe.loaded(path).old)
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], names=["n"])

    assert spark.range(64).repartition(16).mapInArrow(held, "n bigint").agg({"n": "max"}).first()[0] == 0
