import math
import random
import re
import zlib
from collections import Counter

import pytest

from quadrille.llm import bm25
from tests.llm.data import odd_documents


def slow(docs, queries, k):
    words = [(i, re.findall(r"[^\W_]+", (t or "").lower())) for i, t in docs]
    df = Counter(t for _, w in words for t in set(w))
    n, mean = len(words), sum(len(w) for _, w in words) / max(1, len(words))
    out = {}
    for q, text in queries:
        asked = set(re.findall(r"[^\W_]+", (text or "").lower()))
        scored = []
        for i, w in words:
            tf = Counter(w)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in asked if tf[t])
            if s:
                scored.append((round(s, 6), i))
        out[q] = sorted(scored, key=lambda x: (-x[0], x[1]))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((round(r.score, 6), r.doc_id))
    return out


@pytest.mark.parametrize("shard_chars", [60_000, 64_000_000])
def test_against_brute_force(spark, sf, shard_chars):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    queries = df.where("doc_id % 9 = 0").withColumnRenamed("doc_id", "query_id")
    got = found(bm25.top_k(df, queries, 7, shard_chars))
    assert got == {q: v for q, v in slow(docs, [d for d in docs if d[0] % 9 == 0], 7).items() if v}


def test_short_queries_are_pruned_and_exact(spark):
    docs = [(i, " ".join(f"t{(i * j) % 97}" for j in range(1, 1 + i % 30))) for i in range(600)]
    queries = [(1, "t5 t7"), (2, "t1"), (3, "nothing like it"), (4, ""), (5, "t2 t2 t2 t90")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(queries, "query_id bigint, text string")
    assert found(bm25.top_k(df, q, 5)) == {k: v for k, v in slow(docs, queries, 5).items() if v}


def test_pruned_search_reads_fewer_postings():
    import numpy as np

    rng = random.Random(5)
    words = [f"w{k}" for k in range(4000)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(4000)], k=rng.choice([40, 150])))) for i in range(1500)]
    vocabulary = Counter(t for _, text in docs for t in set(text.split()))
    named = sorted(vocabulary, key=lambda t: (-vocabulary[t], bm25._hash(t)))
    shard = bm25.Shard(sum(len(t.split()) for _, t in docs) / len(docs), len(docs))
    shard.page(0, np.array([bm25._hash(t) for t in named], "<i8").tobytes(), zlib.compress(np.array([vocabulary[t] for t in named], "<i8").tobytes()))
    for i, text in docs:
        shard.add(i, text)
    shard.close()
    code = {t: i for i, t in enumerate(named)}
    want = slow(docs, docs[:40], 10)
    for i, text in docs[:40]:
        query = np.array(sorted(code[t] for t in set(text.split())))
        got = shard.search(query, 10)
        assert [(round(s, 6), d) for s, d in got] == want[i]
        assert shard.search(query, 10, got[-1][0]) == got and shard.search(query, 10, got[2][0]) == [x for x in got if x[0] >= got[2][0]]
    assert 0 < shard.read < 0.7 * shard.all


def test_queries_searched_together(monkeypatch):
    import numpy as np

    monkeypatch.setattr(bm25, "GROUP", 64)
    monkeypatch.setattr(bm25, "TILE", 16)
    monkeypatch.setattr(bm25, "FULL", 20)
    rng = random.Random(7)
    weights = [1 / (k + 1) for k in range(900)]
    docs = [(i, " ".join(f"{'abc'[i % 3]}{w}" for w in rng.choices(range(900), weights, k=rng.choice([1, 30, 200])))) for i in range(700)]
    docs += [(700 + i, docs[i][1]) for i in range(40)] + [docs[5]] * 3 + [(2000, ""), (None, docs[9][1])]
    vocabulary = Counter(t for _, text in docs for t in set(text.split()))
    named = sorted(vocabulary, key=lambda t: (-vocabulary[t], bm25._hash(t)))
    shard = bm25.Shard(sum(len(t.split()) for _, t in docs) / len(docs), len(docs))
    shard.page(0, np.array([bm25._hash(t) for t in named], "<i8").tobytes(), zlib.compress(np.array([vocabulary[t] for t in named], "<i8").tobytes()))
    for i, text in docs:
        shard.add(i, text)
    shard.close()
    code = {t: i for i, t in enumerate(named)}
    queries = [np.array(sorted(code[t] for t in set(text.split())), np.int64) for _, text in docs[:90]] + [np.zeros(0, np.int64)]
    want = slow([(-1 if i is None else i, t) for i, t in docs], [(i, t) for i, (_, t) in enumerate(docs[:90])], 10)
    got = shard.search_many(queries, 10, [0.0] * len(queries))
    assert [[(round(s, 6), -1 if d is None else d) for s, d in g] for g in got] == [want[i] for i in range(90)] + [[]]
    assert got[:90] == [shard.search(q, 10) for q in queries[:90]]
    least = [g[min(2, len(g) - 1)][0] for g in got[:90]]
    assert shard.search_many(queries[:90], 10, least) == [[x for x in g if x[0] >= t] for g, t in zip(got, least)]


def test_a_shard_holds_its_postings_in_little_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    weights = 1 / (np.arange(20_000) + 20)
    docs = [" ".join(f"w{w}" for w in rng.choice(20_000, 150, p=weights / weights.sum())) for _ in range(6000)]
    vocabulary = Counter(t for text in docs for t in set(text.split()))
    named = sorted(vocabulary, key=lambda t: (-vocabulary[t], bm25._hash(t)))
    page = np.array([bm25._hash(t) for t in named], "<i8").tobytes(), zlib.compress(np.array([vocabulary[t] for t in named], "<i8").tobytes())
    tracemalloc.start()
    try:
        shard = bm25.Shard(150, len(docs))
        shard.page(0, *page)
        for i, text in enumerate(docs):
            shard.add(i, text)
        added = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        shard.close()
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    postings = sum(vocabulary.values())
    held -= sum(whole.nbytes for whole, _, _ in shard.whole)
    assert held < 24 * postings and peak - added < 45 * postings


def test_queries_searched_together_take_little_memory():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in rng.choice(3000, 400)) for _ in range(1500)]
    vocabulary = Counter(t for text in texts for t in set(text.split()))
    named = sorted(vocabulary, key=lambda t: (-vocabulary[t], bm25._hash(t)))
    code = {t: i for i, t in enumerate(named)}
    shard = bm25.Shard(400, 20 * len(texts))
    shard.page(0, np.array([bm25._hash(t) for t in named], "<i8").tobytes(), zlib.compress(np.array([vocabulary[t] for t in named], "<i8").tobytes()))
    for i, text in enumerate(texts):
        shard.add(i, text)
    shard.close()
    queries = [np.array(sorted(code[t] for t in set(text.split())), np.int64) for text in texts[:200]]
    # No term is held whole, so all postings of all queries are added one by one.
    shard.whole = [(w[:0], tiles, most[:0]) for w, tiles, most in shard.whole]
    shard.column[:] = -1
    want = shard.search_many(queries[:5], 10, [0.0] * 5)
    shard.read = 0
    tracemalloc.start()
    try:
        got = shard.search_many(queries, 10, [0.0] * 200)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[:5] == want == [shard.search(q, 10) for q in queries[:5]]
    assert peak < 3 * shard.read


def test_terms_of_queries_searched_together_are_looked_up_once():
    import numpy as np

    class Counted(np.ndarray):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += np.size(key)
            return np.asarray(self)[key]

    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=60))) for i in range(300)]
    vocabulary = Counter(t for _, text in docs for t in set(text.split()))
    named = sorted(vocabulary, key=lambda t: (-vocabulary[t], bm25._hash(t)))
    shard = bm25.Shard(60, len(docs))
    shard.page(0, np.array([bm25._hash(t) for t in named], "<i8").tobytes(), zlib.compress(np.array([vocabulary[t] for t in named], "<i8").tobytes()))
    for i, text in docs:
        shard.add(i, text)
    shard.close()
    number = {t: c for c, t in enumerate(named)}
    query = np.array(sorted(number[t] for t in set(docs[0][1].split())), np.int64)
    shard.cut = shard.cut.view(Counted)
    got = shard.search_many([query] * 200, 5, [0.0] * 200)
    assert 0 < Counted.asked <= 20 * len(query) * len(shard.whole)
    assert got == [shard.search(query, 5)] * 200


def test_texts_are_parted_into_terms_once(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(bm25, "GATHERED", 50)
    monkeypatch.setattr(bm25, "COUNTED", 20)
    rng = random.Random(9)
    docs = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 40])))) for i in range(60)]
    docs += [(60, "often " * 300 + "Once w1"), (None, "w1 \u00e9t\u00e9 \u65e5\u672c"), (61, "")]
    ids, texts = zip(*docs)
    batches = [pa.record_batch([pa.array(ids[a : a + 9], pa.int64()), pa.array(texts[a : a + 9])], names=["id", "text"]) for a in range(0, 63, 9)]
    parted = list(bm25._counted(iter(batches)))
    # From here on there are no texts any more.
    monkeypatch.setattr(bm25, "terms", None)
    df, sizes = Counter(), []
    for b in bm25._count_terms(b.select(["words", "chars", "hashes"]) for b in parted):
        for term, n, words, chars in zip(*(c.to_pylist() for c in b.columns)):
            if term is None:
                sizes.append((n, words, chars))
            else:
                df[term] += n
    found = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert df == Counter(bm25._hash(t) for w in found for t in set(w))
    assert sizes == [(63, sum(map(len, found)), sum(map(len, texts)))]
    named = sorted(df, key=lambda t: (-df[t], t))
    page = np.array(named, "<i8").tobytes(), zlib.compress(np.array([df[t] for t in named], "<i8").tobytes())
    shard = bm25.Shard(sizes[0][1] / 63, 63)
    shard.page(0, *page)
    for b in parted:
        for i, words, _, hashes, tf in zip(*(c.to_pylist() for c in b.columns)):
            shard.put(i, words, hashes, tf)
    shard.close()
    queries = [(i, t) for i, t in enumerate(texts)]
    want = slow([(-1 if i is None else i, t) for i, t in docs], queries, 5)
    for q, w in enumerate(found):
        got = shard.search(np.array(sorted(named.index(bm25._hash(t)) for t in set(w)), np.int64), 5)
        assert [(round(s, 6), -1 if d is None else d) for s, d in got] == want[q]


def test_rows_that_repeat(spark):
    rows = [(1, "a b c")] * 5 + [(None, "a b")] * 2 + [(-1, "a b"), (2, "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a b c")], "query_id bigint, text string")
    assert [d for _, d in found(bm25.top_k(df, q, 8))[1]] == [1] * 5 + [None, None, -1]
    assert [d for _, d in found(bm25.top_k(df, q, 3, 2))[1]] == [1] * 3


def test_odd_rows(spark):
    df = odd_documents(spark)
    queries = df.where("doc_id in (1, 3, 5, 7)").selectExpr("doc_id as query_id", "text")
    got = found(bm25.top_k(df, queries, 3))
    assert set(got) == {3, 5} and [d for _, d in got[3]] == [3, 4] and got[5][0][1] == 5
    assert bm25.top_k(df.limit(0), queries).collect() == []
    assert bm25.top_k(df, queries.limit(0)).collect() == []
