import hashlib
import random
from collections import Counter

import numpy as np

from quadrille.llm import suffixdedup as sd


def slow(texts, length):
    """Kept bytes, removed count and runs of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_difference_cover():
    for v in (5, 32, sd.V):
        cover = sd.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda d: d.doc_id)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.op4_substring_dedup(spark, sf).collect()}
    want = slow([d.text for d in docs], 400)
    assert got == {d.doc_id: w for d, w in zip(docs, want, strict=True)}
    assert 0 < sum(w[1] for w in want)


def test_passages_periods_and_large_blocks(spark):
    rng = random.Random(5)
    word = lambda n, a="abcdefgh ": "".join(rng.choice(a) for _ in range(n))
    passage, other = word(700), word(430)
    texts = [None, "", "short", "x" * 1500, "ab" * 900, word(3000), passage, passage, "é" * 500, passage[:399], passage[:400]]
    texts += [word(rng.randrange(80)) + passage[rng.randrange(60) : 700 - rng.randrange(60)] + word(50) for _ in range(40)]
    texts += [word(30) + other + word(rng.randrange(40)) for _ in range(12)] + [word(500) + other * 3]
    rows = [(i if i % 9 else 900, t, i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, tie int").repartition(3)
    want = Counter((r[0], *w) for r, w in zip(rows, slow(texts, 400), strict=True))
    for most in (5, 3000):
        out = sd.remove_bytes(sd.repeated_bytes(df, block_contexts=most)).collect()
        got = Counter(
            (r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())
            for r in out
        )
        assert got == want
    assert sd.remove_bytes(sd.repeated_bytes(df.limit(0))).collect() == []


def test_null_and_repeated_ids(spark):
    rng = random.Random(6)
    a = "".join(rng.choice("abc ") for _ in range(600))
    df = spark.createDataFrame([(None, a), (None, a), (1, "y" * 10)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in sd.remove_bytes(sd.repeated_bytes(df)).collect())
    assert got == [(0, 600, 0), (0, 600, 0), (1, 10, 10)]
