import random

import numpy as np
import xxhash

from quadrille.llm import simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def slow_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    units = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(u.encode(), seed=42).intdigest() for u in units]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows, budget=2):
    """{(id, print)} to the smallest id reachable."""
    prints = {}
    for i, p in rows:
        prints[p] = min(prints.get(p, i), i)
    keys = list(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= budget:
                root[find(keys[a])] = find(keys[b])
    best = {}
    for k in keys:
        best[find(k)] = min(best.get(find(k), prints[k]), prints[k])
    return {(i, p): best[find(p)] for i, p in rows}


def test_fingerprint_of_odd_texts():
    for text in ("", " \n", "One", "one TWO", "a b c", "É a É b\x0bc d" * 40, "x y z ÀB", "w " * 70000):
        assert simhash.simhash(text) == slow_print(text)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(d.doc_id, slow_print(d.text or "")) for d in docs]
    want = {(i, f"{p:016x}"): c for (i, p), c in slow_components(rows).items()}
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.op1_simhash(spark, sf).collect()}
    assert got == want


def test_dense_group_is_split_and_linked(spark):
    rng = random.Random(1)
    prints = {0, 2**64 - 1}
    base = rng.getrandbits(64)
    while len(prints) < 700:
        p = base if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randrange(7)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in rows], "node bigint, fp bigint")
    for unit, budget in ((16, 2), (300, 4)):
        want = slow_components(rows, budget)
        found = simhash.components(simhash.trie_links(df, budget, unit)).collect()
        root = {r.node: r.root for r in found}
        assert {(i, p): root.get(i, i) for i, p in rows} == want


def test_the_traversal_prunes_on_documents(spark):
    """Every link of the documents comes from pairs of nodes, most of which are pruned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    prints = np.array([simhash.simhash(d.text or "") for d in docs], np.uint64)
    prints = np.unique(np.concatenate([prints, prints[:20] ^ np.uint64(1 << 40), prints[5:30] ^ np.uint64(5)]))
    n, tally = len(prints), {}
    links = set()
    for i, j in simhash._join(prints, np.array([[0, n, 0, n, 0]]), 0, 2, tally):
        links |= {(min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
    want = {(i, j) for j in range(n) for i in range(j) if int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert links == want and want
    assert tally["visited"] > 1000 and tally["pruned"] > 1000
    assert tally["leaves"] < n * (n - 1) // 20


def test_nulls_ties_empty_table_and_extra_columns(spark):
    rows = [(3, None, "", None, 0), (2, "", None, "s", 0), (2, "", None, "s", 0), (None, "a b c d", "en", "s", 7), (9, "a b c d", "en", "s", 7)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    df = df.withColumns({"fp": F.lit("x"), "node": F.lit(1), "component_id": F.lit(2)})
    got = sorted((r.doc_id or 0, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert [g[0] for g in got] == [0, 2, 2, 3, 9]
    assert [g[2] for g in got[1:4]] == [2, 2, 2] and got[0][2] == got[4][2] == 9
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_null_and_repeated_ids_in_links(spark):
    base = [f"w{k}" for k in range(200)]
    near = " ".join([*base[:199], "other"])
    rows = [(None, " ".join(base), "en", "s", 0), (None, near, "en", "s", 0), (4, "p q r s", "en", "s", 0), (4, "k l m n", "en", "s", 0), (2, "k l m n", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    want = {}
    prints = [(i, slow_print(t)) for i, t, *_ in rows]
    for p, least in {(p, min((i for i, q in prints if q == p and i is not None), default=None)) for _, p in prints}:
        linked = [i for i, q in prints if i is not None and (p ^ q).bit_count() <= 2]
        want[p] = min(linked, default=least)
    got = {int(r.fp) % 2**64: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert got == want
    assert want[slow_print("p q r s")] == 4 and want[slow_print("k l m n")] == 2
