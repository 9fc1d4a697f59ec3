import os
import random
import time

import corpus_pipeline
from pyspark.sql import functions as F
from quadrille.llm import nearcopies
from quadrille.llm.common import CLEANUP, shared_folder, stored_alone

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_kept(rows):
    """Ids of the rows that stay: the smallest of each component, by all pairs."""
    sets = {i: slow_set(t or "") for i, t in rows}
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            small, large = sorted((len(x), len(y)))
            if small >= 0.8 * large and len(x & y) >= 0.8 * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return sorted(i for i in ids if find(i) == i)


def test_stage_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect())
    assert got == slow_kept(rows)


def test_edited_copies_and_chains(spark):
    rng = random.Random(3)
    rows = []
    for group in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(12):
            rows.append((len(rows), " ".join(words), "en", f"s{group}", 0))
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(5000)}"
    want = slow_kept([r[:2] for r in rows])
    assert 12 <= len(want) < len(rows)
    got = nearcopies.without_near_copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in got) == want


def test_rows_that_share_an_id_stay_if_unlike(spark):
    rows = [(i, f"text {i} of {k} words {k * k} that no other row has {k}", "en", "s", k) for k, i in enumerate([7, 7, None, None, None, 8])]
    df = spark.createDataFrame([*rows, rows[0], rows[2]], DOCS)
    got = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 2, 3, 4, 5]


def test_tables_that_nothing_reads_go(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(30)]
    rows = [(i, f"{base[i % 30]} {'x y z' if i % 3 else ''} {i // 60}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    kept = nearcopies.without_near_copies(docs).collect()
    assert sorted(r.doc_id for r in kept) == slow_kept(rows)
    left = [x for x in os.listdir(folder) if x not in before and x.startswith("table-")]
    assert len(left) <= 5


def test_a_stored_table_leaves_no_shuffle_files(spark):
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled():
        return {x for top in dirs for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    table = stored_alone(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count())
    assert sorted(table.collect()) == [(k, 715 if k < 2 else 714) for k in range(7)]
    for _ in range(10):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(CLEANUP, None) == setting
