import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import toxicity as tx
from tests.llm.data import odd_documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in tx.op10_toxicity(spark, sf).collect()}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in out.items())
    rows = [(labels[i], r) for i, r in out.items() if i in labels and r.held_out]
    caught = np.mean([r.predicted for y, r in rows if y])
    wrong = np.mean([r.predicted for y, r in rows if not y])
    # About 6 % of the rows labelled toxic here hold none of the words that mark the others.
    assert caught > 0.9 and wrong < 0.02


def _corpus(n=240):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)]
    texts, y = [], []
    for k in range(n):
        t = list(rng.choice(words, 30))
        y.append(int(k % 4 == 0))
        if y[-1]:
            t[int(rng.integers(30))] = ["Rotter!", "rotterly", "rotters"][k % 3]
        texts.append(" ".join(t))
    return texts, y


def test_scores_depend_on_the_text_alone_and_blocks_do_not_matter(monkeypatch):
    texts, y = _corpus()
    model = tx.train(texts, y, ["en"] * len(y))
    scorer = tx.Scorer(model)
    scores = np.array([scorer.score(t) for t in texts])
    assert ((scores >= model.thresholds["en"]) == np.array(y, bool)).mean() > 0.97
    long = " ".join(texts) + " " + "zz " * 5000
    whole = [scorer.score(t) for t in (*texts, long, "", "one")]
    monkeypatch.setattr(tx, "BLOCK", 7)
    monkeypatch.setattr(tx, "MEMO", 5)
    assert np.allclose([tx.Scorer(model).score(t) for t in (*texts, long, "", "one")], whole, atol=1e-5)


def slow_score(model, text):
    """The network word by word: sums of vectors, every filter at every place, the largest of each, a logistic layer."""
    vectors = {int(k): v for k, v in zip(model.keys, model.vectors[1:], strict=True)}
    zero = np.zeros(tx.DIM)
    words = [sum((vectors.get(b, zero) for b in tx.buckets(c)), zero) for c in text.split()]
    places = max(1, len(words))
    words += [zero] * max(tx.WIDTHS)
    pooled = []
    for k in tx.WIDTHS:
        for f in range(tx.FILTERS):
            outs = [sum(float(np.dot(words[i + j], model.filters[k][j][:, f])) for j in range(k)) + model.bias[k][f] for i in range(places)]
            pooled.append(max(0.0, max(outs)))
    return 1 / (1 + np.exp(-(np.dot(pooled, model.weight) + model.offset)))


def test_scores_against_a_plain_network():
    texts, y = _corpus()
    model = tx.train(texts, y, ["en"] * len(y))
    scorer = tx.Scorer(model)
    for t in [*texts[:25], "", "one", "Rotter! rotterly " * 3, "w1 ... w2 - 12 w3"]:
        assert abs(scorer.score(t) - slow_score(model, t)) < 1e-5

def test_training_matters(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    texts, y = [], []
    for k in range(900):
        t = list(rng.choice(words[12:], 30))
        y.append(int(k % 4 == 0))
        if y[-1]:
            t[int(rng.integers(30))] = words[int(rng.integers(12))]
        texts.append(" ".join(t))

    def right(m):
        score = tx.Scorer(m).score
        return ((np.array([score(t) for t in texts[600:]]) >= m.thresholds["en"]) == np.array(y[600:], bool)).mean()

    trained = right(tx.train(texts[:600], y[:600], ["en"] * 600))
    monkeypatch.setattr(tx, "EPOCHS", 0)
    assert trained > 0.9 and trained - right(tx.train(texts[:600], y[:600], ["en"] * 600)) > 0.1


def test_the_text_of_an_id_is_defined(spark):
    rows = [(1, f"text {k}", "en") for k in range(20)] + [(2, "b", "en")]
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id bigint, toxic int")
    seen = []
    real, tx.train = tx.train, lambda *a: seen.append(a) or real(*a)
    try:
        for order in (rows, rows[::-1]):
            tx.fit(spark.createDataFrame(order, "doc_id bigint, text string, lang string").repartition(5), labels)
    finally:
        tx.train = real
    assert seen[0] == seen[1] and seen[0][1].count(1) <= 1


def test_no_labels_or_one_kind():
    assert tx.Scorer(tx.train([], [], [])).score("x") == 0
    assert tx.Scorer(tx.train(["a", "b"], [1, 1], [None, None])).score("x") == 1
    assert tx.Scorer(tx.train(["", " "], [1, 0], [None, "en"])).score("x y") >= 0


def test_odd_rows(spark):
    df = odd_documents(spark)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 1), (None, 1), (5, 0), (3, 0)], "doc_id bigint, toxic int")
    for some in (labels, labels.limit(0)):
        model = tx.fit(df, some)
        out = tx.classify(df, model).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 2}) == 1
        assert all(r.score_given == "x" and r.toxic_given == "x" for r in out)
    assert tx.classify(df.limit(0), model).collect() == []
    assert tx.fit(df.limit(0), labels).constant == 0


def test_training_rows_are_bounded_and_not_held_out(spark):
    texts, y = _corpus()
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id bigint, toxic int")
    seen = []
    real, tx.train = tx.train, lambda t, *rest: seen.extend(t) or real(t, *rest)
    try:
        tx.fit(docs, labels, most_toxic=10, most_clean=20)
    finally:
        tx.train = real
    out = {r.doc_id for r in docs.where(tx.held_out(F.col("doc_id"))).collect()}
    assert len(seen) == 30 and not {texts[k] for k in out} & set(seen)


GROWN = """
import random
from quadrille.llm import toxicity

def mb():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6

toxicity.train(["a b", "c d"] * 20, [0, 1] * 20, ["en"] * 40)
rng = random.Random(3)
texts = [" ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(500)) + f" t{k % 2}" for k in range(600)]
before = mb()
model = toxicity.train(texts, [k % 2 for k in range(600)], ["en"] * 600)
print(mb() - before - model.vectors.nbytes / 1e6)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_training_gives_its_memory_back():
    out = subprocess.run([sys.executable, "-c", GROWN], capture_output=True, text=True, check=True, timeout=300)
    assert float(out.stdout) < 25
