"""Toxicity by a convolutional text classifier, trained here in numpy.

Words are hashed: a word's vector is the sum of the vector of its own bucket
and that of its beginning's bucket, so inflected forms share what they begin
with. Filters of several widths run over the word vectors, each filter keeps
its largest value over the whole text (max pooling), and a logistic layer
makes the score. Only the text is an input of the score.

Training reads at most ``MOST_TOXIC`` + ``MOST_CLEAN`` labelled documents,
picked by a hash of their id from rows that are not held out; that bound is a
parameter. All parameters begin at random (seeded); a bucket seen in fewer than
``LEAST_DOCS`` training documents is not kept, so an unknown word counts for
nothing. The threshold of each language, which :func:`classify` applies, is
calibrated on one training row in ``CALIBRATE`` by a first model that has not
learnt from these; then all training rows teach the model that is used. The
language is used for the thresholds only.

The model has at most a fixed number of rows by that bound, so it is broadcast.

Defined cases: a null text is empty, and an empty text gets the score of a
text of unknown words; null labels are not learnt from; of several labels of
an id the larger counts, and of several texts of an id the one with the
smallest hash; without both labels in the training rows every score is their
share of toxic rows (0 without rows); repeated rows get the same score; an
unknown or null language, or one without both labels in the calibration rows,
gets the threshold of all languages together; an empty table gives an empty
result. A column of the input that is named ``score`` (or ``toxic``, in
:func:`classify`) comes back as ``score_given``; others keep their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import give_back, short_batches, spare, table, tidy, whole_text

#: Labelled documents that training reads at most.
MOST_TOXIC, MOST_CLEAN = 1000, 2000
#: Buckets of words, of beginnings, the letters of a beginning, and of training documents that keep a bucket.
WORD_BITS, PREFIX_BITS, PREFIX, LEAST_DOCS = 22, 20, 4, 2
#: Vector size, filter widths, filters of each width.
DIM, WIDTHS, FILTERS = 16, (1, 2, 3), 8
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 64, 0.08, 1e-4, 11
#: One training row in so many calibrates the thresholds.
CALIBRATE = 5
#: Score from which the query predicts toxic, and chunks a worker remembers.
THRESHOLD, MEMO = 0.7, 400_000
#: Words pooled at once.
BLOCK = 1 << 15


def buckets(chunk: str) -> tuple[int, int]:
    """Buckets of the letters of a chunk of text and of their beginning; (-1, -1) without letters."""
    word = chunk.lower()
    if not word.isalpha():
        word = "".join(filter(str.isalpha, word))
        if not word:
            return -1, -1
    whole = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
    start = zlib.crc32(b"^" + word[:PREFIX].encode("utf-8", "surrogatepass")) & ((1 << PREFIX_BITS) - 1)
    return whole, (1 << WORD_BITS) + start


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass
class Model:
    """Bucket ids (sorted) and vectors (row 0: unknown), filters, and the logistic layer."""

    keys: np.ndarray
    vectors: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    weight: np.ndarray
    offset: float
    thresholds: dict[str | None, float] = field(default_factory=dict)
    constant: float | None = None


def _windows(x: np.ndarray, model: Model, k: int) -> np.ndarray:
    """Outputs of the filters of width ``k`` at each place of ``x``, which ends in padding."""
    n = len(x) - max(WIDTHS) + 1
    w = model.filters[k]
    return sum(x[j : j + n] @ w[j] for j in range(k)) + model.bias[k]


class Scorer:
    """Scores of texts; remembers the vector rows of chunks seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, int] = {}
        self.rows = {b: i + 1 for i, b in enumerate(model.keys.tolist())}.get
        # What each vector adds to each filter at each of its places.
        slots = [(k, j) for k in WIDTHS for j in range(k)]
        self.columns = {s: slice(i * FILTERS, (i + 1) * FILTERS) for i, s in enumerate(slots)}
        if model.constant is None:
            self.table = np.concatenate([model.vectors @ model.filters[k][j] for k, j in slots], axis=1)

    def _row(self, chunk: str) -> int:
        whole, start = buckets(chunk)
        a, b = self.rows(whole, 0), self.rows(start, 0)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[chunk] = got = (a << 32 | b) + 1
        return got

    def score(self, text: str) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        chunks, pad = text.split(), max(WIDTHS) - 1
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        get, miss = self.memo.get, self._row
        for at in range(0, max(1, len(chunks)), BLOCK):
            part = chunks[at : at + BLOCK + pad]
            ids = np.fromiter([get(c) or miss(c) for c in part], np.int64, len(part)) - 1
            # The last block is padded; the others overlap the next by as much.
            if at + BLOCK >= len(chunks):
                ids = np.concatenate([ids, np.zeros(pad + (not len(chunks)), np.int64)])
            x = self.table[ids >> 32]
            x += self.table[ids & 0xFFFFFFFF]
            n, outs = len(x) - pad, []
            for k in WIDTHS:
                out = x[:n, self.columns[k, 0]]
                for j in range(1, k):
                    out = out + x[j : j + n, self.columns[k, j]]
                outs.append(out.max(axis=0) + m.bias[k])
            best = np.maximum(best, np.concatenate(outs))
        z = float(np.maximum(best, 0) @ m.weight + m.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], toxic: list[int], langs: list[str | None]) -> Model:
    """The classifier of labelled texts; the driver keeps no more of the training than that."""
    try:
        return _taught(texts, toxic, langs)
    finally:
        give_back()


def _taught(texts: list[str], toxic: list[int], langs: list[str | None]) -> Model:
    """The network and its thresholds."""
    y = np.array(toxic, np.float32)
    none = Model(np.zeros(0, np.int64), np.zeros((1, DIM), np.float32), {}, {}, np.zeros(0), 0.0)
    if not len(y) or y.min() == y.max():
        none.constant = float(y.mean()) if len(y) else 0.0
        return none
    memo: dict[str, tuple[int, int]] = {}
    pad = max(WIDTHS) - 1
    docs = []
    for t in texts:
        ids = [memo.get(c) or memo.setdefault(c, buckets(c)) for c in t.split()] + [(-1, -1)] * pad
        docs.append(np.array(ids or [(-1, -1)], np.int32).reshape(-1, 2))
        if len(docs[-1]) <= pad:
            docs[-1] = np.concatenate([docs[-1], np.full((1, 2), -1, np.int32)])
    del memo
    aside = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % CALIBRATE == 0 for t in texts])
    if y[aside].min(initial=1) == y[aside].max(initial=0) or y[~aside].min(initial=1) == y[~aside].max(initial=0):
        # Too few rows to set some aside.
        aside = np.ones(len(y), bool)
    model = _trained(docs, y)
    judge = Scorer(model if aside.all() else _trained([d for d, a in zip(docs, aside, strict=True) if not a], y[~aside]))
    scores = np.array([judge.score(t) if a else 0.0 for t, a in zip(texts, aside, strict=True)])
    for lang in [None, *sorted({x for x in langs if x})]:
        of = aside & np.array([lang is None or x == lang for x in langs])
        model.thresholds[lang] = _calibrated(scores[of], y[of], model.thresholds.get(None, THRESHOLD))
    return model


def _trained(docs: list[np.ndarray], y: np.ndarray) -> Model:
    """The network of documents given as pairs of buckets."""
    keys, n = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
    keys = keys[(n >= LEAST_DOCS) & (keys >= 0)]
    rng = np.random.default_rng(SEED)
    vectors = np.zeros((len(keys) + 1, DIM), np.float32)
    vectors[1:] = rng.normal(0, 0.1, (len(keys), DIM))
    model = Model(keys, vectors, {}, {}, rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)
    for k in WIDTHS:
        model.filters[k] = rng.normal(0, 0.3, (k, DIM, FILTERS)).astype(np.float32)
        model.bias[k] = np.zeros(FILTERS, np.float32)
    rows = []
    for d in docs:
        i = np.searchsorted(keys, d)
        row = np.where((i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] == d), i + 1, 0) if len(keys) else np.zeros_like(d)
        rows.append(row.astype(np.int32))
    _fit(model, rows, y, rng)
    return model


def _fit(model: Model, rows: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad on the logistic loss; classes weigh the same. Only pooled places carry a gradient."""
    weights = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    params = {"vectors": model.vectors, "weight": model.weight}
    params |= {("f", k): model.filters[k] for k in WIDTHS} | {("b", k): model.bias[k] for k in WIDTHS}
    squares = {name: np.full_like(p, 1e-3) for name, p in params.items()}
    square_offset = 1e-3
    which = np.arange(FILTERS)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            grads = {name: np.zeros_like(p) for name, p in params.items() if name != "vectors"}
            touched, moved, grad_offset = [], [], 0.0
            batch = order[start : start + BATCH]
            for d in batch:
                r = rows[d]
                x = model.vectors[r[:, 0]] + model.vectors[r[:, 1]]
                outs = [_windows(x, model, k) for k in WIDTHS]
                places = [o.argmax(axis=0) for o in outs]
                pooled = np.concatenate([o[p, which] for o, p in zip(outs, places, strict=True)])
                z = np.maximum(pooled, 0)
                score = 1 / (1 + np.exp(-np.clip(z @ model.weight + model.offset, -30, 30)))
                g = (score - y[d]) * weights[d] / len(batch)
                grads["weight"] += g * z
                grad_offset += g
                back = g * model.weight * (pooled > 0)
                for i, k in enumerate(WIDTHS):
                    own = back[i * FILTERS : (i + 1) * FILTERS]
                    if not own.any():
                        continue
                    grads["b", k] += own
                    for j in range(k):
                        at = places[i] + j
                        grads["f", k][j] += (x[at] * own[:, None]).T
                        step = (model.filters[k][j] * own).T
                        touched += [r[at, 0], r[at, 1]]
                        moved += [step, step]
            for name, grad in grads.items():
                grad += DECAY * params[name]
                squares[name] += grad**2
                params[name] -= RATE * grad / np.sqrt(squares[name])
            square_offset += grad_offset**2
            model.offset -= RATE * grad_offset / np.sqrt(square_offset)
            if touched:
                ids, at = np.unique(np.concatenate(touched), return_inverse=True)
                grad = np.zeros((len(ids), DIM), np.float32)
                np.add.at(grad, at, np.concatenate(moved))
                grad[ids == 0] = 0
                grad += DECAY * model.vectors[ids]
                squares["vectors"][ids] += grad**2
                model.vectors[ids] -= RATE * grad / np.sqrt(squares["vectors"][ids])
    model.vectors[0] = 0


def _calibrated(scores: np.ndarray, y: np.ndarray, usual: float) -> float:
    """The threshold with most right answers, in the middle of the widest such gap; ``usual`` without both classes."""
    if not len(y) or y.min() == y.max():
        return usual
    order = np.argsort(scores)
    s, t = scores[order], y[order]
    # Right answers if the first i are called clean; a cut lies between unequal scores.
    right = np.concatenate([[0], np.cumsum(1 - t)]) + t.sum() - np.concatenate([[0], np.cumsum(t)])
    low, high = np.concatenate([[0], s]), np.concatenate([s, [1]])
    gap = high - low
    right = np.where(gap > 0, right, -1)
    best = right == right.max()
    i = int(np.flatnonzero(best)[np.argmax(gap[best])])
    return float((low[i] + high[i]) / 2)


def fit(
    docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN
) -> Model:
    """The classifier of the labelled rows of ``docs`` that are not held out."""
    one = (
        labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    first = F.xxhash64(F.lit(SEED), F.col("doc_id"))
    picked = [
        one.where(F.col("toxic") == k).orderBy(first, "doc_id").limit(most) for k, most in ((1, most_toxic), (0, most_clean))
    ]
    # At most most_toxic + most_clean ids: a bounded broadcast.
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    text = F.struct(F.xxhash64(whole_text()).alias("tie"), whole_text().alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = (
        docs.select("doc_id", text.alias("t"))
        .join(ids, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("t").alias("t"))
        .select("doc_id", "toxic", "t.text", "t.lang")
        .orderBy("doc_id")
        .limit(most_toxic + most_clean)
        .collect()
    )
    return train([r.text for r in rows], [r.toxic for r in rows], [r.lang for r in rows])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` from 0 to 1, made of the text alone."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = spare(docs, "score")
    at = docs.columns.index(text)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = pa.array([scorer.score(t or "") for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``score`` and ``toxic``: the score is at or over its language's threshold."""
    docs = spare(docs, "toxic")
    least = F.lit(model.thresholds.get(None, THRESHOLD))
    for name, value in model.thresholds.items():
        if name is not None:
            least = F.when(F.col(lang) == name, F.lit(value)).otherwise(least)
    return score(docs, model, text).withColumn("toxic", F.col("score") >= least)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
