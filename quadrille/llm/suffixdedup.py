"""Exact substring dedup by a blockwise suffix sort with difference-cover ranks.

Every byte covered by an ``length``-byte string that also starts anywhere else
goes. A full suffix array of all texts would be many times the input on disk,
so suffixes are sorted block by block, and only those that can have a twin:

1. *Blocks.* The smallest hash among the 48-byte pieces of a window (leftmost
   if tied) names the block of the suffix that starts with the window. It
   depends on the window's bytes alone, so equal windows fall in one block, at
   the same distance from the piece (its anchor). Runs of windows with one
   anchor form a context, which travels as a digest.
2. *Contexts.* Contexts with one digest are equal: if there are two or more,
   all their windows have twins. Blocks with one context only have no twins.
3. *Sort.* The other blocks, with one row for each distinct context, are
   sorted, a bounded number of bytes at a time. Suffixes of a block and
   distance are refined by their first ``V`` bytes; ties that are longer are
   resolved by precomputed ranks of a difference-cover sample (positions whose
   distance to the anchor is in the cover modulo ``V``), then by the last
   bytes. Refinement is by the bytes themselves, so the result is exact.
4. A block of more than ``BLOCK_CONTEXTS`` contexts is not sorted in one task:
   its windows are grouped by their digests over the cluster instead, which
   gives the same classes.

Matches never cross documents, and are judged on the input. Texts are bytes of
UTF-8; offsets are in bytes.

Defined cases: a null text is empty; texts shorter than ``length`` keep all;
rows that repeat an id are told apart by a hash of their text, and rows equal
in both are twins; very long texts are read in blocks of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import hot_keys, lookup, short_batches, stored, table, whole_text

#: Bytes of a match, of a hashed piece, and the period of the difference cover.
LENGTH, PIECE, V = 400, 48, 40
#: Windows of a text handled at once; the low bits of a packed hash hold a place in them.
PLACE_BITS = 20
#: Contexts of a block that one task sorts, and bytes of contexts sorted at once.
BLOCK_CONTEXTS, SORT_BYTES = 3000, 1 << 21
#: Multiplier of the rolling hash (odd) and of its finishing step.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = (1 << PLACE_BITS) + 1
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=8)
def difference_cover(v: int) -> tuple[int, ...]:
    """Residues such that every difference modulo ``v`` is one of two of them (greedy)."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        gain = lambda c: len({(c - x) % v for x in cover} & open_ | {(x - c) % v for x in cover} & open_)
        best = max((c for c in range(v) if c not in cover), key=lambda c: (gain(c), -c))
        open_ -= {(best - x) % v for x in cover} | {(x - best) % v for x in cover}
        cover.append(best)
    return tuple(sorted(cover))


def contexts(data: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(block, first window, last window, anchor) of each run of windows with one anchor."""
    most = 1 << (PLACE_BITS - 1)
    for at in range(0, max(0, len(data) - length + 1), most):
        part = data[at : at + most + length - 1]
        up, down = _powers()
        n, w = len(part), length - PIECE + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[PIECE:] - sums[:-PIECE]) * down[: n - PIECE + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(32)
        packed = (h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(h), dtype=np.uint64)
        # Smallest of each w in a row: prefix and suffix minima of blocks of w.
        pad = np.full(-len(packed) % w, np.iinfo(np.uint64).max, np.uint64)
        cells = np.concatenate([packed, pad]).reshape(-1, w)
        after = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(cells, axis=1).ravel()
        m = len(packed) - w + 1
        anchor = (np.minimum(after[:m], before[w - 1 : w - 1 + m]) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], m) - 1
        block = h[anchor[first]].astype(np.int64)
        yield from zip(block.tolist(), (first + at).tolist(), (last + at).tolist(), (anchor[first] + at).tolist(), strict=True)


def _ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank in that order) by the keys, the most significant first."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def twins(texts: list[bytes], block: np.ndarray, anchor: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context, its windows (as starts) that another context of its block holds.

    ``anchor``: the anchor's place in each context. Contexts of a block must be
    distinct rows; windows match at equal distances from the anchor.
    """
    cover = difference_cover(V)
    # Each context is laid out so that its anchor's place is a multiple of V.
    starts, at = [], 0
    for t, a in zip(texts, anchor.tolist(), strict=True):
        at += -(at + a) % V
        starts.append(at)
        at += len(t)
    buffer = np.zeros(at + length + 64, np.uint8)
    for t, s in zip(texts, starts, strict=True):
        buffer[s : s + len(t)] = np.frombuffer(t, np.uint8)
    start, size = np.array(starts), np.array([len(t) for t in texts])
    # The eight bytes from each place on, as a number that sorts like them.
    word = np.zeros(len(buffer) - 8, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | buffer[k : len(buffer) - 8 + k]
    n = size - length + 1
    owner = np.repeat(np.arange(len(texts)), n)
    p = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[owner]
    distance = start[owner] + anchor[owner] - p
    # Ranks of the sample: blocks of V bytes, doubled until they cover all but the last step.
    reach = (length - V) // V * V
    sampled = np.isin(np.arange(len(word)) % V, cover)
    sampled[start.max() + size.max() if len(start) else 0 :] = False
    q = np.flatnonzero(sampled)
    order, rank = _ranks([word[np.minimum(q + 8 * k, len(word) - 1)] for k in range(V // 8)])
    name = np.full(len(word) + length + V, -1, np.int64)
    name[q[order]] = rank
    have = V
    while have < reach:
        step = min(have, reach - have)
        order, rank = _ranks([name[q], name[q + step]])
        name[q[order]] = rank
        have += step
    ahead = np.array([min((d - r) % V for d in cover) for r in range(V)])
    # Refine: block and distance, head, cover rank, tail; what stands alone is done.
    order, group = _ranks([block[owner], distance])
    p, owner = p[order], owner[order]

    def alone(group: np.ndarray) -> np.ndarray:
        edge = np.concatenate([[True], group[1:] != group[:-1], [True]])
        return edge[1:] & edge[:-1]

    tail = length - reach
    steps = [lambda x, k=k: word[x + k] for k in range(0, V, 8)]
    steps.append(lambda x: name[x + ahead[x % V]])
    steps += [lambda x, k=k: word[x + length - k] for k in range(8 * -(-tail // 8), 0, -8)]
    for key in steps:
        if not len(p):
            break
        keep = ~alone(group)
        p, owner, group = p[keep], owner[keep], group[keep]
        order, group = _ranks([group, key(p)])
        p, owner = p[order], owner[order]
    if len(p):
        keep = ~alone(group)
        p, owner = p[keep], owner[keep]
    out = np.lexsort((p, owner))
    p, owner = p[out], owner[out]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [p[cuts[i] : cuts[i + 1]] - starts[i] for i in range(len(texts))]


def _runs(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that windows with these ascending starts cover."""
    if not len(windows):
        return []
    gap = np.flatnonzero(windows[1:] > windows[:-1] + length)
    first = windows[np.concatenate([[0], gap + 1])]
    last = windows[np.concatenate([gap, [len(windows) - 1]])]
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


def _arrow(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _context_rows(length: int):
    """(block, digest, document, range) of each context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.int32()] * 3
        for batch in batches:
            rows = []
            for d, t, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for b, first, last, anchor in contexts(data, length):
                    digest = hashlib.blake2b(data[first : last + length], digest_size=16).digest()
                    c1 = int.from_bytes(digest[:8], "little", signed=True)
                    c2 = int.from_bytes(digest[8:], "little", signed=True)
                    rows.append((b, c1, c2, d, t, first, last, anchor))
            yield _arrow(rows, ["block", "c1", "c2", "doc", "tie", "first", "last", "anchor"], kinds)

    return run


def _cut_out(length: int):
    """The bytes of the contexts that are asked for, from their documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "doc", "tie", "first", "anchor", "lone", "variants", "data"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for d, t, text, asked in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for a in asked:
                    piece = data[a["first"] : a["last"] + length]
                    rows.append((a["block"], d, t, a["first"], a["anchor"] - a["first"], a["lone"], a["variants"], piece))
            yield _arrow(rows, names, kinds)

    return run


def _sort_blocks(length: int, most: int):
    """Byte ranges of lone contexts whose windows have twins; input sorted by block."""

    def solve(rows: list[dict]) -> pa.RecordBatch:
        found = twins(
            [r["data"] for r in rows],
            np.array([r["block"] for r in rows]),
            np.array([r["anchor"] for r in rows], np.int64),
            length,
        )
        out = [
            (r["doc"], r["tie"], a + r["first"], b + r["first"])
            for r, w in zip(rows, found, strict=True)
            if r["lone"]
            for a, b in _runs(w, length)
        ]
        return _arrow(out, ["doc", "tie", "start", "stop"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= most and r["block"] != held[-1]["block"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["data"])
        if held:
            yield solve(held)

    return run


def _window_digests(length: int):
    """Digest of each window of a context, with its distance from the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "doc", "tie", "start", "lone"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                for k in range(len(r["data"]) - length + 1):
                    d = hashlib.blake2b(r["data"][k : k + length], digest_size=16).digest()
                    w = (int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True))
                    rows.append((*w, r["doc"], r["tie"], r["first"] + k, r["lone"]))
                yield _arrow(rows, names, kinds)

    return run


def repeated_bytes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, block_contexts: int = BLOCK_CONTEXTS
) -> DataFrame:
    """(``doc_id``, ``text``, ``spans``): whole texts and the byte ranges to leave out."""
    short_batches(docs.sparkSession)
    whole = whole_text(text)
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.xxhash64(whole).alias("tie"), whole.alias("text"))
    key = ["doc", "tie"]
    shape = "block bigint, c1 bigint, c2 bigint, doc bigint, tie bigint, first int, last int, anchor int"
    long_enough = docs.where(F.octet_length("text") >= length)
    found = stored(long_enough.select(*key, "text").mapInArrow(_context_rows(length), shape))
    row = F.xxhash64("doc", "tie", "first")
    # Distinct contexts; one row of each stands for all (equal rows of one document stand together).
    distinct = found.groupBy("c1", "c2").agg(
        F.min("block").alias("block"), F.count("*").alias("n"), F.min(row).alias("row")
    )
    blocks = distinct.groupBy("block").agg(F.count("*").alias("variants"), F.sum("n").alias("rows"))
    blocks = blocks.where("rows > 1")
    shared = stored(distinct.join(blocks, "block").drop("rows"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    # What a context has twins for: all of it, or (alone in its digest) what its block's others share.
    marked = stored(
        lookup(found.drop("block"), shared, ["c1", "c2"], hot_keys(shared, "c1", "n", total)).select(
            "block", *key, "first", "last", "anchor", "n", "variants", (row == F.col("row")).alias("stands")
        )
    )
    full = marked.where("n > 1").select(*key, F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    asked = (
        marked.where("variants > 1 and stands")
        .withColumn("lone", F.col("n") == 1)
        .groupBy(*key)
        .agg(F.collect_set(F.struct("block", "first", "last", "anchor", "lone", "variants")).alias("asked"))
    )
    joined = _of_docs(docs, asked, "inner")
    # Written once: texts are shuffled for it, and both ways below read it.
    pieces = stored(
        joined.select(*key, "text", "asked").mapInArrow(
            _cut_out(length),
            "block bigint, doc bigint, tie bigint, first int, anchor int, lone boolean, variants bigint, data binary",
        )
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.where(F.col("variants") <= block_contexts).drop("variants").repartition(n, "block").sortWithinPartitions("block")
    part = dealt.mapInArrow(_sort_blocks(length, SORT_BYTES), "doc bigint, tie bigint, start int, stop int")
    spans = full.unionByName(part)
    if not marked.where(F.col("variants") > block_contexts).isEmpty():
        windows = pieces.where(F.col("variants") > block_contexts).drop("variants").mapInArrow(
            _window_digests(length), "w1 bigint, w2 bigint, doc bigint, tie bigint, start int, lone boolean"
        )
        windows = stored(windows)
        twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
        hot = hot_keys(twice, "w1", "n", twice.agg(F.sum("n")).first()[0] or 0)
        have = lookup(windows.where("lone"), twice.drop("n"), ["w1", "w2"], hot)
        spans = spans.unionByName(have.select(*key, "start", (F.col("start") + length).cast("int").alias("stop")))
    spans = spans.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return _of_docs(docs, spans, "left").select(F.col("doc").alias(doc_id), F.col("text").alias(text), "spans")


def _of_docs(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` with the list of each document; a null id is an id."""
    right = lists.withColumnsRenamed({"doc": "_doc", "tie": "_tie"})
    on = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie"))
    return docs.join(right, on, how).drop("_doc", "_tie")


def remove_bytes(found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``n_bytes``, ``removed``, ``kept``): maximal removed ranges and the bytes that stay."""
    short_batches(found.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, runs = t.encode("utf-8", "surrogatepass"), []
                for s in spans or ():
                    if runs and s["start"] <= runs[-1]["stop"]:
                        runs[-1]["stop"] = max(runs[-1]["stop"], s["stop"])
                    else:
                        runs.append(dict(s))
                edges = [0, *(x for r in runs for x in (r["start"], r["stop"])), len(data)]
                sizes.append(len(data))
                removed.append(runs)
                kept.append(b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())],
                names=[doc_id, "n_bytes", "removed", "kept"],
            )

    shape = T.StructType().add(doc_id, "long").add("n_bytes", "long")
    spans = T.ArrayType(T.StructType().add("start", "long").add("stop", "long"))
    return found.select(doc_id, text, "spans").mapInArrow(run, shape.add("removed", spans).add("kept", "binary"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start elsewhere too."""
    out = remove_bytes(repeated_bytes(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
