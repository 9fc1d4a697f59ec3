"""SimHash near-duplicates by a binary trie self-join.

A document's fingerprint has 64 bits; two fingerprints that differ in at most
``budget`` bits are linked, and linked documents form a component.

The trie of the distinct fingerprints is joined with itself from its root:
pairs of nodes of one depth are traversed together, each step adds the bit in
which the two may differ, and a pair whose sum exceeds the budget is pruned
with all below it. A pair of leaves adds what is left of its bits at once.

How it is dealt out: the pairs of nodes at a shallow depth that are within the
budget are the units of work; a node is there with itself and with the few
nodes that differ from it in ``budget`` bits at most. The depth follows from
the number of fingerprints, and a unit of over ``UNIT`` fingerprints (a part
of the trie that is fuller than the rest) is taken ``STEP`` levels further
down, until units are small. Inside a unit the traversal runs on arrays, level
by level, in pieces of bounded size. Links leave a unit as stars (one row for
each fingerprint), never as all pairs, and are made into components by
alternating large-star and small-star steps; hot hubs are salted.

Work grows with the pairs of nodes within the budget: for n fingerprints some
n times the ways to choose ``budget`` of log2(n) bits. Larger budgets are
right too, and cost accordingly.

Defined cases: a null text is empty; a text without words has fingerprint 0
and is linked like any other; repeated rows have equal fingerprints and so the
same component; a null id is never the smallest of its component unless all
its ids are null, and then the component's id is null; ids that stand with
several texts keep a row for each; very long texts are read in blocks of words;
an empty table gives an empty result; only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import cut, hot_keys, lookup, removed, short_batches, stored_alone, table, tidy, whole_text

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, BUDGET = 3, 42, 2
#: Words hashed at once.
BLOCK = 1 << 16
#: Fingerprints of a unit of work, levels of one split, and least and most levels of the first.
UNIT, STEP, FIRST_STEP = 1 << 16, 4, (6, 12)
#: Node pairs, and rows, that a task handles at once.
PAIRS, ROWS = 1 << 17, 1 << 16


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        if len(words) < shingle:
            units = [b" ".join(words)]
        else:
            units = list(map(b" ".join, zip(*(part[k:] for k in range(shingle)))))  # noqa: B905
        h = np.fromiter(map(xxhash.xxh64_intdigest, units, repeat(seed)), np.uint64, len(units))
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``doc_id``, ``fp``): the fingerprint as a signed 64-bit integer."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[doc_id, "fp"])

    return docs.select(F.col(doc_id).cast("bigint").alias(doc_id), whole_text(text).alias(text)).mapInArrow(
        run, f"{doc_id} bigint, fp bigint"
    )


def _join(
    prints: np.ndarray, roots: np.ndarray, depth: int, budget: int, tally: dict[str, int] | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked prints.

    ``prints``: fingerprints, sorted inside each root. ``roots``: rows (a0, a1,
    b0, b1, used) of node pairs at ``depth``: their ranges and the bits in which
    the nodes differ. ``tally`` counts pairs of nodes by what became of them.
    """
    zeros: dict[int, np.ndarray] = {}

    def split(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if bit not in zeros:
            z = np.zeros(len(prints) + 1, np.int32)
            np.cumsum((prints >> np.uint64(bit)) & np.uint64(1) == 0, out=z[1:])
            zeros[bit] = z
        return lo + zeros[bit][hi] - zeros[bit][lo]

    def count(what: str, n: int) -> None:
        if tally is not None:
            tally[what] = tally.get(what, 0) + n

    stack = [(63 - depth, roots.astype(np.int32))]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > PAIRS:
            stack += [(bit, pairs[k : k + PAIRS]) for k in range(0, len(pairs), PAIRS)]
            continue
        a0, a1, b0, b1, used = pairs.T
        # Two leaves: the bits below are added at once. Prints are distinct, so bits last until then.
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            count("leaves", len(i))
            # The bits above this level are those in ``used``.
            below = np.uint64((1 << (bit + 1)) - 1)
            near = (np.bitwise_count((prints[i] ^ prints[j]) & below) + used[leaf] <= budget) & (i != j)
            yield i[near], j[near]
            a0, a1, b0, b1, used = pairs[~leaf].T
        if not len(a0):
            continue
        count("visited", len(a0))
        am, bm = split(bit, a0, a1), split(bit, b0, b1)
        own = a0 == b0
        more = used + 1
        children = [
            np.stack([a0, am, b0, bm, used], 1),
            np.stack([am, a1, bm, b1, used], 1),
            np.stack([a0, am, bm, b1, more], 1),
            np.stack([am, a1, b0, bm, more], 1)[~own],
        ]
        c = np.concatenate(children)
        c = c[(c[:, 0] < c[:, 1]) & (c[:, 2] < c[:, 3])]
        within = c[:, 4] <= budget
        count("pruned", int((~within).sum()))
        c = c[within]
        # A leaf has no pair with itself.
        c = c[(c[:, 0] != c[:, 2]) | (c[:, 1] - c[:, 0] > 1)]
        if len(c):
            stack.append((bit - 1, c))


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merges the classes of linked indexes; a label is the smallest index of its class."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


def _unit_links(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Star-shaped links of the units in a partition sorted by unit."""
    names = ["depth", "ka", "kb", "fp", "node"]

    def links(c: list[np.ndarray]) -> pa.RecordBatch:
        depth, ka, kb, fp, node = c
        new = (depth[1:] != depth[:-1]) | (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])
        unit = np.flatnonzero(np.concatenate([[True], new]))
        group = np.zeros(len(fp), np.int64)
        group[unit[1:]] = 1
        group = np.cumsum(group)
        q = fp.view(np.uint64)
        order = np.lexsort((q, group))
        q, group, node = q[order], group[order], node[order]
        lo, hi = unit, np.append(unit[1:], len(fp))
        label = np.arange(len(q))
        for d in np.unique(depth[unit]).tolist():
            at = depth[unit] == d
            a, b = lo[at], hi[at]
            # Where the second node of a unit of two begins.
            second = np.zeros(len(q), np.int64)
            np.cumsum((q >> np.uint64(64 - d)).view(np.int64) == ka[unit][group] if d else np.ones(len(q), bool), out=second)
            firsts = second[b - 1] - np.where(a > 0, second[a - 1], 0)
            cross = ka[unit][at] != kb[unit][at]
            used = np.bitwise_count((ka[unit][at] ^ kb[unit][at]).view(np.uint64)).astype(np.int64)
            middle = a + firsts
            roots = np.stack([a, np.where(cross, middle, b), np.where(cross, middle, a), b, used], 1)
            roots = roots[(roots[:, 0] < roots[:, 1]) & (roots[:, 2] < roots[:, 3]) & (b - a > 1)]
            for i, j in _join(q, roots, d, budget):
                _hook(label, i, j)
        out = np.flatnonzero(label != np.arange(len(q)))
        return pa.RecordBatch.from_arrays([pa.array(node[out]), pa.array(node[label[out]])], names=["u", "v"])

    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if len(held[0]) >= ROWS:
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1]) & (held[2] == held[2][-1])
            first = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if first:
                yield links([x[:first] for x in held])
                held = [x[first:] for x in held]
    if held is not None and len(held[0]):
        yield links(held)


def trie_links(prints: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """Links (u, v) between nodes of ``prints`` (``fp`` distinct, ``node``).

    Not all pairs, but enough that linked prints are connected.
    """
    spark = prints.sparkSession
    n = prints.count()

    def paired(rows: DataFrame, step: int) -> DataFrame:
        """The rows in the pairs of nodes ``step`` levels below, within the budget."""
        masks = [m for m in range(1 << step) if m.bit_count() <= budget]
        apart = F.col("ka").bitwiseXOR(F.col("kb"))
        near = F.filter(
            F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.bit_count(m) + F.bit_count(apart) <= budget
        )
        x = F.expr(f"shiftrightunsigned(fp, cast(64 - depth - {step} as int))")
        y = x.bitwiseXOR(F.shiftleft(apart, step)).bitwiseXOR(F.col("m"))
        return (
            rows.withColumn("m", F.explode(near))
            .withColumns({"ka": F.least(x, y), "kb": F.greatest(x, y), "depth": F.col("depth") + step})
            .drop("m")
        )

    zero = F.lit(0).cast("bigint")
    rows = prints.select(F.lit(0).alias("depth"), zero.alias("ka"), zero.alias("kb"), "fp", "node")
    # A unit has two nodes, and some nodes are fuller than others.
    first = min(FIRST_STEP[1], max(FIRST_STEP[0], max(0, -(-4 * n // unit) - 1).bit_length()))
    rows = paired(rows, first)
    key = ["ka", "kb"]
    settled = None
    for depth in range(first, 64 - STEP, STEP):
        sizes = cut(rows.groupBy(*key).count().where(F.col("count") > unit))
        if sizes.isEmpty():
            break
        # One unit has few node pairs below it, so the large ones are as many as the rows by ``unit`` at most.
        large = sizes.drop("count")
        small = rows.join(large, key, "left_anti")
        settled = small if settled is None else settled.unionByName(small)
        rows = cut(paired(rows.join(large, key), STEP))
    if settled is not None:
        rows = rows.unionByName(settled)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["depth", "ka", "kb"]
    dealt = rows.select(*key, "fp", "node").repartition(parts, *key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _unit_links(batches, budget)

    return dealt.mapInArrow(tidy(run), "u bigint, v bigint")


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``): the smallest node that each linked node reaches.

    Alternating steps: in the large-star step each node's larger neighbours are
    linked to its smallest one, in the small-star step its smaller neighbours
    are; both keep components, and stop at stars around the smallest node.
    Edges are Parquet between steps, read in as many tasks as their size asks
    for: a checkpoint would be read in one for each shuffle partition.
    """
    edges = stored_alone(
        links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first())

    def star(pairs: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        least = least.withColumn("m", F.least("m", "u"))
        return lookup(pairs, least.drop("n"), "u", hot_keys(least, "u", "n", total)), least

    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, _ = star(both, 2 * now[0])
        large = stored_alone(joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        joined, least = star(large, now[0])
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, stored_alone(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        removed(last, large)
        before, now = now, mark(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET
) -> DataFrame:
    """(``doc_id``, ``fp``, ``component_id``): the smallest id of the document's component."""
    prints = cut(fingerprints(docs, doc_id, text, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min(doc_id).alias("least"), F.count("*").alias("n")))
    total = distinct.agg(F.sum("n")).first()[0] or 0
    # A node is named by its fingerprint, as ids may be null or stand with several fingerprints.
    roots = components(trie_links(distinct.select("fp", F.col("fp").alias("node")), budget))
    rooted = cut(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    placed = lookup(rooted, named.drop("n"), "root", hot_keys(named, "root", "n", total)).select("fp", "component_id")
    return lookup(prints, placed, "fp", hot_keys(distinct, "fp", "n", total)).select(doc_id, "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
