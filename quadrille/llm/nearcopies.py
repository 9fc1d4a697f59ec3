"""Near copies: documents whose sets of word shingles have a Jaccard likeness of ``LIKENESS`` or more.

Linked documents form a component, and the first of each stays.

Candidates come from two sides. The trie self-join of
:mod:`quadrille.llm.simhash` gives those whose fingerprints over the same
shingles differ in a few bits. It does not reach down to a likeness of 0.8,
where two fingerprints differ in some ten bits of 64, too many for a trie to
prune; the others come from MinHash bands: ``BANDS`` bands of ``ROWS`` minima
each, of which two sets of likeness 0.8 share none with a probability of
``(1 - 0.8 ** 4) ** 32``, 5e-8. Every candidate is then held against the whole
sets, so no link rests on a sketch.

Documents with equal sets are one node. A band's nodes are first compared with
its smallest node, then, where the links found leave several components in the
band, with its most central node (fewest shingles of its own). Of the pairs of
a band that are still in different components, those are compared that could
be alike at all: shingles that no other open node has are in no intersection,
and the others, counted in ``CELLS`` cells by their hash, meet in the smaller
count of each cell at most. Both are upper bounds of the intersection, so none
that could join two components is left out.

Intermediate tables are Parquet: a checkpoint would hand on the constraints of
its plan, and planning the components would take longer each step. They are
deleted when nothing will read them, but for the few that the result is made from.

Defined cases: words are parted by ASCII white space, ASCII letters in lower
case; a text of fewer words than a shingle has one, the whole of it; a null
text is empty, and texts without words are alike. Rows are told apart by a
hash of all their columns, so ids may be null or repeated; of rows equal in
all columns one stays. An empty table gives an empty result; all columns come
back as they were, whatever their names (a column named ``_row`` is refused).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import hot_keys, lookup, removed, short_batches, stored_alone, tidy, whole_text
from quadrille.llm.simhash import components, simhash, trie_links

#: Words of a shingle, and the least likeness of linked documents.
SHINGLE, LIKENESS = 5, 0.8
#: Bands of a document, and minima of a band.
BANDS, ROWS = 32, 4
#: Shingles whose minima are taken at once, and cells of the counts that bound an intersection.
BLOCK, CELLS = 1 << 12, 64
#: Bits in which the fingerprints of the first candidates may differ.
BUDGET = 2
#: Nodes of a band that one slice of its comparisons holds.
SLICE = 256

_RNG = np.random.default_rng(42)
_TURN = _RNG.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1)
    out = np.full(n, min(len(h), shingle), np.uint64)
    for k in range(min(len(h), shingle)):
        out = out * _STEP + h[k : k + n]
    out ^= out >> np.uint64(32)
    return np.unique(out * _STEP)


def bands(found: np.ndarray) -> np.ndarray:
    """The hashes of the bands of a set of shingles."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), BLOCK):
        turned = (found[at : at + BLOCK, None] ^ (found[at : at + BLOCK, None] >> np.uint64(29))) * _TURN
        least = np.minimum(least, (turned >> np.uint64(32)).astype(np.uint32).min(axis=0))
    cells = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(c.tobytes(), k) for k, c in enumerate(cells)], np.uint64).view(np.int64)


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, node, n, bands, fp) of (row, text): name and size of the set, its bands, and the SimHash."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sets = [shingles(t, shingle) for t in texts]
            prints = np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64)
            names = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([bands(s) for s in sets], pa.list_(pa.int64())), pa.array(prints)],
                names=["row", "node", "n", "bands", "fp"],
            )

    return docs.mapInArrow(tidy(run), "row bigint, node bigint, n bigint, bands array<bigint>, fp bigint")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of (node, text)."""
    short_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"]
            )

    return texts.mapInArrow(tidy(run), "node bigint, set array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, likeness: float) -> DataFrame:
    """The pairs (u, v) whose whole sets are alike, as a table."""
    made = []

    def joined(rows: DataFrame, key: str) -> DataFrame:
        counts = stored_alone(rows.groupBy(key).agg(F.count("*").alias("n")))
        made.append(counts)
        total = counts.agg(F.sum("n")).first()[0] or 0
        side = sets.select(F.col("node").alias(key), F.col("set").alias(f"set_{key}"))
        return lookup(rows, side, key, hot_keys(counts, key, "n", total))

    both = F.size(F.array_intersect("set_u", "set_v"))
    whole = F.size("set_u") + F.size("set_v") - both
    found = stored_alone(joined(joined(pairs, "u"), "v").where(both >= whole * F.lit(likeness)).select("u", "v"))
    removed(*made)
    return found


def _bounds(sets: DataFrame, open_nodes: DataFrame) -> DataFrame:
    """(node, common, cells) of the open nodes: what of each set another open node has too.

    ``common`` is the number of those shingles, ``cells`` their counts by hash.
    """
    short_batches(sets.sparkSession)
    near = sets.join(open_nodes, "node", "left_semi")
    own = near.select("node", F.explode("set").alias("t")).groupBy("t").agg(F.count("*").alias("k"), F.min("node").alias("node"))
    own = own.where("k = 1").groupBy("node").agg(F.collect_list("t").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for found, alone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                common = np.setdiff1d(np.array(found, np.int64), np.array(alone or [], np.int64))
                cells.append(np.bincount(common & (CELLS - 1), minlength=CELLS).astype(np.int32))
            common = pa.array([int(c.sum()) for c in cells], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), common, pa.array(cells, pa.list_(pa.int32()))], names=["node", "common", "cells"]
            )

    return near.join(own, "node", "left").select("node", "set", "own").mapInArrow(
        tidy(run), "node bigint, common bigint, cells array<int>"
    )


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns of a row, nulls included."""
    return F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def without_near_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, likeness: float = LIKENESS
) -> DataFrame:
    """The row of the smallest id of each component; among equal ids a hash of the row decides."""
    columns = docs.columns
    keyed = docs.withColumn("_row", row_key(docs))
    named = keyed.select(
        F.col("_row").alias("row"), F.col(doc_id).cast("bigint").alias("id"), whole_text(text).alias("text")
    )
    sketches = stored_alone(_sketches(named.select("row", "text"), shingle).dropDuplicates(["row"]))
    nodes = stored_alone(sketches.groupBy("node").agg(F.min("row").alias("row"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("fp").alias("fp")))
    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    place = F.struct("node", "n")
    multi = stored_alone(
        banded.groupBy("band").agg(F.min(place).alias("first"), F.count("*").alias("m")).where("m > 1")
    )
    total = multi.agg(F.sum("m")).first()[0] or 0
    hot = hot_keys(multi, "band", "m", total)
    members = stored_alone(lookup(banded, multi.select("band", "first"), "band", hot))
    removed(multi)

    def sizes_fit(a: str, b: str) -> Column:
        return F.least(a, b) >= F.greatest(a, b) * F.lit(likeness)

    same = stored_alone(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("k")))
    first = trie_links(same.select("fp", F.col("least").alias("node")), BUDGET)
    equal = same.where("k > 1")
    hot_prints = hot_keys(equal, "fp", "k", equal.agg(F.sum("k")).first()[0] or 0)
    first = first.unionByName(
        lookup(nodes.select("fp", "node"), equal.drop("k"), "fp", hot_prints).select(F.col("least").alias("u"), F.col("node").alias("v"))
    )
    stars = stored_alone(
        members.where((F.col("node") != F.col("first.node")) & sizes_fit("n", "first.n"))
        .select(F.col("first.node").alias("u"), F.col("node").alias("v"))
        .unionByName(first.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
        .distinct()
    )
    removed(same)
    needed = members.select("node").unionByName(stars.select(F.explode(F.array("u", "v")).alias("node"))).distinct()
    # The whole sets of all nodes that any comparison can need; a node's text is any with its set.
    needed = needed.join(nodes.select("node", "row"), "node")
    texts = named.select("row", "text").join(needed, "row").select("node", "text").dropDuplicates(["node"])
    sets = stored_alone(_sets(texts, shingle))
    removed(nodes)
    links = _alike(stars, sets, likeness)
    roots = components(links)

    def open_places(roots: DataFrame, members: DataFrame) -> DataFrame:
        """The members of bands that span several components."""
        placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = placed.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("m")).where("a != b")
        return placed.join(several.select("band", "m"), "band")

    left_open = stored_alone(open_places(roots, members.select("band", "node", "n")))
    removed(members)
    made = [stars, sets, links, left_open]
    if not left_open.isEmpty():
        bounds = stored_alone(_bounds(sets, left_open.select("node").distinct()))
        # A node with too few shared shingles is alike to no other.
        left_open = stored_alone(left_open.drop("m").join(bounds, "node").where(F.col("common") >= F.col("n") * F.lit(likeness)))
        central = left_open.groupBy("band").agg(
            F.min(F.struct((1 - F.col("common") / F.greatest("n", F.lit(1))).alias("alone"), "node", "n", "root")).alias("first")
        )
        again = stored_alone(
            left_open.join(central, "band")
            .where((F.col("root") != F.col("first.root")) & sizes_fit("n", "first.n"))
            .select(F.least("node", "first.node").alias("u"), F.greatest("node", "first.node").alias("v"))
            .distinct()
            .join(stars, ["u", "v"], "left_anti")
        )
        found = _alike(again, sets, likeness)
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links)
        made += [bounds, left_open, again, found]
        left_open = open_places(roots, left_open.drop("root"))
        # A band's comparisons are dealt in slices: one side by its hash, the other to all of them.
        slices = F.ceil(F.col("m") / SLICE).cast("int")
        x = left_open.withColumn("slice", F.pmod(F.xxhash64("node"), slices).cast("int")).alias("x")
        y = left_open.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).alias("y")
        least = (F.col("x.n") + F.col("y.n")) * F.lit(likeness / (1 + likeness)) - F.lit(1e-6)
        meet = F.aggregate(
            F.zip_with("x.cells", "y.cells", lambda a, b: F.least(a, b)), F.lit(0), lambda total, c: total + c
        )
        rest = (
            x.join(
                y,
                (F.col("x.band") == F.col("y.band"))
                & (F.col("x.slice") == F.col("y.slice"))
                & (F.col("x.node") < F.col("y.node"))
                & (F.col("x.root") != F.col("y.root"))
                & sizes_fit("x.n", "y.n")
                & (F.least("x.common", "y.common") >= least)
                & (meet >= least),
            )
            .select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
            .distinct()
            .join(stars.unionByName(again), ["u", "v"], "left_anti")
        )
        rest = stored_alone(rest)
        found = _alike(rest, sets, likeness)
        if not found.isEmpty():
            roots = components(links.unionByName(found))
        made += [rest, found]
    removed(*made)

    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    firsts = named.select("row", "id").join(sketches.select("row", "node"), "row").groupBy("node").agg(F.min(rank).alias("rank"))
    kept = (
        firsts.join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("rank").alias("rank"))
        .select(F.col("rank.row").alias("_row"))
    )
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*columns)
