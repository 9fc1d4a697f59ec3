"""Document fingerprints of closed syncmers, in Spark expressions only.

The symbols are words. Of each run of ``K`` words, the hashes of its inner
runs of ``S`` words are compared; the run is an anchor if the smallest of them
stands at either edge. Whether a run is chosen depends on its own words only,
so equal passages have equal anchors wherever they stand. A text of fewer than
``K`` words, or one in which no run is chosen, has one anchor, the whole of it.

The fingerprint has all anchors of a text in the order of their places, as
hexadecimal cells of 32 bits; :func:`anchors` gives them with 64 bits and their
places, for matching by position. The likeness of two fingerprints is the
Jaccard likeness of their sets of anchors, none left out.

Defined cases: a null text is empty; two texts without words are alike (1);
equal texts have equal fingerprints; rows that repeat an id are ordered by a
hash of their text; a null id comes last; a very long text is one row, its
anchors in proportion to its words; an empty table gives an empty result; only
the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, table, whole_text

#: Words of an anchor and of its inner runs.
K, S = 5, 2
#: Documents of a range of ids, and ranges at most; beyond that, ranges grow.
RANGE_ROWS, MOST_RANGES = 250, 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _anchored(text: Column, anchor: Callable[[Column, Column], Column]) -> Column:
    """``anchor(hash, place)`` of each anchor of ``text``, in order."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def of_words(h: Column) -> Column:
        inner = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, S)]))

        def of_inner(b: Column) -> Column:
            cells = K - S
            edge = lambda i: F.least(F.get(b, i), F.get(b, i + cells))
            between = lambda i: [F.get(b, i + j) for j in range(1, cells)]
            at = F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: edge(i) <= F.least(*between(i)))
            runs = lambda a: F.transform(a, lambda i: anchor(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), i))
            return _let(at, lambda a: F.when(F.size(a) > 0, runs(a)).otherwise(whole))

        whole = F.array(anchor(F.xxhash64(h), F.lit(0)))
        return F.when(F.size(h) >= K, _let(inner, of_inner)).otherwise(whole)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of_words)


def anchors(text: Column) -> Column:
    """(hash, place) of each closed syncmer; the place is that of its first word."""
    return _anchored(text, lambda h, i: F.struct(h.alias("hash"), i.alias("place")))


def cells(text: Column) -> Column:
    """The upper halves of the hashes of all anchors of ``text``, in order."""
    return _anchored(text, lambda h, i: F.shiftrightunsigned(h, 32))


def fingerprint(found: Column) -> Column:
    """The fingerprint of a text as a string, from its :func:`cells`."""
    return F.array_join(F.transform(found, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "-")


def likeness(a: Column, b: Column) -> Column:
    """How alike two texts are by their :func:`cells`, from 0 to 1."""

    def of(n: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return both / n.cast("double")

    return _let(F.size(F.array_union(a, b)), of)


def with_next(docs: DataFrame, doc_id: str, carried: list[str]) -> DataFrame:
    """``docs`` with ``next_<c>`` for each carried column: its value in the next document.

    The order is descending ``doc_id``; after the last comes the first. Ids are
    cut at quantiles into ranges, each a window partition; the first row of a
    range also stands at the end of the range before it. Ranges number
    ``MOST_RANGES`` at most, so what the driver sees of them is bounded.
    """
    spark = docs.sparkSession
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    key = F.col(doc_id).cast("bigint")
    shares = [k / ranges for k in range(1, ranges)]
    edges = docs.agg(F.percentile_approx(key, shares, max(10_000, 4 * ranges))).first()[0] if shares else []
    edges = sorted(set(edges or []))
    wide = 64
    coarse, fine = F.lit(edges[::wide] or [0]).cast("array<bigint>"), F.lit(edges or [0]).cast("array<bigint>")

    def below(cells: Column) -> Column:
        return F.size(F.filter(cells, lambda e: e <= key))

    if edges:
        upper = F.greatest(below(coarse) - 1, F.lit(0)) * wide
        bucket = upper + below(F.slice(fine, upper + 1, F.lit(wide)))
    else:
        bucket = F.lit(0)
    placed = docs.withColumns({"_range": bucket.cast("int"), "_tie": F.xxhash64(*carried)})
    heads = sorted(
        (r["_range"], r["_head"]) for r in placed.groupBy("_range").agg(F.max(key).alias("_head")).collect()
    ) if n else []
    # The first row of a range ends the range above; that of the highest ends the lowest.
    ends = [(heads[k][1], heads[(k + 1) % len(heads)][0]) for k in range(len(heads))]
    ends_df = F.broadcast(spark.createDataFrame(ends, "_head bigint, _to int"))
    own = F.struct(F.col("_range").alias("_part"), F.lit(False).alias("_end"))
    also = F.struct(F.col("_to").alias("_part"), F.lit(True).alias("_end"))
    dealt = (
        placed.join(ends_df, key.eqNullSafe(F.col("_head")), "left")
        .withColumn("_place", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, also))))
        .select("*", "_place.*")
    )
    w = Window.partitionBy("_part").orderBy("_end", F.col(doc_id).desc_nulls_last(), "_tie")
    out = dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried})
    return out.where(~F.col("_end")).drop("_range", "_tie", "_head", "_to", "_place", "_part", "_end")


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", whole_text().alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    # Only texts are shuffled; the next document's anchors are made again where its text has come to.
    found = with_next(docs, "doc_id", ["text"]).select("doc_id", "text", "next_text", edited.alias("edited"))
    found = found.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        *[cells(F.col(c)).alias(f"{c}_cells") for c in ("text", "edited", "next_text")],
    )
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("text_cells")).alias("fingerprint"),
        fingerprint(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("text_cells"), F.col("edited_cells")).alias("near_edited"),
        likeness(F.col("text_cells"), F.col("next_text_cells")).alias("near_next"),
    )
