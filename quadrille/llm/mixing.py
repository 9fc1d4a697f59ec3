"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by the set of sources they belong to (their
membership pattern). A flow network on these few patterns sends words from
patterns to source quotas; a pattern's words cost more with each repetition
(convex), so nothing is repeated while unread words would do. Inside a pattern
the documents for the last, partial pass are chosen by a seeded hash.

Patterns that share no source are independent, so each connected part of the
network is solved by itself; a source that stands in one-source patterns only
needs no flow, its words are the lesser of quota and capacity. The driver holds
one number for each pattern and source, never documents.

Defined cases: a null source is a source of its own and sorts last; a null
text has size 0; a document of size 0 is returned with ``taken`` 0; repeated
rows count each; null or repeated ids are told apart by a hash of their text;
an empty table gives an empty result; only the named columns are read, and a
column that starts with an underscore may not clash with the working columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, cut, table, whole_text

#: Rows of a plan that is broadcast; a longer one is joined by a shuffle.
PLAN_ROWS = 100_000
#: Sizes of the two histogram levels that place the seeded cut, as bits.
BITS = 12


def targets(sizes: dict, weights: Sequence[float], share: float, most: float) -> dict:
    """Words asked of each source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` times all words. A target stops at ``most`` times its source's
    words; the excess is shared again by weight until none is above.
    """
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        asked = {s: left * weight[s] / total for s in open_}
        above = [s for s in open_ if asked[s] > most * sizes[s]]
        if not above:
            out.update(asked)
            break
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def flows(supply: dict, quota: dict, passes: int) -> dict:
    """Words sent from each pattern to each source, part by part of the network."""
    root = {s: s for s in quota}

    def find(s):
        while root[s] != s:
            root[s] = s = root[root[s]]
        return s

    for p in supply:
        for s in p[1:]:
            root[find(s)] = find(p[0])
    parts: dict = {}
    for p in supply:
        if p:
            parts.setdefault(find(p[0]), []).append(p)
    out = {}
    for patterns in parts.values():
        if len(patterns) == 1 and len(patterns[0]) == 1:
            p = patterns[0]
            out[p, p[0]] = min(quota[p[0]], passes * supply[p])
        else:
            own = {s: quota[s] for p in patterns for s in p}
            out |= min_cost_flow({p: supply[p] for p in patterns}, own, passes)
    return out


def min_cost_flow(supply: dict, quota: dict, passes: int) -> dict:
    """Words sent from each pattern to each source.

    ``supply``: words of a pattern (a tuple of sources) in one pass. The k-th
    pass over a pattern costs k - 1 a word. Shortest augmenting paths on the
    residual network; costs are small integers, so a queue relaxes them.
    """
    patterns, sources = list(supply), list(quota)
    pat = {p: 1 + i for i, p in enumerate(patterns)}
    src = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    sink = 1 + len(patterns) + len(sources)
    to, cap, cost, out = [], [], [], [[] for _ in range(sink + 1)]

    def edge(a: int, b: int, room: int, price: int) -> int:
        out[a].append(len(to))
        to.extend((b, a)), cap.extend((room, 0)), cost.extend((price, -price))
        out[b].append(len(to) - 1)
        return len(to) - 2

    routes = {}
    for p in patterns:
        for k in range(passes):
            edge(0, pat[p], supply[p], k)
        for s in p:
            routes[p, s] = edge(pat[p], src[s], passes * supply[p], 0)
    for s in sources:
        edge(src[s], sink, quota[s], 0)
    while True:
        dist, via, queue, waiting = {0: 0}, {}, [0], {0}
        for a in queue:
            waiting.discard(a)
            for e in out[a]:
                if cap[e] and dist[a] + cost[e] < dist.get(to[e], float("inf")):
                    dist[to[e]], via[to[e]] = dist[a] + cost[e], e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if sink not in dist:
            break
        path, b = [], sink
        while b:
            path.append(via[b])
            b = to[via[b] ^ 1]
        room = min(cap[e] for e in path)
        for e in path:
            cap[e] -= room
            cap[e ^ 1] += room
    return {r: cap[e ^ 1] for r, e in routes.items()}


def mix_sources(
    docs: DataFrame,
    quota_of,
    doc_id: str = "doc_id",
    size: str = "size",
    sources: str = "sources",
    passes: int = 2,
    seed: int = 7,
    tie: str | None = None,
) -> DataFrame:
    """``docs`` with ``taken``: the words that the mix takes of each document.

    ``sources`` is an array column (a document may belong to several);
    ``quota_of`` maps {source: words} to {source: words asked}. Whole passes
    are taken of every document of a pattern; the rest goes to the documents
    first in seeded order, the last of them in part, so that quotas are met to
    the word where the flow can meet them. ``tie`` tells rows of one id apart.
    """
    ids = [doc_id] + ([tie] if tie else [])
    spark = docs.sparkSession
    docs = cut(
        docs.withColumn("_pattern", F.array_sort(F.array_distinct(sources))).withColumn(
            "_h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 64 - 3 * BITS)
        )
    )
    agg = docs.groupBy("_pattern").agg(F.sum(size).cast("bigint").alias("n"))
    supply = {tuple(r["_pattern"]): int(r["n"] or 0) for r in agg.collect()}
    sizes: dict = {}
    for p, n in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = {s: round(v) for s, v in quota_of(sizes).items()}
    flow = flows(supply, quota, passes)
    plan = []
    for p, n in supply.items():
        words = sum(flow[p, s] for s in p)
        plan.append((list(p), words // n if n else 0, words % n if n else 0))
    small = (lambda df: F.broadcast(df)) if len(plan) <= PLAN_ROWS else (lambda df: df)
    plan_df = small(spark.createDataFrame(plan, "_p array<string>, _base bigint, _rest bigint"))
    # An array of a null source equals itself under <=>, unlike under =.
    docs = docs.join(plan_df, F.col("_pattern").eqNullSafe(F.col("_p"))).drop("_p")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    def cut_at(rows: DataFrame, level: int, before: DataFrame | None) -> DataFrame:
        """Of each pattern, the histogram bucket in which the rest runs out."""
        bucket = F.shiftright("_h", (2 - level) * BITS)
        sums = rows.groupBy("_pattern", bucket.alias("_b")).agg(
            F.sum(size).alias("_n"), F.first("_rest").alias("_rest")
        )
        if before is not None:
            sums = sums.join(small(before), same("_pattern", "_q")).drop("_q", "_bucket")
        else:
            sums = sums.withColumn("_done", F.lit(0).cast("bigint"))
        w = Window.partitionBy("_pattern").orderBy("_b")
        run = F.col("_done") + F.sum("_n").over(w)
        return (
            sums.withColumn("_run", run)
            .where((F.col("_run") > F.col("_rest")) & (F.col("_run") - F.col("_n") <= F.col("_rest")))
            .select(
                F.col("_pattern").alias("_q"), F.col("_b").alias("_bucket"), (F.col("_run") - F.col("_n")).alias("_done")
            )
        )

    def inside(rows: DataFrame, edges: DataFrame, level: int) -> DataFrame:
        kept = rows.join(
            small(edges),
            same("_pattern", "_q") & (F.shiftright("_h", (2 - level) * BITS) == F.col("_bucket")),
        )
        return kept

    first = cut(cut_at(docs, 0, None))
    near = inside(docs, first, 0).drop("_q", "_bucket", "_done")
    second = cut(cut_at(near, 1, first))
    # What is left is one 2^-24 part of a pattern: its rows are placed one by one.
    w = Window.partitionBy("_pattern").orderBy("_h", *ids).rowsBetween(Window.unboundedPreceding, -1)
    last = inside(docs, second, 1)
    last = last.withColumn("_at", F.col("_done") + F.coalesce(F.sum(size).over(w), F.lit(0)))
    last = last.withColumn(
        "_more", F.greatest(F.lit(0), F.least(F.col(size), F.col("_rest") - F.col("_at"))).cast("bigint")
    ).drop("_q", "_bucket", "_done", "_at")
    edge = small(second.select("_q", "_bucket"))
    rest = docs.join(edge, same("_pattern", "_q"), "left")
    b = F.shiftright("_h", BITS)
    rest = rest.where(F.col("_bucket").isNull() | (b != F.col("_bucket"))).withColumn(
        "_more", F.when(b < F.col("_bucket"), F.col(size)).otherwise(0).cast("bigint")
    ).drop("_q", "_bucket")
    both = rest.unionByName(last)
    return both.withColumn("taken", (F.col("_base") * F.col(size) + F.col("_more")).cast("bigint")).drop(
        "_pattern", "_h", "_base", "_rest", "_more"
    )


#: The mix that the query and the pipeline ask for.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2


def tie_of() -> Column:
    """What tells documents of one id apart: a hash of the text."""
    return F.xxhash64(F.col("text").isNull(), whole_text())


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size in words, the one-source membership, and a hash of the text, of each document."""
    return docs.select(
        "doc_id",
        tie_of().alias("tie"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("bigint").alias("size"),
        F.array(F.col("source").cast("string")).alias("sources"),
    )


def mix_documents(docs: DataFrame, seed: int = 7) -> tuple[DataFrame, dict, dict]:
    """The mix of ``documents``; also the sources' sizes and targets."""
    got: dict = {}

    def quota_of(sizes: dict) -> dict:
        got.update(sizes=sizes, targets=targets(sizes, WEIGHTS, SHARE, MOST))
        return got["targets"]

    out = mix_sources(sized(docs), quota_of, passes=MOST, seed=seed, tie="tie")
    return out, got["sizes"], got["targets"]


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words at the weights 3, 1, 2."""
    out, sizes, asked = mix_documents(table(spark, sf_dir, "documents"))
    per = spark.createDataFrame(
        [(s, n, float(asked[s])) for s, n in sizes.items()], "_s string, source_size bigint, target double"
    )
    if len(sizes) <= PLAN_ROWS:
        per = F.broadcast(per)
    return out.join(per, F.col("sources")[0].eqNullSafe(F.col("_s"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
