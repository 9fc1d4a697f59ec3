"""Aggregates over features, score maps and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.scoring import with_float
from quadrille.operators.normalization import exact_quantiles


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))


def unpivot(df: DataFrame, names: list[str]) -> DataFrame:
    """(``feature``, ``value``) of the named columns."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.explode(cells).alias("c")).select("c.feature", "c.value")


#: Shares of the quantiles that records hold, and their names.
QUANTILES = {"q01": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "q99": 0.99}


def quantile_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """(``feature``, ``q01`` .. ``q99``) of the named columns, exact at any size."""
    found = exact_quantiles(df, names, list(QUANTILES.values()))
    at = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
    return found.groupBy("feature").agg(*[at(s).alias(n) for n, s in QUANTILES.items()])


def feature_statistics(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts, extremes, quantiles and moments of each feature, over its finite values; no rows for no input."""
    x = {n: F.col(n).cast("double") for n in names}
    values = df.select(*[F.when(finite(x[n]), x[n]).alias(n) for n in names])
    cells = []
    for n in names:
        v = F.col(n)
        moments = (F.count("*").alias("n"), F.count(v).alias("finite_count"), F.min(v).alias("minimum"), F.avg(v).alias("mean"), F.max(v).alias("maximum"), F.stddev_pop(v).alias("std"))
        cells.append(F.struct(F.lit(n).alias("feature"), *moments))
    moments = values.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("n > 0")
    different = unpivot(values, names).where("value is not null").distinct().groupBy("feature").agg(F.count("*").alias("distinct_values"))
    # Each side has a row for each feature.
    out = moments.join(quantile_columns(values, names), "feature", "left").join(different, "feature", "left")
    out = out.withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint")))
    return out.select("feature", "n", "finite_count", "minimum", *QUANTILES, "mean", "maximum", "std", "distinct_values")


def partial_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable moments of each group."""
    x = F.col(value).cast("double")
    return df.groupBy(*keys).agg(
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.sum(x).alias("total"),
        F.sum(x * x).alias("total_squares"),
        F.count(x).alias("n"),
    )


def merged_statistics(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of larger groups from those of smaller ones."""
    out = partial.groupBy(*keys).agg(
        F.count("*").alias("parts"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.sum("total_squares").alias("squares"),
        F.min("minimum").alias("minimum"),
        F.max("maximum").alias("maximum"),
    )
    mean = F.try_divide(F.col("total"), F.col("n"))
    spread = F.sqrt(F.greatest(F.try_divide(F.col("squares"), F.col("n")) - mean * mean, F.lit(0.0)))
    return out.select(
        *keys, "parts", "n", F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(spread, F.lit(0.0)).alias("std"), "minimum", "maximum"
    )


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def score_record(
    df: DataFrame, keys: list[str], score: str, thresholds: list[float], tolerance: float = 1e-6, few: bool = False
) -> DataFrame:
    """Distribution of scores in each group; element-wise comparisons are in single precision.

    ``few``: there are a few large groups by one key (splits), whose quantiles
    are found by :func:`exact_quantiles`; else a group fits one task (an image).
    """
    from quadrille.functions.hashing import threshold_column

    s = F.col(score)
    x = s.cast("double")
    q = F.lit(None) if few else F.percentile(x, F.array(*[F.lit(v) for v in QUANTILES.values()]))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min(x).alias("minimum"),
        q.alias("q"),
        F.avg(x).alias("mean"),
        F.max(x).alias("maximum"),
        F.stddev_pop(x).alias("std"),
        share(s <= with_float(tolerance)).alias("zero_fraction"),
        share(s >= with_float(1 - tolerance)).alias("one_fraction"),
        share(s <= with_float(0.10)).alias("low_fraction"),
        share(s >= with_float(0.90)).alias("high_fraction"),
        *[share(s >= with_float(t)).alias(threshold_column(t)) for t in thresholds],
    )
    if few:
        (key,) = keys
        groups = [r[0] for r in df.select(key).distinct().collect()]
        split = df.select(*[F.when(F.col(key).eqNullSafe(F.lit(g)), x).alias(f"g{k}") for k, g in enumerate(groups)])
        shape = f"_key {dict(df.dtypes)[key]}, feature string"
        named = df.sparkSession.createDataFrame([(g, f"g{k}") for k, g in enumerate(groups)], shape)
        found = named.join(quantile_columns(split, [f"g{k}" for k in range(len(groups))]), "feature").drop("feature")
        return out.drop("q").join(F.broadcast(found), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    quantiles = [F.col("q")[k].alias(n) for k, n in enumerate(QUANTILES)]
    return out.select("*", *quantiles).drop("q")


def clipping(df: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-6) -> DataFrame:
    """How many normalised values stand at either end, for each feature."""
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names])
    v = F.col("c.value")
    out = df.select(*keys, F.explode(cells).alias("c")).groupBy(*keys, F.col("c.feature").alias("feature")).agg(
        F.count(v).alias("n"),
        F.count_if(v <= F.lit(tolerance)).alias("at_zero"),
        F.count_if(v >= F.lit(1 - tolerance)).alias("at_one"),
    )
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n")), F.lit(0.0))
    return out.withColumns({"zero_fraction": part("at_zero"), "one_fraction": part("at_one")})


def in_ranges(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``_range``: rows of larger values have larger ranges, rows of equal values the same.

    The ranges are cut at approximate quantiles, as many as the session has
    shuffle partitions, so an order over all rows is one inside each range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    edges = sorted(set(df.agg(F.percentile_approx(value, shares).alias("e")).first()[0] or [])) if shares else []
    kind = dict(df.dtypes)[value]
    cells = F.lit(edges).cast(f"array<{kind}>") if edges else F.array().cast(f"array<{kind}>")
    return df.withColumn("_range", F.coalesce(F.size(F.filter(cells, lambda e: e <= F.col(value))), F.lit(-1)))


def before_ranges(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Of each range of ``df`` (see :func:`in_ranges`), what the ranges before it hold: (keys, _r, before_<c>)."""
    each = df.groupBy(*keys, F.col("_range").alias("_r")).agg(*[F.sum(c).alias(c) for c in sums])
    # As many rows as there are ranges, for each key.
    w = Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_r")
    return each.select(*[F.col(k).alias(f"_{k}") for k in keys], "_r", *[(F.sum(c).over(w) - F.col(c)).alias(f"before_{c}") for c in sums])


def average_rank(df: DataFrame, value: str, rank: str, keys: list[str] | None = None) -> DataFrame:
    """Ranks from 1; equal values get the mean of theirs.

    Ranks are made on distinct values with their counts; without keys the
    values are ordered range by range. Rows get ranks by a join on the value.
    """
    keys = keys or []
    grouped = df.groupBy(*keys, value).agg(F.count("*").alias("_m"))
    if keys:
        run = F.sum("_m").over(Window.partitionBy(*keys).orderBy(value))
    else:
        grouped = in_ranges(grouped, value)
        offsets = F.broadcast(before_ranges(grouped, [], ["_m"]))
        grouped = grouped.join(offsets, F.col("_range") == F.col("_r"))
        run = F.col("before__m") + F.sum("_m").over(Window.partitionBy("_range").orderBy(value))
    ranks = grouped.withColumn(rank, run - (F.col("_m") - 1) / 2.0)
    right = ranks.select(*[F.col(c).alias(f"_{c}") for c in (*keys, value)], rank)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, value)]
    return df.join(right, on).drop(*[f"_{c}" for c in (*keys, value)])


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(``a``, ``b``, ``correlation``) of all pairs in one pass; null for a constant column."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    c = [F.col(n).cast("double") for n in names]
    aggs = [
        F.try_divide(F.covar_pop(c[i], c[j]), F.stddev_pop(c[i]) * F.stddev_pop(c[j])).alias(f"p{i}_{j}") for i, j in pairs
    ]
    wide = df.agg(*aggs)
    cells = F.array(
        *[
            F.struct(F.lit(names[a]).alias("a"), F.lit(names[b]).alias("b"), F.col(f"p{min(a, b)}_{max(a, b)}").alias("correlation"))
            for a in range(len(names))
            for b in range(len(names))
        ]
    )
    return wide.select(F.explode(cells).alias("c")).select("c.*")


def spearman(df: DataFrame, names: list[str]) -> DataFrame:
    """Rank correlations of all pairs."""
    out = df.select(*names)
    for n in names:
        out = average_rank(out, n, f"_rank_{n}")
    ranked = out.select(*[F.col(f"_rank_{n}").alias(n) for n in names])
    return correlations(ranked, names)


def high_pairs(matrix: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """Pairs i < j whose correlation is at or over the threshold in size, the largest first."""
    place = lambda c: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c))
    found = matrix.where((place("a") < place("b")) & (F.abs("correlation") >= threshold))
    return found.orderBy(F.desc(F.abs("correlation")), place("a"), place("b"))


def distances(df: DataFrame, split: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Kolmogorov-Smirnov, Wasserstein and mean difference between pairs of splits.

    Values are grouped first, and the ordered windows run over distinct values, range by range.
    """
    names = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a, b in pairs])
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(df.sparkSession.range(1).select(names.alias("pairs"))))
    rows = rows.select(F.col(split).alias("_s"), F.col(value).cast("double").alias("v"), F.explode("pairs").alias("p"))
    rows = rows.where((F.col("_s") == F.col("p.first")) | (F.col("_s") == F.col("p.second")))
    grouped = rows.groupBy(F.col("p.first").alias("first_split"), F.col("p.second").alias("second_split"), "v").agg(
        F.count_if(F.col("_s") == F.col("p.first")).alias("na"), F.count_if(F.col("_s") == F.col("p.second")).alias("nb")
    )
    keys = ["first_split", "second_split"]
    grouped = in_ranges(grouped, "v")
    whole = grouped.groupBy(*keys).agg(F.sum("na").alias("all_a"), F.sum("nb").alias("all_b"))
    each = grouped.groupBy(*keys, F.col("_range").alias("_r")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.min("v").alias("least"))
    # A row for each pair and range: what stands before the range, and the first value after it.
    w = Window.partitionBy(*keys).orderBy("_r")
    ends = each.select(
        *keys, "_r", (F.sum("na").over(w) - F.col("na")).alias("_a"), (F.sum("nb").over(w) - F.col("nb")).alias("_b"), F.lead("least").over(w).alias("_next")
    ).join(whole, keys)
    ends = F.broadcast(ends.withColumnsRenamed({k: f"_{k}" for k in keys}))
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_range") == F.col("_r")]
    w = Window.partitionBy(*keys, "_range").orderBy("v")
    share_of = lambda n: F.try_divide(F.col(f"_{n}") + F.sum(f"n{n}").over(w), F.col(f"all_{n}"))
    steps = grouped.join(ends, on).select(
        *keys,
        "v",
        "na",
        "nb",
        (share_of("a") - share_of("b")).alias("gap"),
        (F.coalesce(F.lead("v").over(w), F.col("_next")) - F.col("v")).alias("width"),
    )
    mean = lambda n: F.try_divide(F.sum(F.col("v") * F.col(n)), F.sum(n))
    out = steps.groupBy("first_split", "second_split").agg(
        F.sum("na").alias("first_count"),
        F.sum("nb").alias("second_count"),
        F.max(F.abs("gap")).alias("ks_statistic"),
        F.sum(F.abs("gap") * F.coalesce("width", F.lit(0.0))).alias("wasserstein"),
        (mean("na") - mean("nb")).alias("mean_difference"),
    )
    # A split without values has no distance to another.
    return out.where("first_count > 0 and second_count > 0")


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Two-sided asymptotic p-value of a two-sample statistic."""
    x = statistic * math.sqrt(n * m / (n + m))
    if x < 1e-3:
        return 1.0
    if x < 1.18:
        # The series of the theta function's other form converges fast for small x.
        total = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)) for k in range(1, 6))
        return min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / x * total))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 50, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Density of each of ``bins`` equal bins; the last one is closed on the right."""
    x = F.col(value).cast("double")
    width = (high - low) / bins
    bin_ = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where((x >= low) & (x <= high)).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    return counted.withColumn("density", F.col("n") / (total * F.lit(width)))
