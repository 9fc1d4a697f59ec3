"""Windows over images, pixel coverage, and picking windows and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.config import Grid
from quadrille.operators.normalization import exact_quantiles


def windows(spark: SparkSession, grid: Grid) -> DataFrame:
    """(row, col, x, y, width, height) of each window, row by row."""
    if grid.errors():
        raise ValueError("; ".join(grid.errors()))
    step = lambda size, window, stride: F.sequence(F.lit(0), F.lit(size - window), F.lit(stride))
    rows = spark.range(1).select(F.posexplode(step(grid.image_height, grid.height, grid.stride_y)).alias("row", "y"))
    return rows.select("row", "y", F.posexplode(step(grid.image_width, grid.width, grid.stride_x)).alias("col", "x")).select(
        "row", "col", "x", "y", F.lit(grid.width).alias("width"), F.lit(grid.height).alias("height")
    )


def image_windows(images: DataFrame, grid: Grid) -> DataFrame:
    """Every image (narrow rows, no pixels) with every window; the window table is fixed by the grid."""
    return images.crossJoin(F.broadcast(windows(images.sparkSession, grid)))


def coverage(scores: DataFrame, keys: list[str], grid: Grid, score: str = "score") -> DataFrame:
    """Mean score of the windows over each pixel: ``keys``, px, py, score."""
    pixels = scores.select(
        *keys,
        F.explode(F.sequence(F.col("x"), F.col("x") + F.col("width") - 1)).alias("px"),
        "y",
        "height",
        F.col(score).alias("_s"),
    ).select(*keys, "px", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("py"), "_s")
    inside = pixels.where((F.col("px") < grid.image_width) & (F.col("py") < grid.image_height))
    return inside.groupBy(*keys, "px", "py").agg(F.avg(F.col("_s").cast("double")).alias(score))


def uncovered(covered: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """Images with pixels that no window covers."""
    whole = grid.image_width * grid.image_height
    return covered.groupBy(*keys).agg(F.count("*").alias("pixels")).where(F.col("pixels") < whole)


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sample_rows(df: DataFrame, seed: int, key: list[str], n: int, total: int | None = None) -> DataFrame:
    """``n`` rows without replacement, by a seeded hash of their key; all of them if there are no more.

    ``total`` is the number of rows, where it is known: rows that all stay are not put in order.
    """
    if total is not None and total <= n:
        return df
    return df.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(n)


#: Categories of the review selection, in order: column, largest first, ties in reverse input order.
CATEGORIES = (
    ("lowest_mean", "mean", False, False),
    ("highest_mean", "mean", True, True),
    ("median_mean", "_from_median", False, False),
    ("lowest_std", "std", False, False),
    ("highest_std", "std", True, True),
    ("most_zeros", "zero_fraction", True, False),
    ("most_ones", "one_fraction", True, False),
)


def select_records(records: DataFrame, key: str, per_category: int, most: int, seed: int) -> DataFrame:
    """(``key``, category, place): a stratified choice of records for review.

    Each category offers its first ``per_category`` records; one that an
    earlier category has chosen is skipped and not replaced. What is missing
    up to ``most`` is filled in seeded order. Ties are in order of ``key``.
    """
    middle = exact_quantiles(records, ["mean"], [0.5]).agg(F.max("value").alias("_m"))
    # Read by each category, so kept; what an executor loses is computed again.
    rows = records.crossJoin(F.broadcast(middle)).withColumn("_from_median", F.abs(F.col("mean") - F.col("_m"))).drop("_m").persist()
    offers = None
    for k, (name, column, down, reverse) in enumerate(CATEGORIES):
        order = [F.col(column).desc() if down else F.col(column).asc(), F.col(key).desc() if reverse else F.col(key).asc()]
        # orderBy + limit keeps per_category rows a task; the window then runs over those only.
        first = rows.orderBy(*order).limit(per_category)
        place = F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(*order))
        offer = first.select(key, F.lit(name).alias("category"), F.lit(k).alias("_c"), place.alias("_p"))
        offers = offer if offers is None else offers.unionByName(offer)
    once = Window.partitionBy(key).orderBy("_c", "_p")
    chosen = offers.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    rest = (
        rows.join(chosen.select(key), key, "left_anti")
        .orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
        .limit(most)
        .select(key, F.lit("fill").alias("category"), F.lit(len(CATEGORIES)).alias("_c"), F.xxhash64(F.lit(seed), F.col(key)).alias("_p"))
    )
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_c", "_p", key))
    both = chosen.withColumn("_p", F.col("_p").cast("bigint")).unionByName(rest)
    return both.withColumn("place", place).where(F.col("place") <= most).drop("_c", "_p")
