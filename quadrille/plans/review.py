"""Review of features over a sample of windows: statistics, correlations, scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.config import Bounds, Feature, Fusion, Grid
from quadrille.functions import hashing, pixels
from quadrille.operators import grids
from quadrille.operators import normalization as nz
from quadrille.operators import statistics as st
from quadrille.plans.labeling import RATE, SEED
from quadrille.sources import images as im
from quadrille.sources import synthetic


@dataclass(frozen=True)
class Review:
    rows: DataFrame
    synthetic: DataFrame
    statistics: DataFrame
    pearson: DataFrame
    spearman: DataFrame
    high: DataFrame


def matrix_rows(matrix: DataFrame, names: list[str]) -> DataFrame:
    """A correlation matrix, one row for each feature; what is not a number is null."""
    return matrix.groupBy(F.col("a").alias("feature")).pivot("b", names).agg(F.first(F.nanvl("correlation", F.lit(None))))


def review(
    images: DataFrame,
    grid: Grid,
    features: tuple[Feature, ...],
    fusion: Fusion,
    bounds: Bounds,
    n_images: int = 100,
    n_windows: int = 10,
    threshold: float = 0.9,
    seed: int = SEED,
) -> Review:
    """All features of a seeded sample of windows, scored with bounds of that sample."""
    spark = images.sparkSession
    names = [f.name for f in features]
    sample = grids.sample_rows(images.where("readable"), seed, ["image_key"], n_images)
    raw = im.window_features(sample, grid, tuple(names), RATE, seed)
    order = [F.xxhash64(F.lit(seed), "image_key", "row", "col"), F.asc("row"), F.asc("col")]
    rows = grids.ranked(raw, ["split", "image_key"], order, n_windows).drop("rank").persist()
    enabled = [f for f in features if f.enabled]
    fitted = nz.fit_bounds(rows, [f.name for f in enabled], bounds)
    made = [(n, *pixels.measured(p, tuple(names), RATE, hashing.stable_seed(seed, n))) for n, p in synthetic.patches(grid.width, grid.height, seed).items()]
    patterns = spark.createDataFrame(made, "patch_name string, " + ", ".join(f"`{n}` double" for n in names))
    pearson, spearman = st.correlations(rows, names), st.spearman(rows, names)
    return Review(
        nz.score(rows, fitted, enabled, fusion),
        nz.score(patterns, fitted, enabled, fusion),
        st.feature_statistics(rows, names),
        pearson,
        spearman,
        st.high_pairs(spearman, names, threshold),
    )
