"""Eight named test patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def lattice(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(patch_name, x, y, value) of the six patterns that arithmetic makes."""
    x, y = F.col("x"), F.col("y")
    patterns = {
        "flat_black": F.lit(0),
        "flat_gray": F.lit(128),
        "horizontal_gradient": F.floor(x * 255.0 / max(1, width - 1)),
        "clean_vertical_edge": F.when(x >= width // 2, 255).otherwise(0),
        "checkerboard": (F.floor(x / 8) + F.floor(y / 8)) % 2 * 255,
        "vertical_stripes": F.floor(x / 4) % 2 * 255,
    }
    cells = F.array(*[F.struct(F.lit(n).alias("patch_name"), v.cast("int").alias("value")) for n, v in patterns.items()])
    points = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"))
    return points.select("x", "y", F.explode(cells).alias("c")).select("c.patch_name", "x", "y", "c.value")


def patches(width: int = 64, height: int = 64, seed: int = 42) -> dict[str, np.ndarray]:
    """All eight patterns as gray arrays; the two noises are drawn from one seeded generator."""
    y, x = np.indices((height, width))
    rng = np.random.default_rng(seed)
    noise = rng.integers(0, 256, size=(height, width), dtype=np.uint8)
    faint = np.clip(128 + rng.normal(0.0, 8.0, size=(height, width)), 0, 255)
    made = {
        "flat_black": np.zeros((height, width)),
        "flat_gray": np.full((height, width), 128),
        "horizontal_gradient": np.tile(np.linspace(0, 255, width, dtype=np.uint8), (height, 1)),
        "clean_vertical_edge": np.where(x >= width // 2, 255, 0),
        "checkerboard": (x // 8 + y // 8) % 2 * 255,
        "vertical_stripes": x // 4 % 2 * 255,
        "low_amplitude_noise": faint,
        "random_noise": noise,
    }
    return {n: v.astype(np.uint8) for n, v in made.items()}


def patch_frame(spark: SparkSession, width: int = 64, height: int = 64, seed: int = 42) -> DataFrame:
    """(patch_name, width, height, pixels) of all eight."""
    rows = [(n, width, height, bytearray(p.tobytes())) for n, p in patches(width, height, seed).items()]
    return spark.createDataFrame(rows, "patch_name string, width int, height int, pixels binary")
