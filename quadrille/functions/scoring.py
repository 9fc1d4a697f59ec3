"""Normalisation, fusion and image measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.config import HIGHER, LOWER, Fusion


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def normalise(value: Column, lower: Column, upper: Column, direction: str = HIGHER) -> Column:
    """``value`` between its bounds as 0 to 1; turned round if lower is better."""
    if direction not in (HIGHER, LOWER):
        raise ValueError(f"unknown direction {direction!r}")
    x = clip((value - lower) / (upper - lower))
    return 1.0 - x if direction == LOWER else x


def fuse(values: dict[str, Column], fusion: Fusion) -> dict[str, Column]:
    """A clipped weighted mean for each group, and ``combined_score`` over the groups."""
    if fusion.method != "grouped_weighted_mean":
        raise ValueError(f"unknown fusion method {fusion.method!r}")
    out: dict[str, Column] = {}
    for g in fusion.groups:
        total = sum((values[m] * F.lit(float(w)) for m, w in g.members.items()), F.lit(0.0))
        out[f"group_{g.name}"] = clip(total / float(sum(g.members.values())), fusion.clip_min, fusion.clip_max)
    total = sum((out[f"group_{g.name}"] * F.lit(float(g.weight)) for g in fusion.groups), F.lit(0.0))
    weight = float(sum(g.weight for g in fusion.groups))
    out["combined_score"] = clip(total / weight, fusion.clip_min, fusion.clip_max)
    return out


def gray(red: Column, green: Column, blue: Column) -> Column:
    """BT.601 luma in fixed point (14 bits, rounded), as image libraries compute it."""
    return F.shiftright((red * 4899 + green * 9617 + blue * 1868 + 8192).cast("int"), 14)


def psnr(mse: Column, most: float = 100.0) -> Column:
    return F.when(mse == 0, F.lit(float(most))).otherwise(
        F.least(10 * F.log10(F.lit(65025.0) / F.nullif(mse, F.lit(0.0))), F.lit(float(most)))
    )


def replace_bit(value: Column, bit: Column) -> Column:
    """``value`` with its lowest bit replaced."""
    return value.bitwiseAND(F.lit(254)).bitwiseOR(bit)


def with_float(t: float) -> Column:
    """A threshold in single precision: scores are, and are compared in it."""
    return F.lit(t).cast("float")
