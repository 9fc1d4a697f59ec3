"""Label generation: fit bounds on the training split, score every split, keep and approve."""

from __future__ import annotations

import json
import os
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.config import Bounds, Feature, Fusion, Grid
from quadrille.functions.hashing import canonical_hash
from quadrille.operators import grids, quality
from quadrille.operators import normalization as nz
from quadrille.sources import images as im
from quadrille.sources import labels as lb

#: Payload rate and seed of the embedding that distortion features compare with.
RATE, SEED = 0.4, 42
#: Columns of the manifest. Fixed values.
MANIFEST = (
    "split image_key source_relative_path label_path status grid_height grid_width score_min score_max score_mean "
    "score_standard_deviation score_sum score_squared_sum score_count"
).split()
#: Arrays that a label needs to be used again.
REQUIRED = ["score_map", "raw_feature_maps", "normalized_feature_maps", "group_score_maps", "window_coordinates"]


def feature_fingerprint(grid: Grid, features: tuple[Feature, ...], rate: float = RATE) -> str:
    """What raw features depend on: a cache with another fingerprint is not read."""
    return canonical_hash({"grid": asdict(grid), "features": [asdict(f) for f in features if f.enabled], "rate": rate})


def label_fingerprint(artifact: nz.Artifact, fusion: Fusion) -> str:
    """What labels depend on: the whole artifact, and the fusion."""
    return canonical_hash({"artifact": artifact.dict(), "fusion": asdict(fusion)})


def fit(images: DataFrame, grid: Grid, features: tuple[Feature, ...], bounds: Bounds, path: str | None = None, force: bool = False) -> nz.Artifact:
    """Exact bounds of the training split's windows.

    An artifact at ``path`` is used again if its fingerprint and names agree.
    """
    names = tuple(f.name for f in features if f.enabled)
    fingerprint = feature_fingerprint(grid, features)
    if path and os.path.exists(path) and not force:
        try:
            return lb.load_artifact(path, fingerprint, names)
        except ValueError:
            pass
    raw = im.window_features(images.where("split = 'train'"), grid, names, RATE, SEED)
    fitted = nz.fit_bounds(raw, list(names), bounds)
    row = fitted.crossJoin(raw.agg(F.count_distinct("image_key").alias("images"), F.count("*").alias("rows"))).first()
    artifact = nz.Artifact(
        fingerprint,
        "train",
        row.images,
        row.rows,
        names,
        tuple(row[f"lower_{n}"] for n in names),
        tuple(row[f"upper_{n}"] for n in names),
        bounds.low,
        bounds.high,
    )
    if errors := artifact.errors():
        raise ValueError("; ".join(errors))
    if path:
        lb.save_artifact(artifact, path)
    return artifact


def generate(images: DataFrame, artifact: nz.Artifact, grid: Grid, features: tuple[Feature, ...], fusion: Fusion) -> DataFrame:
    """Label rows of all images: raw, normalised, group and score maps."""
    spark = images.sparkSession
    enabled = tuple(f for f in features if f.enabled)
    names = tuple(f.name for f in enabled)
    if errors := artifact.errors(feature_fingerprint(grid, features), names):
        raise ValueError("; ".join(errors))
    raw = im.window_features(images, grid, names, RATE, SEED)
    scored = nz.score(raw, artifact.frame(spark), list(enabled), fusion, single=True)
    placed = scored.join(F.broadcast(grids.windows(spark, grid)), ["row", "col"])
    paths = images.select(
        "split",
        "image_key",
        F.col("relative_path").alias("source_relative_path"),
        F.struct("file_size_bytes", "modified_time_ns").alias("source_state"),
    )
    metadata = {
        "label_fingerprint": label_fingerprint(artifact, fusion),
        "normalization_fingerprint": artifact.fingerprint,
        "raw_feature_fingerprint": artifact.fingerprint,
        "feature_names": list(names),
        "grid": asdict(grid) | {"columns": grid.columns, "rows": grid.rows},
        "fusion": asdict(fusion),
    }
    groups = [g.name for g in fusion.groups]
    rows = lb.label_rows(placed, list(names), groups, metadata, ["split", "image_key"])
    # What differs by image is put in front of what all images share.
    own = F.to_json(F.struct("split", "source_relative_path", "source_state"))
    text = F.concat(F.expr("left(_own, length(_own) - 1)"), F.lit(", "), F.substring("metadata_json", 2, 1 << 30))
    placed = rows.join(paths, ["split", "image_key"]).withColumn("_own", own).withColumn("metadata_json", text)
    return placed.select(*lb.LABEL.fieldNames())


def manifest(labels: DataFrame, path: str, grid: Grid) -> DataFrame:
    """One row for each image of ``labels``: where its label is, and statistics of its scores."""
    scores = F.transform(F.flatten("score_map"), lambda v: v.cast("double"))
    zero = F.lit(0.0)
    out = labels.select("split", "image_key", "source_relative_path", F.lit(path).alias("label_path"), scores.alias("_s")).withColumns(
        {
            "grid_height": F.lit(grid.rows),
            "grid_width": F.lit(grid.columns),
            "score_min": F.array_min("_s"),
            "score_max": F.array_max("_s"),
            "score_sum": F.aggregate("_s", zero, lambda total, v: total + v),
            "score_squared_sum": F.aggregate("_s", zero, lambda total, v: total + v * v),
            "score_count": F.size("_s"),
        }
    )
    mean = F.col("score_sum") / F.col("score_count")
    out = out.withColumn("score_mean", mean)
    spread = F.aggregate("_s", zero, lambda total, v: total + (v - F.col("score_mean")) * (v - F.col("score_mean")))
    return out.withColumn("score_standard_deviation", F.sqrt(spread / F.col("score_count"))).drop("_s")


def generate_into(
    images: DataFrame, artifact: nz.Artifact, grid: Grid, features: tuple[Feature, ...], fusion: Fusion, path: str, overwrite: bool = False
) -> DataFrame:
    """Labels of all images in the table at ``path``; returns the manifest.

    Labels that are there, sound and made under the same settings are used
    again, and only the other images are read. If any label there is stale or
    broken, or if ``overwrite`` is set, all are made anew.
    """
    spark = images.sparkSession
    groups, names = [g.name for g in fusion.groups], [f.name for f in features if f.enabled]
    there = None
    if not overwrite and lb.exists(spark, path):
        there = lb.read_labels(spark, path)
        checks = quality.array_checks(REQUIRED, names, groups, grid.rows, grid.columns)
        stale = there.where(~lb.metadata_field("label_fingerprint").eqNullSafe(F.lit(label_fingerprint(artifact, fusion))))
        if not stale.isEmpty() or not quality.issues_of(there, checks, ["split", "image_key"]).isEmpty():
            there = None
    if there is None:
        lb.write_labels(generate(images, artifact, grid, features, fusion), path, True)
        return manifest(lb.read_labels(spark, path), path, grid).withColumn("status", F.lit("generated")).select(*MANIFEST)
    keys = ["split", "image_key"]
    # A reader's list of files is fixed when it is made, so this stays what was there before.
    reused = there.select(*keys, F.lit("reused").alias("status"))
    lb.write_labels(generate(images.join(reused, keys, "left_anti"), artifact, grid, features, fusion), path, append=True)
    rows = manifest(lb.read_labels(spark, path), path, grid)
    status = F.coalesce("status", F.lit("generated"))
    return rows.join(reused, keys, "left").withColumn("status", status).select(*MANIFEST)


def approve(report: dict, reviewed: int, by: str, path: str, notes: str = "") -> dict:
    """Writes the approval if the report has no error and galleries were reviewed."""
    errors = []
    if report.get("errors", 1) != 0:
        errors.append("the report has errors")
    galleries = report.get("galleries", 0)
    if galleries <= 0:
        errors.append("there are no galleries")
    if not 0 < reviewed <= max(galleries, 0):
        errors.append("reviewed galleries must be between one and all")
    if errors:
        raise ValueError("; ".join(errors))
    record = {"approved": True, "reviewed": reviewed, "by": by, "notes": notes, "at": datetime.now(timezone.utc).isoformat()}
    lb.write_json(record, path)
    return record


def reset_approval(path: str) -> dict:
    """A new inspection voids an earlier approval."""
    record = {"approved": False, "reviewed": 0, "by": None, "notes": "", "at": datetime.now(timezone.utc).isoformat()}
    lb.write_json(record, path)
    return record


def read_approval(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
