"""Inspection of label rows: integrity, reconciliation, distributions, flags, selection."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.config import SPLITS, Flags, Grid
from quadrille.operators import grids, quality
from quadrille.operators import statistics as st
from quadrille.sources import labels as lb

REQUIRED = ("score_map", "raw_feature_maps", "normalized_feature_maps", "group_score_maps", "window_coordinates", "feature_names", "group_names", "metadata_json")
KEYS = ["split", "image_key"]
SHOWN = ["severity", "code", "split", "image_key", "message"]


@dataclass(frozen=True)
class Inspection:
    issues: DataFrame
    records: DataFrame
    splits: DataFrame
    groups: DataFrame
    clipping: DataFrame
    distances: DataFrame
    selection: DataFrame
    histogram: DataFrame

    def summary(self) -> dict:
        n = {r.severity: r["count"] for r in self.issues.groupBy("severity").count().collect()}
        return {
            "errors": n.get("error", 0),
            "warnings": n.get("warning", 0),
            "galleries": self.selection.count(),
            "suspicious": self.records.where("flag_count > 0").count(),
        }


def coordinates(grid: Grid) -> list[list[list[int]]]:
    """The window coordinates that every label must hold."""
    return [[[c * grid.stride_x, r * grid.stride_y, grid.width, grid.height] for c in range(grid.columns)] for r in range(grid.rows)]


def kept_checks(grid: Grid, normalization: str | None) -> list:
    """Checks after which a row still counts."""
    wanted = F.lit(coordinates(grid)).cast("array<array<array<int>>>")
    path = F.coalesce("source_relative_path", F.lit(""))
    found = lb.metadata_field("normalization_fingerprint")
    checks = [
        (~F.col("window_coordinates").eqNullSafe(wanted), "WINDOW_COORDINATE_MISMATCH"),
        (path == "", "MISSING_SOURCE_PATH"),
        (~F.coalesce(lb.metadata_field("split"), F.col("split")).eqNullSafe(F.col("split")), "SPLIT_METADATA_MISMATCH"),
    ]
    if normalization is not None:
        checks.append((~found.eqNullSafe(F.lit(normalization)), "NORMALIZATION_FINGERPRINT_MISMATCH"))
    return [(c, "error", code, F.lit(code.lower().replace("_", " "))) for c, code in checks]


def _named(df: DataFrame, code: str, message: str) -> DataFrame:
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast("string") for c in ("split", "image_key")}
    return df.select(F.lit("error").alias("severity"), F.lit(code).alias("code"), *[have[c].alias(c) for c in have], F.lit(message).alias("message"))


def score_rows(labels: DataFrame) -> DataFrame:
    """One row for each window: split, image_key, row, col, score and a column for each group."""
    cells = F.transform("score_map", lambda r, i: F.transform(r, lambda s, j: F.struct(i.alias("row"), j.alias("col"), s.alias("score"))))
    return labels.select(*KEYS, F.explode(F.flatten(cells)).alias("c")).select(*KEYS, "c.*")


def inspect(
    labels: DataFrame,
    sources: DataFrame,
    grid: Grid,
    features: list[str],
    groups: list[str],
    expected: dict[str, int | None] | None = None,
    normalization: str | None = None,
    limits: Flags | None = None,
    thresholds: tuple[float, ...] = (0.5, 0.6),
    per_category: int = 3,
    most: int = 20,
    seed: int = 42,
    tolerance: float = 1e-6,
) -> Inspection:
    """All reports on ``labels`` (the label schema) of ``sources`` (split, source_relative_path)."""
    spark, limits = labels.sparkSession, limits or Flags()
    labels = labels.persist()
    structural = quality.issues_of(labels, quality.array_checks(list(REQUIRED), features, groups, grid.rows, grid.columns, tolerance), KEYS).persist()
    rejected = structural.where(F.col("code").isin(*quality.REJECTED)).select(*KEYS).distinct()
    sound = labels.join(rejected, KEYS, "left_anti").persist()
    issues = structural.select(*SHOWN).unionByName(quality.issues_of(sound, kept_checks(grid, normalization), KEYS).select(*SHOWN))
    # Sources and labels; a rejected label leaves its source unlabelled.
    # A path counts inside its split; the empty path is no source, but can stand twice.
    path = F.coalesce("source_relative_path", F.lit(""))
    source = F.concat_ws("/", "split", path)
    from_, to = sources.withColumn("_source", source), sound.withColumn("_source", source)
    unlabelled = quality.missing(from_, to, "_source")
    orphans = quality.missing(to.where(path != ""), from_, "_source")
    later = quality.later_occurrences(to, "_source", [F.lower("image_key"), F.col("image_key")])
    issues = issues.unionByName(_named(unlabelled, "MISSING_LABEL_FOR_SOURCE", "the source has no sound label"))
    issues = issues.unionByName(_named(orphans, "ORPHAN_LABEL", "the label has no source"))
    issues = issues.unionByName(_named(later, "DUPLICATE_SOURCE_LABEL", "the source has an earlier label"))
    wanted = spark.createDataFrame([(s, (expected or {}).get(s)) for s in SPLITS], "split string, expected bigint")
    for df, code in ((sources, "SOURCE_IMAGE_COUNT_MISMATCH"), (labels, "LABEL_FILE_COUNT_MISMATCH")):
        issues = issues.unionByName(_named(quality.count_mismatch(df, wanted), code, "another count than expected"))
    issues = issues.unionByName(_named(quality.empty_splits(sound, wanted.select("split")), "NO_VALID_LABEL_SCORES", "the split has no sound label"))
    marked = sound.withColumn("fp", lb.metadata_field("label_fingerprint"))
    issues = issues.unionByName(_named(quality.fingerprints(marked, ["split"], "fp").where("not consistent"), "INCONSISTENT_LABEL_FINGERPRINTS", "not one fingerprint in the split"))
    overall = quality.fingerprints(marked, [], "fp").where("fingerprints > 1")
    issues = issues.unionByName(_named(overall, "CROSS_SPLIT_FINGERPRINT_MISMATCH", "splits differ in fingerprint"))
    # Distributions.
    scores = score_rows(sound).persist()
    record = st.score_record(scores, KEYS, "score", list(thresholds), tolerance)
    means = sound.select(
        *KEYS,
        *[
            F.expr(f"aggregate(flatten(group_score_maps[{k}]), 0D, (a, x) -> a + x) / size(flatten(group_score_maps[{k}]))").alias(f"mean_{g}")
            for k, g in enumerate(groups)
        ],
    )
    peaks = quality.peak_share(scores, KEYS, "row", "col", "score", grid.rows, grid.columns, limits.peak)
    records = quality.suspicious(record.join(means, KEYS).join(peaks, KEYS), [f"mean_{g}" for g in groups], limits)
    group_rows = sound.select(*KEYS, F.posexplode("group_score_maps").alias("g", "m")).select(
        *KEYS, F.get(F.array(*[F.lit(g) for g in groups]), F.col("g")).alias("group_name"), F.explode(F.flatten("m")).alias("value")
    )
    group_stats = st.merged_statistics(st.partial_statistics(group_rows, ["split", "group_name", "image_key"], "value"), ["split", "group_name"])
    long = sound.select("split", F.posexplode("normalized_feature_maps").alias("f", "m")).select("split", "f", F.explode(F.flatten("m")).alias("value"))
    named = long.withColumn("feature", F.get(F.array(*[F.lit(f) for f in features]), F.col("f")))
    clipped = named.groupBy("split", "feature").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").cast("double") <= tolerance).alias("at_zero"),
        F.count_if(F.col("value").cast("double") >= 1 - tolerance).alias("at_one"),
    )
    pairs = list(itertools.combinations(SPLITS, 2))
    keyed = records.withColumn("label_path", F.concat_ws("/", *KEYS))
    return Inspection(
        issues,
        records,
        st.score_record(scores, ["split"], "score", list(thresholds), tolerance, few=True),
        group_stats,
        clipped,
        st.distances(scores, "split", "score", pairs),
        grids.select_records(keyed, "label_path", per_category, most, seed),
        st.histogram(scores, ["split"], "score"),
    )


def image_windows(scores: DataFrame, image_key: str, k: int = 5) -> DataFrame:
    """The highest and lowest windows of one image, for a gallery."""
    one = scores.where(F.col("image_key") == image_key)
    high = grids.ranked(one, KEYS, [F.desc("score"), F.asc("row"), F.asc("col")], k).withColumn("end", F.lit("high"))
    low = grids.ranked(one, KEYS, [F.asc("score"), F.asc("row"), F.asc("col")], k).withColumn("end", F.lit("low"))
    return high.unionByName(low)


def write(found: Inspection, folder: str, overwrite: bool = True) -> dict:
    """The tables as CSV, and the integrity report; an earlier approval is void."""
    from quadrille.plans import labeling

    for name in ("issues", "records", "splits", "groups", "clipping", "distances", "selection", "histogram"):
        lb.write_report(getattr(found, name), f"{folder}/{name}", overwrite)
    lb.write_report(found.records.where("flag_count > 0"), f"{folder}/suspicious", overwrite)
    out = found.summary()
    lb.write_json(out, f"{folder}/integrity.json", overwrite)
    labeling.reset_approval(f"{folder}/approval.json")
    return out
