"""Dataset validation: list, decode, check, find duplicates, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.config import SPLITS, Grid
from quadrille.functions import hashing
from quadrille.operators import quality
from quadrille.sources import images as im
from quadrille.sources import labels as lb

#: Severities that a code may have.
SEVERITIES = ("ignore", "info", "warning", "error")
ISSUE = "severity string, code string, split string, path string, message string"
MANIFEST = (
    "split", "relative_path", "absolute_path", "filename", "image_id", "image_key", "extension", "file_size_bytes",
    "modified_time_ns", "readable", "width", "height", "mode", "channels", "content_hash", "codes",
)


@dataclass(frozen=True)
class Checked:
    manifest: DataFrame
    issues: DataFrame
    summary: DataFrame

    def valid(self) -> bool:
        return self.issues.where("severity = 'error'").isEmpty()


def grid_issues(spark: SparkSession, grid: Grid, expected: tuple[int, int], windows: int | None = None) -> DataFrame:
    """What the grid has other than expected."""
    rows = []
    for code, found, wanted in (
        ("INVALID_WINDOW_GRID_WIDTH", grid.columns, expected[0]),
        ("INVALID_WINDOW_GRID_HEIGHT", grid.rows, expected[1]),
        ("INVALID_WINDOWS_PER_IMAGE", grid.windows, windows if windows is not None else expected[0] * expected[1]),
    ):
        if found != wanted:
            rows.append(("error", code, None, None, f"expected {wanted}, found {found}"))
    return spark.createDataFrame(rows, ISSUE)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def validate(
    spark: SparkSession,
    folders: dict[str, str],
    grid: Grid,
    channels: int = 3,
    expected: dict[str, int | None] | None = None,
    expected_grid: tuple[int, int] | None = None,
    severity: dict[str, str] | None = None,
    extensions: tuple[str, ...] = im.EXTENSIONS,
) -> Checked:
    """Everything that is wrong with the images of the split folders."""
    severity = severity or {}
    if bad := sorted(set(severity.values()) - set(SEVERITIES)):
        raise ValueError(f"unknown severities: {', '.join(bad)}")
    of = lambda code, usual="error": severity.get(code, usual)
    there = {s: f for s, f in folders.items() if _exists(spark, f)}
    lacking = [(of("MISSING_SPLIT_DIRECTORY"), "MISSING_SPLIT_DIRECTORY", s, folders.get(s), "the folder does not exist") for s in (*SPLITS, *folders) if s not in there]
    issues = spark.createDataFrame(list(dict.fromkeys(lacking)), ISSUE)
    if expected_grid:
        issues = issues.unionByName(grid_issues(spark, grid, expected_grid))
    images = im.read_splits(spark, there, extensions=extensions).withColumn("path", F.col("absolute_path")).persist()
    columns = ["severity", "code", "split", "path", "message"]
    for split, folder in there.items():
        other = im.unsupported(im.list_files(spark, folder), extensions)
        issues = issues.unionByName(
            other.select(
                F.lit(of("UNSUPPORTED_FILE", "warning")).alias("severity"), F.lit("UNSUPPORTED_FILE").alias("code"), F.lit(split).alias("split"), F.col("absolute_path").alias("path"), F.concat(F.lit("extension "), "extension").alias("message")
            )
        )
    rows = quality.issues_of(images, quality.image_checks(grid.image_width, grid.image_height, channels, severity), ["split", "path"])
    issues = issues.unionByName(rows.select(*columns))
    splits = spark.createDataFrame([(s, n) for s, n in {**dict.fromkeys(SPLITS), **(expected or {})}.items()], "split string, expected bigint")
    empty = quality.empty_splits(images, splits.select("split"))
    issues = issues.unionByName(
        empty.select(F.lit(of("EMPTY_DATASET_SPLIT")).alias("severity"), F.lit("EMPTY_DATASET_SPLIT").alias("code"), "split", F.lit(None).cast("string").alias("path"), F.lit("the split has no images").alias("message"))
    )
    wrong = quality.count_mismatch(images, splits)
    issues = issues.unionByName(
        wrong.select(
            F.lit(of("IMAGE_COUNT_MISMATCH")).alias("severity"), F.lit("IMAGE_COUNT_MISMATCH").alias("code"), "split", F.lit(None).cast("string").alias("path"), F.concat(F.lit("expected "), F.col("expected").cast("string"), F.lit(", found "), F.col("found").cast("string")).alias("message")
        )
    )
    readable = images.where("readable")
    for kind, key in (("FILENAME", hashing.folded(F.col("filename"))), ("IMAGE_ID", hashing.folded(F.col("image_id"))), ("CONTENT", F.col("content_hash"))):
        across, within = of(f"DUPLICATE_{kind}_ACROSS_SPLITS"), of(f"DUPLICATE_{kind}_WITHIN_SPLIT", "warning")
        found = quality.duplicate_issues(readable, key, kind, across, within)
        issues = issues.unionByName(found.withColumn("message", F.lit(f"equal {kind.lower().replace('_', ' ')}")).select(*columns))
    issues = issues.where("severity <> 'ignore'").persist()
    manifest = quality.with_codes(images, issues).select(*MANIFEST)
    return Checked(manifest, issues, quality.issue_summary(issues))


def write(checked: Checked, folder: str, overwrite: bool = True) -> dict:
    """The three reports; returns the summary as it is written."""
    lb.write_report(checked.manifest.orderBy(F.lower("relative_path")), f"{folder}/manifest", overwrite)
    lb.write_report(checked.issues.orderBy("severity", "code", "split", "path"), f"{folder}/issues", overwrite)
    counts: dict = {}
    for r in checked.summary.collect():
        counts.setdefault(r.scope, {})[r.name or ""] = r.n
    images = {r.split: r["count"] for r in checked.manifest.groupBy("split").count().collect()}
    out = {"valid": checked.valid(), "images": images, **counts}
    lb.write_json(out, f"{folder}/summary.json", overwrite)
    return out
