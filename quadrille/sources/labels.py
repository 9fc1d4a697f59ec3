"""Label tables, feature caches, artifacts and reports."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.normalization import Artifact

_map = T.ArrayType(T.ArrayType(T.FloatType()))
_maps = T.ArrayType(_map)

#: A label row: one image.
LABEL = T.StructType(
    [
        T.StructField("split", T.StringType()),
        T.StructField("image_key", T.StringType()),
        T.StructField("source_relative_path", T.StringType()),
        T.StructField("label_file_version", T.IntegerType()),
        T.StructField("score_map", _map),
        T.StructField("raw_feature_maps", _maps),
        T.StructField("normalized_feature_maps", _maps),
        T.StructField("group_score_maps", _maps),
        T.StructField("window_coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType())))),
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("group_names", T.ArrayType(T.StringType())),
        T.StructField("metadata_json", T.StringType()),
    ]
)


def label_rows(scores: DataFrame, features: list[str], groups: list[str], metadata: dict, keys: list[str] | None = None) -> DataFrame:
    """One row for each image from one row for each window.

    ``scores``: keys, row, col, x, y, width, height, features, norm_f,
    group_g, combined_score. An image's windows are as many as the grid says,
    so the group is bounded.
    """
    keys = keys or ["split", "image_key", "source_relative_path"]
    columns = ["combined_score", *features, *[f"norm_{f}" for f in features], *[f"group_{g}" for g in groups], "x", "y", "width", "height"]
    cell = F.struct("row", "col", *columns)
    nested = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("cells"))

    def as_map(value):
        rows = F.sequence(F.lit(0), F.array_max(F.transform("cells", lambda c: c["row"])))
        return F.transform(rows, lambda r: F.transform(F.filter("cells", lambda c: c["row"] == r), value))

    one = lambda name: as_map(lambda c: c[name].cast("float"))
    text = json.dumps(metadata, sort_keys=True)
    out = nested.select(
        *keys,
        F.lit(1).alias("label_file_version"),
        one("combined_score").alias("score_map"),
        F.array(*[one(f) for f in features]).alias("raw_feature_maps"),
        F.array(*[one(f"norm_{f}") for f in features]).alias("normalized_feature_maps"),
        F.array(*[one(f"group_{g}") for g in groups]).alias("group_score_maps"),
        as_map(lambda c: F.array(*[c[k].cast("int") for k in ("x", "y", "width", "height")])).alias("window_coordinates"),
        F.array(*[F.lit(f) for f in features]).alias("feature_names"),
        F.array(*[F.lit(g) for g in groups]).alias("group_names"),
        F.lit(text).alias("metadata_json"),
    )
    return out.select(*[c for c in LABEL.fieldNames() if c in out.columns])


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written whole at ``path``."""
    done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def write_labels(labels: DataFrame, path: str, overwrite: bool = False, compressed: bool = True, append: bool = False) -> None:
    """Parquet by split; the committer makes the files appear whole or not at all."""
    writer = labels.write.partitionBy("split").mode("append" if append else "overwrite" if overwrite else "errorifexists")
    writer.option("compression", "zstd" if compressed else "none").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels with the fixed schema; nothing is inferred."""
    return spark.read.schema(LABEL).parquet(path).select(*LABEL.fieldNames())


def metadata_field(name: str):
    return F.get_json_object("metadata_json", f"$.{name}")


def stale(sources: DataFrame, cache: DataFrame, fingerprint: str, strict: bool = True) -> DataFrame:
    """Sources that the cache does not hold as they are now.

    The cache is keyed by path, fingerprint and (if ``strict``) size and time.
    """
    keys = ["relative_path"] + (["file_size_bytes", "modified_time_ns"] if strict else [])
    return sources.join(cache.where(F.col("fingerprint") == fingerprint).select(*keys).distinct(), keys, "left_anti")


def reuse(sources: DataFrame, labels: DataFrame, key: str, fingerprint_column: str, fingerprint: str) -> DataFrame:
    """``sources`` with ``status``: reused if a label with this fingerprint exists, else generated."""
    valid = labels.where(F.col(fingerprint_column) == fingerprint).select(key).distinct().withColumn("_valid", F.lit(True))
    out = sources.join(valid, key, "left")
    return out.withColumn("status", F.when(F.col("_valid"), "reused").otherwise("generated")).drop("_valid")


def write_json(value: dict, path: str, overwrite: bool = True) -> None:
    """A driver-side report: written beside, then renamed."""
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)
    os.replace(f"{path}.tmp", path)


def save_artifact(artifact: Artifact, path: str) -> None:
    if errors := artifact.errors():
        raise ValueError("; ".join(errors))
    write_json(artifact.dict(), path)


def load_artifact(path: str, fingerprint: str | None = None, names: tuple[str, ...] | None = None) -> Artifact:
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    artifact = Artifact(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
    if errors := artifact.errors(fingerprint, names):
        raise ValueError("; ".join(errors))
    return artifact


def write_report(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """A report as CSV with a header; nulls are empty. Reports have a row for each image at most."""
    df.write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns; what a frame lacks is null, columns in order of first sight."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
