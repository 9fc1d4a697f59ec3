"""Image files as rows, and features of their windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.config import Grid
from quadrille.functions import hashing, pixels

#: Extensions read by default.
EXTENSIONS = (".jpg", ".jpeg", ".png")
#: Images that a Python worker holds at once.
BATCH = 16


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Files under a folder: path, relative_path, filename, image_id, extension, size, time.

    Names that start with a dot or an underscore are hidden from Spark's
    readers. No file is opened: content is not among the columns read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    path = F.regexp_replace("path", r"^file:/+", "/")
    name = F.element_at(F.split("path", "/"), -1)
    root = folder.rstrip("/") + "/"
    return reader.load(folder).select(
        F.col("path").alias("uri"),
        path.alias("absolute_path"),
        F.substring(path, F.lit(len(root) + 1), F.length(path)).alias("relative_path"),
        name.alias("filename"),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("image_id"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("extension"),
        F.col("length").alias("file_size_bytes"),
        (F.unix_micros("modificationTime") * 1000).alias("modified_time_ns"),
    )


def images_only(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Supported files in the order of their lower-cased relative paths."""
    return files.where(F.col("extension").isin(*[e.lower() for e in extensions])).orderBy(F.lower("relative_path"), "relative_path")


def unsupported(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    return files.where(~F.col("extension").isin(*[e.lower() for e in extensions]))


#: Channels and mode of the decoder's type codes.
_MODES = {0: "L", 16: "RGB", 24: "RGBA"}


@F.pandas_udf(T.BinaryType())
def _in_rgb(channels: pd.Series, pixels: pd.Series) -> pd.Series:
    """Pixel bytes with red first, from the decoder's, which have blue first."""

    def turned(n, data):
        if data is None or n not in (3, 4):
            return data
        cells = np.frombuffer(data, np.uint8).reshape(-1, int(n))
        return cells[:, [2, 1, 0, 3][: int(n)]].tobytes()

    return pd.Series([turned(n, data) for n, data in zip(channels, pixels, strict=True)])


def read_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """Decoded images with their file attributes; a file that cannot be decoded has readable = false.

    Pixels are BGR bytes as the JVM decoder gives them; ``content_hash`` is the
    digest of mode, size and RGB bytes, made where the pixels are.
    """
    files = images_only(list_files(spark, folder, recursive), extensions)
    reader = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", str(recursive).lower())
    decoded = reader.load(folder).select("image.*")
    mode = F.create_map(*[F.lit(x) for pair in _MODES.items() for x in pair])
    ok = (F.col("width") > 0) & (F.col("nChannels") > 0)
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    # The path of the reader is percent-encoded where a name has odd characters.
    shaped = decoded.select(
        F.url_decode(F.replace(plain(F.col("origin")), F.lit("+"), F.lit("%2B"))).alias("_origin"),
        ok.alias("readable"),
        F.when(ok, F.col("width")).alias("width"),
        F.when(ok, F.col("height")).alias("height"),
        F.when(ok, F.try_element_at(mode, F.col("mode"))).alias("mode"),
        F.when(ok, F.col("nChannels")).alias("channels"),
        F.when(ok, F.col("data")).alias("pixels"),
    )
    plain_order = _in_rgb(F.col("channels"), F.col("pixels"))
    hashed = shaped.withColumn(
        "content_hash", F.when(F.col("readable"), hashing.pixel_sha256(F.col("mode"), F.col("width"), F.col("height"), plain_order))
    )
    path = F.url_decode(F.replace(plain(F.col("uri")), F.lit("+"), F.lit("%2B")))
    joined = files.withColumn("_path", path).join(hashed, F.col("_path") == F.col("_origin"), "left").drop("_path", "_origin", "uri")
    return joined.withColumns(
        {
            "readable": F.coalesce("readable", F.lit(False)),
            "image_key": hashing.image_key(F.col("relative_path")),
        }
    )


def read_splits(spark: SparkSession, folders: dict[str, str], **options) -> DataFrame:
    """The images of several split folders, with ``split``."""
    out = None
    for split, folder in folders.items():
        part = read_images(spark, folder, **options).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def window_features(
    images: DataFrame, grid: Grid, names: tuple[str, ...], rate: float = 0.4, seed: int = 0, path: str = "relative_path"
) -> DataFrame:
    """(split, image_key, row, col, features): one narrow row for each window of each image.

    An image goes to Python once; its windows are views of it there, so pixels
    are never copied for each window. Only the named features are computed.
    """
    images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    asked = images.where("readable").select("split", "image_key", F.col(path).alias("path"), "width", "height", "channels", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if (r["width"], r["height"]) != (grid.image_width, grid.image_height):
                    raise ValueError(f"{r['path']} does not have the grid's size")
                shape = (r["height"], r["width"]) + ((r["channels"],) if r["channels"] > 1 else ())
                g = pixels.to_gray(np.frombuffer(r["pixels"], np.uint8).reshape(shape)[..., :3] if r["channels"] > 1 else np.frombuffer(r["pixels"], np.uint8).reshape(shape))
                rows = []
                for i in range(grid.rows):
                    for j in range(grid.columns):
                        y, x = i * grid.stride_y, j * grid.stride_x
                        patch = np.ascontiguousarray(g[y : y + grid.height, x : x + grid.width])
                        s = hashing.stable_seed(seed, r["split"], r["path"], i, j, x, y)
                        rows.append((i, j, *pixels.measured(patch, names, rate, s)))
                cols = list(zip(*rows, strict=True))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["split"]] * n),
                        pa.array([r["image_key"]] * n),
                        pa.array(cols[0], pa.int32()),
                        pa.array(cols[1], pa.int32()),
                        *[pa.array(np.array(c, np.float32)) for c in cols[2:]],
                    ],
                    names=["split", "image_key", "row", "col", *names],
                )

    shape = "split string, image_key string, row int, col int, " + ", ".join(f"`{n}` float" for n in names)
    return asked.mapInArrow(run, shape)
