"""What the corpus operators share: reading, checkpoints, hot keys, batches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch sent to Python. Texts differ in length by four
#: orders of magnitude, so the batches are short.
BATCH_ROWS = 256
#: A key counts as hot when it holds more than this share of all rows, so there
#: are at most ``1 / HOT_SHARE`` hot keys whatever the input's size.
HOT_SHARE = 1 / 512
#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the Arrow batches that Python workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """What this process has freed goes back to the system: Arrow's pool, and on Linux the C library's heap too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, and then what it has freed goes back to the system: workers idle on while other stages run."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def spare(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its own columns of these names kept as ``<name>_given``, so that ``names`` can be added."""
    for name in names:
        if name in df.columns:
            given = f"{name}_given"
            while given in df.columns:
                given += "_"
            df = df.withColumnRenamed(name, given)
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors and driver share: the session's ``spark.checkpoint.dir``.

    Without that setting only a local session (all in one process) gets a
    folder of this machine; on a cluster the call is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that the executors share")
            folder = tempfile.mkdtemp(prefix="quadrille-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, its lineage cut there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and read again.

    For wide intermediate rows: columns are compressed, and a reader takes only
    those it needs.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def stored_alone(df: DataFrame) -> DataFrame:
    """:func:`stored`; the shuffle files behind the table go with the write.

    Else they stay until the driver happens to collect its garbage.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stored(df)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def removed(*tables: DataFrame) -> None:
    """Deletes tables that :func:`stored` or :func:`stored_alone` has returned; nothing made from them may be read any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(counts: DataFrame, key: str, n: str, total: int, share: float = HOT_SHARE) -> DataFrame:
    """Keys of ``counts`` that hold over ``share`` of ``total`` rows.

    At most ``1 / share`` rows can qualify, which bounds a broadcast of them.
    """
    return counts.where(F.col(n) > total * share).select(key)


def lookup(big: DataFrame, small: DataFrame, keys: str | list[str], hot: DataFrame, salts: int = 64) -> DataFrame:
    """``big`` joined to ``small`` (unique by ``keys``), with hot keys spread.

    Rows of a hot key are dealt over ``salts`` partitions; ``small`` has its
    row for that key once in each of them. ``hot`` has hot values of the first
    key; it is bounded (see :func:`hot_keys`) and is the only side broadcast.
    """
    keys = [keys] if isinstance(keys, str) else keys
    mark = F.broadcast(hot.select(F.col(keys[0]).alias("_hot_key"), F.lit(True).alias("_hot")).distinct())
    left = big.join(mark, F.col(keys[0]) == F.col("_hot_key"), "left").withColumn(
        "_salt",
        F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(0).cast("int"),
    ).drop("_hot_key", "_hot")
    right = small.join(mark, F.col(keys[0]) == F.col("_hot_key"), "left").withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        ),
    ).drop("_hot_key", "_hot")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def whole_text(name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))
