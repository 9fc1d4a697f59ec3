"""Score statistics kept up to date as label rows arrive.

Each micro-batch is reduced to mergeable moments and appended; the summary
merges what there is. A batch that is replayed overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quadrille.operators.statistics import merged_statistics, partial_statistics


def run(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Reads what is new under ``source`` and stops."""

    def reduce(batch: DataFrame, number: int) -> None:
        partial_statistics(batch, ["split", "image_key"], "score").write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(reduce).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(spark: SparkSession, target: str) -> DataFrame:
    return merged_statistics(spark.read.parquet(target), ["split"])
