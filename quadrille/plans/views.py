"""The driver's tables read as the engine's objects, in Spark and in SQL.

Lines of orders are feature rows, the 64 numbers of an embedding are an 8 x 8
patch and an 8 x 8 score map, documents are files of a dataset, and the labels
of documents are label files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.config import LOWER, SPLITS, Feature, Fusion, Group

FEATURES = (
    Feature("quantity"),
    Feature("price"),
    Feature("discount", LOWER),
    Feature("tax", enabled=False),
)
FUSION = Fusion((Group("amount", {"quantity": 0.5, "price": 0.5}), Group("terms", {"discount": 1.0})))
NAMES = ["quantity", "price", "discount", "tax"]
GROUPS = ["group_a", "group_b", "group_c"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_of(key: Column) -> Column:
    m = F.pmod(key, F.lit(10))
    return F.when(m < 7, SPLITS[0]).when(m < 9, SPLITS[1]).otherwise(SPLITS[2])


def split_sql(key: str) -> str:
    return f"case when {key} % 10 < 7 then 'train' when {key} % 10 < 9 then 'validation' else 'test' end"


def rounded(df: DataFrame, places: int = 6, but: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded: sums of doubles depend on their order."""
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t in ("double", "float") and c not in but})


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").alias("n"),
        split_of(F.col("l_orderkey")).alias("split"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


LINES = f"""lines as (select l_orderkey as k, l_linenumber as n, {split_sql('l_orderkey')} as split,
  l_quantity as quantity, l_extendedprice as price, l_discount as discount, l_tax as tax from lineitem)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pixel and score: vec_id, split, row, col, v, g, score and three group scores."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", split_of(F.col("vec_id")).alias("split"), F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), v * 2 + 0.5))
    return e.select(
        "vec_id",
        "split",
        F.floor(F.col("pos") / 8).cast("int").alias("row"),
        (F.col("pos") % 8).alias("col"),
        v.alias("v"),
        F.floor((F.greatest(F.lit(-0.5), F.least(F.lit(0.5), v)) + 0.5) * 255).cast("int").alias("g"),
        s.cast("float").alias("score"),
        s.cast("float").alias("group_a"),
        (s * s).cast("float").alias("group_b"),
        F.when(F.col("pos") % 2 == 0, s).otherwise(1 - s).cast("float").alias("group_c"),
    )


CELLS = f"""e as (select vec_id, {split_sql('vec_id')} as split, unnest(embedding) as f, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
e2 as (select *, cast(f as double) as v, greatest(0.0::double, least(1.0::double, cast(f as double) * 2 + 0.5)) as s from e),
cells as (select vec_id, split, cast(pos // 8 as integer) as row, cast(pos % 8 as integer) as col, v,
  cast(floor((greatest(-0.5::double, least(0.5::double, v)) + 0.5) * 255) as integer) as g,
  cast(s as float) as score, cast(s as float) as group_a, cast(s * s as float) as group_b,
  cast(case when pos % 2 = 0 then s else 1 - s end as float) as group_c from e2)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a dataset."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("Doc_"), F.pmod("doc_id", F.lit(400)).cast("string"), F.lit(".txt"))
    return d.select(
        "doc_id",
        split_of(F.col("doc_id")).alias("split"),
        F.concat_ws("/", F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit("_"), name)).alias("path"),
        name.alias("filename"),
        F.upper("lang").alias("mode"),
        F.col("n_chars").alias("width"),
        F.char_length("text").cast("bigint").alias("height"),
        F.sha2("text", 256).alias("content_hash"),
        "source",
    )


FILES = f"""files as (select doc_id, {split_sql('doc_id')} as split,
  concat(source, '/', doc_id, '_Doc_', doc_id % 400, '.txt') as path, concat('Doc_', doc_id % 400, '.txt') as filename,
  upper(lang) as mode, n_chars as width, length(text) as height, sha256(text) as content_hash, source from documents)"""
