"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns that came in. A stage holds no state of the one before.

Defined cases, in every stage: a null text is empty; null and repeated ids are
told apart by their texts; repeated rows are rows of their own, of which the
second stage keeps one; ties are broken by hashes of the rows, so reruns agree;
an empty table gives an empty table; extra columns come back as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import bpe, mixing, nearcopies, secrets, toxicity
from quadrille.llm.common import shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    The classifier learns from the labelled rows of ``docs``; a document is
    rejected at or over the threshold of its language.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    own = {c: f"_own_{c}" for c in ("score", "toxic") if c in docs.columns}
    kept = toxicity.classify(docs.withColumnsRenamed(own), model).where(~F.col("toxic"))
    return kept.withColumnsRenamed({"score": "_score", "toxic": "_toxic"} | {v: k for k, v in own.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies.

    Near copies have a Jaccard likeness of 0.8 or more over 5-word shingles.
    """
    return nearcopies.without_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; ``n_chars`` follows the text."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        n = F.coalesce(F.char_length("text").cast(kind), F.col("n_chars"))
        out = out.withColumn("n_chars", n)
    return out.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, whole.

    A document taken in part counts as taken if at least half of it is. A
    document without words costs nothing and stays once.
    """
    taken, _, _ = mixing.mix_documents(docs)
    passes = taken.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(
        F.when(F.sum("size") > 0, F.floor(F.sum("taken") / F.sum("size") + 0.5)).otherwise(1).cast("int").alias("_n")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (mixing.tie_of() == F.col("_tie"))
    out = docs.join(passes.where("_n > 0"), same)
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: doc_id, n_tokens, ids."""
    out = bpe.encode_documents(docs.select("doc_id", "text"), bpe.tokenizer_path())
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("mix", mix),
    ("tokenize", tokenize),
]

#: A trained classifier and a seeded flow are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return docs
        path = f"{folder}/{k}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(before)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
        before = path
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
