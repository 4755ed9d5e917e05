"""From raw documents to packed training sequences.

Each stage takes (spark, docs, folder of the tables) and works on all that the stage before it kept. All
but the last return the columns of documents. Further columns of ``docs`` are passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateframe.llm import decontamination, minhash, pii, queries, toxicity
from rateframe.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects. Each row is judged by its own text."""
    return toxicity.without_toxic(docs, queries.toxicity_model(docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of the smallest id, and one row of that id.
    Rows without id are in no group and stay."""
    found = minhash.near_duplicates(docs, percent=queries.SIMILAR_PERCENT)
    dropped = found.filter("NOT kept").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    benchmark = queries.table(spark, sf_dir, "benchmark")
    return decontamination.without_contaminated(docs, benchmark, threshold=queries.SIMILAR_PERCENT / 100)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind in brackets in place of personal data, and n_chars to match. Nulls stay."""
    result = docs.withColumn("text", pii.masked_text(F.col("text"), pii.train(docs)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        result = result.withColumn("n_chars", changed)
    return result.select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_documents),
]
# Learned scores and token ids are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
