"""From raw documents to packed training sequences: five stages over the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of ``documents``. ``run`` writes every stage's rows as a table in the shared folder and rereads them, so a
lost executor never sets more than one stage back. No stage has SQL for its decisions as a whole (the first
is a trained model), so there is no ORACLE_SQL; the operators' tests hold each stage's decisions against a brute-force
version, and the pipeline's tests follow them through the stages. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm import exact, minhash, mixing, packing, quality
from memloom.llm.common import materialize, prepare, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from ``labels``, rejects go.

    Null and empty texts are scored by the bias alone; repeated rows are judged one by one; other columns pass unread.
    """
    prepare(spark)
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id stays.

    Null texts count as empty and so equal one another; a null doc_id is below all others; of rows that repeat doc_id and
    text one stays.
    """
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Null and empty texts and rows with a null doc_id are alike to nothing and stay; rows that share a doc_id are one
    document and stay or go together.
    """
    prepare(spark)
    return minhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; null and empty texts have size 0; rows that repeat a doc_id are taken row by row.
    """
    prepare(spark)
    return mixing.copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens.

    Null texts are empty and give their end id alone; repeated rows and ids are packed as they come.
    """
    prepare(spark)
    return packing.packed_sequences(docs)


STAGES = [("quality", quality_filter), ("exact", exact_dedup), ("near", near_dedup), ("mix", mix_sources), ("pack", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
