"""Op 3. Exact dedup: 128-bit content hash groups whose bytes are compared (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Text with A-Z (nothing else) in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def exact_classes(docs: DataFrame, content_hash=F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest doc_id of equal texts stays. Grouping is by
    (128-bit hash, bytes), so a hash collision can't join different texts, and each map task hands on one row per
    text it holds, so a group of any size stays small. The rows then find their class by hash alone; only classes
    that share a hash with another are told apart by SHA-256. Rows that repeat a doc_id count one by one; a null
    doc_id is below all others; null text is empty.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    keyed = keyed.select("doc_id", "norm", content_hash("norm").alias("h"))
    classes = keyed.groupBy("h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.select("h", F.struct("keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")).alias("c"))
    by_hash = classes.groupBy("h").agg(F.max("c").alias("c"), F.count(F.lit(1)).alias("texts"))
    rows = keyed.select("doc_id", "h", F.sha2("norm", 256).alias("sha"))
    plain = rows.join(by_hash.where("texts = 1"), "h").select("doc_id", "c")
    collided = by_hash.where("texts > 1").select("h")
    # for texts whose 128-bit hashes collide
    others = classes.join(collided, "h").select("h", F.col("c.text_sha256").alias("sha"), "c")
    rest = rows.join(others, ["h", "sha"]).select("doc_id", "c")
    return plain.union(rest).select("doc_id", "c.keep_id", "c.group_size", F.col("doc_id").eqNullSafe(F.col("c.keep_id")).alias("kept"), "c.text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all their columns) that stay; of rows that repeat doc_id and text the one with the largest hash of its columns."""
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    best = docs.select(normalised(F.col("text")).alias("norm"), F.struct(F.col("doc_id").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("tie")).alias("by"), whole.alias("row"))
    best = best.groupBy(F.md5("norm").alias("h"), "norm").agg(F.max_by("row", "by").alias("row"))
    return best.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""
