"""Memory tables over documents: a source is a user, a document a put of one of its memories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.tables import MemoryTable
from .registry import query, table

#: The user that is cleared after the second of three batches.
CLEARED = "src3"


def memory_table(spark: SparkSession, d: str) -> MemoryTable:
    """Every document put in three batches (by id modulo 3) with a clearing between, a compaction and embeddings of what has none."""
    docs = table(spark, d, "documents").select(
        F.col("source").alias("user_id"),
        F.concat_ws("-", "lang", F.pmod("doc_id", F.lit(100)).cast("string")).alias("id"),
        F.lit("SHORT").alias("status"),
        F.lit(0).alias("level"),
        F.col("text").alias("summary"),
        F.timestamp_seconds("doc_id").alias("created_at"),
        F.timestamp_seconds("doc_id").alias("updated_at"),
        F.pmod("doc_id", F.lit(3)).alias("batch"),
        F.when(F.length("text") % 2 == 0, F.array(F.length("text").cast("float"))).alias("embedding"),
    )
    t = MemoryTable(spark, f"{shared_folder(spark)}/memloom/memories-{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions")))
    for batch in range(3):
        t.upsert(docs.where(F.col("batch") == batch).drop("batch"))
        if batch == 1:
            t.clear_user(CLEARED)
            t.compact()
    t.backfill(lambda text: F.array(F.lit(-1.0).cast("float")))
    return t


_PUTS = f"""p AS (SELECT source AS user_id, concat_ws('-', lang, (doc_id % 100)::VARCHAR) AS id, doc_id, doc_id % 3 AS batch, length(text) AS n FROM documents WHERE NOT (source = '{CLEARED}' AND doc_id % 3 < 2)),
m AS (SELECT user_id, id, arg_max(n, (batch, doc_id)) AS n_chars, min(doc_id) AS created, arg_max(doc_id, (batch, doc_id)) AS updated, arg_min(n, (batch, doc_id)) AS first_n FROM p GROUP BY ALL)"""


@query(f"WITH {_PUTS} SELECT user_id, id, n_chars, created, CASE WHEN first_n % 2 = 0 AND first_n > 0 THEN updated ELSE -1 END AS updated, CASE WHEN first_n % 2 = 0 THEN first_n::DOUBLE ELSE -1 END AS embedding FROM m")
def memory_table_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = memory_table(spark, d).read()
    # filling an embedding in counts as an update of now
    updated = F.when(F.col("embedding")[0] > 0, F.unix_timestamp("updated_at")).otherwise(F.lit(-1))
    return rows.select("user_id", "id", F.length("summary").cast("long").alias("n_chars"), F.unix_timestamp("created_at").alias("created"), updated.cast("long").alias("updated"), F.col("embedding")[0].cast("double").alias("embedding"))


@query(f"WITH {_PUTS} SELECT user_id, count(*) AS memories, sum(n_chars)::BIGINT AS n_chars, max(created) AS last_created FROM m GROUP BY 1")
def memory_table_users(spark: SparkSession, d: str) -> DataFrame:
    """By user: neither the merge nor the grouping shuffles."""
    rows = memory_table(spark, d).read()
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("memories"), F.sum(F.length("summary")).cast("long").alias("n_chars"), F.max(F.unix_timestamp("created_at")).alias("last_created"))


@query(f"WITH {_PUTS} SELECT id, n_chars, row_number() OVER (ORDER BY created, id) AS place FROM m WHERE user_id = '{CLEARED}'")
def memory_table_one_user(spark: SparkSession, d: str) -> DataFrame:
    """One user's memories in order of creation, from one bucket."""
    rows = memory_table(spark, d).read(CLEARED)
    order = F.sort_array(F.collect_list(F.struct("created_at", "id", F.length("summary").cast("long").alias("n_chars"))))
    placed = rows.groupBy("user_id").agg(order.alias("m")).select(F.posexplode("m").alias("place", "m"))
    return placed.select("m.id", "m.n_chars", (F.col("place") + 1).cast("long").alias("place"))
