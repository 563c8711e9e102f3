"""Queries of the ports and the session fold: no SQL twin, tested against plain Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import session_fold as S
from .flow import Flow
from .registry import query, table
from .retrieval_queries import memories, questions


def session_facts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations' turns as facts, two turns a session."""
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("user_id"), (F.floor(F.col("turn") / 2) + 1).alias("session"), F.col("turn").alias("arrival"), F.col("text"), F.when(F.col("turn") % 3 == 0, "plan").otherwise("event").alias("type"))


@query()
def session_fold(spark: SparkSession, d: str) -> DataFrame:
    """Operations of all sessions, folded in order per conversation."""
    return S.batch_fold(session_facts(spark, d))


@query()
def stub_answers(spark: SparkSession, d: str) -> DataFrame:
    """Search and answer with the offline stand-ins, hybrid backend."""
    flow = Flow()
    found = flow.search(questions(spark, d), flow.add(memories(spark, d)))
    return flow.answer(found).select("user_id", "qid", "success", "predicted_answer")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of event time, in batch; the same function runs on a stream."""
    w = S.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
