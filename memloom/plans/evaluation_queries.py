"""Metric and score queries: later turns against opening questions, labels and events as score records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from .registry import query, table
from .text_queries import _PAIRS, metric_sql, turn_pairs

_TOKENS = f"WITH p AS ({_PAIRS}), t AS (SELECT conv_id, turn, {metric_sql('memory')} AS p, {metric_sql('question')} AS r FROM p), o AS (SELECT *, len(p) AS np, len(r) AS nr, list_sum(list_transform(list_intersect(list_distinct(p), list_distinct(r)), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))) AS o FROM t)"
_F1 = "CASE WHEN coalesce(o, 0) > 0 THEN round(2 * (o / np::DOUBLE) * (o / nr::DOUBLE) / (o / np::DOUBLE + o / nr::DOUBLE), 6) ELSE 0.0 END"
_BLEU = "CASE WHEN coalesce(o, 0) > 0 THEN round((CASE WHEN np < nr THEN exp(1 - nr / np::DOUBLE) ELSE 1.0 END) * (o / np::DOUBLE), 6) ELSE 0.0 END"


def _pair_tokens(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("conv_id", "turn", T.metric_tokens(F.col("memory")).alias("p"), T.metric_tokens(F.col("question")).alias("r"))


@query(f"{_TOKENS} SELECT conv_id, turn, {_F1} AS f1 FROM o")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    return _pair_tokens(spark, d).select("conv_id", "turn", F.round(E.token_f1(F.col("p"), F.col("r")), 6).alias("f1"))


@query(f"{_TOKENS} SELECT conv_id, turn, {_BLEU} AS bleu FROM o")
def bleu1(spark: SparkSession, d: str) -> DataFrame:
    return _pair_tokens(spark, d).select("conv_id", "turn", F.round(E.bleu1(F.col("p"), F.col("r")), 6).alias("bleu"))


@query(f"""{_TOKENS.replace(metric_sql('memory') + ' AS p', metric_sql('memory') + ' AS r').replace(metric_sql('question') + ' AS r', metric_sql('question') + ' AS p')}, s AS (SELECT conv_id, turn, {_F1} AS f1, {_BLEU} AS bleu FROM o) SELECT conv_id, max(f1) AS f1_score, max(bleu) AS bleu_score FROM s GROUP BY 1""")
def best_of_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each opening question as the prediction, all later turns as candidate answers."""
    turns = turn_pairs(spark, d).groupBy("conv_id", "question").agg(F.collect_list("memory").alias("answers"))
    records = turns.select("conv_id", "question", E.answer_candidates(F.col("answers"), F.array().cast("array<string>")).alias("candidates"))
    best = E.best_of(records, ["conv_id"], "question", "candidates")
    return best.select("conv_id", F.round("f1_score", 6).alias("f1_score"), F.round("bleu_score", 6).alias("bleu_score"))


@query(r"""WITH r AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'said ' || doc_id END AS p FROM labels)
SELECT doc_id, CASE WHEN trim(p) = '' THEN 0.0 ELSE quality::DOUBLE END AS llm_score, CASE WHEN trim(p) = '' THEN quality::DOUBLE ELSE -1.0 END AS llm_score_judge FROM r""")
def empty_rule(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("said "), F.col("doc_id").cast("string")))
    r = table(spark, d, "labels").select("doc_id", said.alias("predicted_answer"), F.lit(None).cast("string").alias("response"), F.col("quality").cast("double").alias("llm_score"), F.lit(None).cast("double").alias("llm_score_judge"))
    return E.apply_empty_rule(r).select("doc_id", "llm_score", F.coalesce("llm_score_judge", F.lit(-1.0)).alias("llm_score_judge"))


_RECORDS = "SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE lang END AS category, CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE source END AS conversation, l.quality::DOUBLE AS llm_score, CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.n_chars::DOUBLE END AS f1_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def score_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents as answer records: language as category, source as conversation, labels as scores with gaps."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    unless = lambda n, c: F.when(F.col("doc_id") % n != 0, c)
    return docs.join(labels, "doc_id", "left").select("doc_id", unless(7, F.col("lang")).alias("category"), unless(11, F.col("source")).alias("conversation"), F.col("quality").cast("double").alias("llm_score"), unless(3, F.col("n_chars").cast("double")).alias("f1_score"))


@query(f"""WITH r AS ({_RECORDS}), l AS (SELECT coalesce(category, '') AS category, conversation, 'llm_score' AS metric, llm_score AS v FROM r UNION ALL SELECT coalesce(category, ''), conversation, 'f1_score', f1_score FROM r),
g AS (SELECT CASE WHEN grouping(category) + grouping(conversation) = 2 THEN 'overall' WHEN grouping(conversation) = 1 THEN 'category' WHEN grouping(category) = 1 THEN 'conversation' ELSE 'conversation_category' END AS scope, grouping(conversation) AS gv, category, conversation, metric, count(*) AS count, count(*) - count(v) AS missing_count, round(coalesce(avg(v), 0), 6) AS mean, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max
FROM l GROUP BY GROUPING SETS ((metric), (metric, category), (metric, conversation), (metric, category, conversation)))
SELECT scope, coalesce(category, '') AS category, coalesce(conversation, '') AS conversation, metric, count, missing_count, mean, min, max FROM g WHERE gv = 1 OR conversation IS NOT NULL""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.score_summary(score_records(spark, d).drop("doc_id")).withColumn("mean", F.round("mean", 6))


@query("""WITH t AS (SELECT CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / CAST(3.2 AS DOUBLE)))::BIGINT END AS v FROM documents), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM t)
SELECT min(v) AS min, max(CASE WHEN i = round_even((n - 1) * CAST(0.5 AS DOUBLE), 0) THEN v END) AS p50, max(CASE WHEN i = round_even((n - 1) * CAST(0.9 AS DOUBLE), 0) THEN v END) AS p90, max(v) AS max, round(avg(v), 1) AS mean FROM r""")
def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select(T.token_estimate(F.col("text")).alias("tokens"))
    return E.nearest_rank(tokens, "tokens", {"p50": 0.5, "p90": 0.9})


@query("""WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT min(v) AS min, max(CASE WHEN i = round_even((n - 1) * CAST(0.05 AS DOUBLE), 0) THEN v END) AS p5, max(CASE WHEN i = round_even((n - 1) * CAST(0.5 AS DOUBLE), 0) THEN v END) AS p50, max(CASE WHEN i = round_even((n - 1) * CAST(0.99 AS DOUBLE), 0) THEN v END) AS p99, max(v) AS max, round(avg(v), 1) AS mean FROM r""")
def price_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return E.nearest_rank(table(spark, d, "lineitem"), "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p99": 0.99})


@query("WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS total FROM documents) SELECT doc_id, n_chars FROM r WHERE rn % greatest(1, total // 16) = 0 AND rn // greatest(1, total // 16) < 16")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return E.systematic_sample(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 16).select("doc_id", "n_chars")


@query("SELECT count(*) FILTER (WHERE quality = 1) AS correct, count(*) - count(*) FILTER (WHERE quality = 1) AS wrong, round(count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE, 6) AS accuracy FROM labels")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.accuracy(table(spark, d, "labels"), "quality")


@query("""SELECT conv_id AS conversation, 0 AS qa_index, max(CASE WHEN turn = 0 THEN text END) AS question, max(CASE WHEN turn = 0 THEN role END) AS category, coalesce(max(CASE WHEN turn = 1 THEN text END), '') AS prediction, count(*) FILTER (WHERE turn > 1 AND trim(text) <> '') AS memory_count, count(*)::DOUBLE AS llm_score FROM conversations GROUP BY 1""")
def flatten_eval(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    at = lambda n, x: F.max(F.when(F.col("turn") == n, F.col(x)))
    r = c.groupBy(F.col("conv_id").alias("conversation")).agg(
        F.lit(0).alias("qa_index"), at(0, "text").alias("question"), at(0, "role").alias("category"), at(1, "text").alias("predicted_answer"), F.lit(None).cast("string").alias("response"),
        F.lit(None).cast("array<string>").alias("selected"), F.collect_list(F.when((F.col("turn") > 1) & (F.col("turn") % 2 == 0), F.col("text"))).alias("selected_a"), F.collect_list(F.when((F.col("turn") > 1) & (F.col("turn") % 2 == 1), F.col("text"))).alias("selected_b"),
        F.count(F.lit(1)).cast("double").alias("llm_score"),
    )
    return E.flatten(r)
