"""Retrieval queries: conversations' opening questions over their later turns, and embeddings by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval as R
from .registry import duck_values, inline, query, table
from .text_queries import content_sql


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("qid"), "text")


def memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("turn > 0").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("key"), "text")


BM25_CTE = f"""
tok AS (SELECT conv_id, turn, {content_sql('text')} AS ts FROM conversations),
mem AS (SELECT * FROM tok WHERE turn > 0),
corpus AS (SELECT conv_id, count(*) AS n, avg(CAST(len(ts) AS DOUBLE)) AS avgdl FROM mem GROUP BY 1),
tf AS (SELECT conv_id, turn, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM (SELECT conv_id, turn, CAST(len(ts) AS DOUBLE) AS dl, unnest(ts) AS term FROM mem) GROUP BY ALL),
dfq AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT d.conv_id, term, ln(CAST(n - df AS DOUBLE) + CAST(0.5 AS DOUBLE)) - ln(CAST(df AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS raw, avgdl FROM dfq d JOIN corpus c ON d.conv_id = c.conv_id),
idf AS (SELECT conv_id, term, CASE WHEN raw < 0 THEN CAST(0.25 AS DOUBLE) * avg(raw) OVER (PARTITION BY conv_id) ELSE raw END AS idf, avgdl FROM raw),
ask AS (SELECT conv_id, term, CAST(count(*) AS DOUBLE) AS times FROM (SELECT conv_id, unnest(ts) AS term FROM tok WHERE turn = 0) GROUP BY ALL),
bm AS (SELECT a.conv_id, t.turn, sum(times * idf * (tf * CAST(2.5 AS DOUBLE) / (tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl)))) AS bm25
  FROM ask a JOIN idf i ON a.conv_id = i.conv_id AND a.term = i.term JOIN tf t ON a.conv_id = t.conv_id AND a.term = t.term GROUP BY ALL HAVING bm25 > 0)"""


@query(f"WITH {BM25_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(bm25, 9) DESC, turn) AS rank FROM bm) SELECT conv_id, turn, round(bm25, 6) AS bm25, rank FROM r WHERE rank <= 3")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    top = R.bm25_topk(questions(spark, d), memories(spark, d), 3)
    return top.select(F.col("user_id").alias("conv_id"), F.col("key").alias("turn"), F.round("bm25", 6).alias("bm25"), "rank")


def dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("label").alias("user_id"), F.col("vec_id").alias("qid"), "embedding")
    return q, e.select(F.col("label").alias("user_id"), F.col("vec_id").alias("key"), "embedding")


_COS = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[]))"


@query(f"""WITH s AS (SELECT q.vec_id AS qid, m.vec_id AS key, {_COS} AS c FROM embeddings q JOIN embeddings m ON q.label = m.label WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, key) AS rank FROM s) SELECT qid, key, round(c, 6) AS cosine, rank FROM r WHERE rank <= 10""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.cosine_topk(*dense(spark, d), 10).select("qid", "key", F.round("cosine", 6).alias("cosine"), "rank")


@query(f"""WITH {BM25_CTE}, b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY round(bm25, 9) DESC, turn) AS rank FROM bm),
lx AS (SELECT q.conv_id, m.turn, CASE WHEN len(q.ts) > 0 THEN len(list_intersect(list_distinct(q.ts), list_distinct(m.ts))) / len(list_distinct(q.ts))::DOUBLE ELSE 0.0 END AS score FROM tok q JOIN mem m ON q.conv_id = m.conv_id WHERE q.turn = 0),
l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM lx),
f AS (SELECT conv_id, turn, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS rrf FROM (SELECT * FROM b WHERE rank <= 10 UNION ALL SELECT * FROM l WHERE rank <= 10) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(rrf, 12) DESC, turn) AS rank FROM f) SELECT conv_id, turn, round(rrf, 9) AS rrf, rank FROM r WHERE rank <= 4""")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    q, m = questions(spark, d), memories(spark, d)
    fused = R.rrf([R.bm25_topk(q, m, 10), R.lexical_topk(q, m, 10)])
    top = R.top_k(fused, ["user_id", "qid"], [F.round("rrf", 12).desc(), F.col("key")], 4)
    return top.select(F.col("user_id").alias("conv_id"), F.col("key").alias("turn"), F.round("rrf", 9).alias("rrf"), "rank")


def with_vectors(df: DataFrame, spark: SparkSession, d: str, key: str) -> DataFrame:
    """Give turns a stand-in embedding: that of the vector whose id is 7 times the conversation plus the turn, where it exists."""
    e = table(spark, d, "embeddings").select((F.col("vec_id")).alias("v"), "embedding")
    return df.join(e, F.col("user_id") * 7 + F.col(key) == F.col("v"), "left").drop("v")


_VEC = "LEFT JOIN embeddings e ON e.vec_id = c.conv_id * 7 + c.turn"


@query(f"""WITH {BM25_CTE}, b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY round(bm25, 9) DESC, turn) AS rank FROM bm),
v AS (SELECT c.conv_id, c.turn, e.embedding FROM conversations c {_VEC}),
cs AS (SELECT q.conv_id, m.turn, {_COS} AS c FROM v q JOIN v m ON q.conv_id = m.conv_id WHERE q.turn = 0 AND m.turn > 0 AND q.embedding IS NOT NULL AND m.embedding IS NOT NULL),
dn AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY round(c, 9) DESC, turn) AS rank FROM cs),
f AS (SELECT conv_id, turn, sum(CAST(1 AS DOUBLE) / (60 + rank)) AS rrf FROM (SELECT * FROM b WHERE rank <= 80 UNION ALL SELECT * FROM dn WHERE rank <= 80) GROUP BY ALL),
r AS (SELECT conv_id, turn, rrf, row_number() OVER (PARTITION BY conv_id ORDER BY round(rrf, 12) DESC, turn) AS rank FROM f),
lx AS (SELECT q.conv_id, m.turn, CASE WHEN len(q.ts) > 0 THEN len(list_intersect(list_distinct(q.ts), list_distinct(m.ts))) / len(list_distinct(q.ts))::DOUBLE ELSE 0.0 END AS score FROM tok q JOIN mem m ON q.conv_id = m.conv_id WHERE q.turn = 0 AND q.conv_id NOT IN (SELECT conv_id FROM f)),
l AS (SELECT conv_id, turn, CAST(0 AS DOUBLE) AS rrf, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM lx)
SELECT conv_id, turn, round(rrf, 9) AS rrf, rank FROM (SELECT * FROM r UNION ALL SELECT * FROM l) WHERE rank <= 3""")
def hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    got = R.hybrid_recall(with_vectors(questions(spark, d), spark, d, "qid"), with_vectors(memories(spark, d), spark, d, "key"), 3)
    return got.select(F.col("user_id").alias("conv_id"), F.col("key").alias("turn"), F.round("rrf", 9).alias("rrf"), "rank")


@query(f"""WITH {BM25_CTE}, b AS (SELECT conv_id, turn, bm25, row_number() OVER (PARTITION BY conv_id ORDER BY round(bm25, 9) DESC, turn) AS rank FROM bm),
v AS (SELECT c.conv_id, c.turn, e.embedding FROM conversations c {_VEC}),
cs AS (SELECT q.conv_id, m.turn, {_COS} AS c FROM v q JOIN v m ON q.conv_id = m.conv_id WHERE q.turn = 0 AND m.turn > 0 AND q.embedding IS NOT NULL AND m.embedding IS NOT NULL),
dn AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(c, 9) DESC, turn) AS rank FROM cs)
SELECT coalesce(b.conv_id, d.conv_id) AS conv_id, coalesce(b.turn, d.turn) AS turn, coalesce(round(bm25, 6), -1) AS bm25, coalesce(round(c, 6), -1) AS dense FROM (SELECT * FROM b WHERE rank <= 3) b FULL JOIN (SELECT * FROM dn WHERE rank <= 3) d ON b.conv_id = d.conv_id AND b.turn = d.turn""")
def channel_scores(spark: SparkSession, d: str) -> DataFrame:
    q, m = with_vectors(questions(spark, d), spark, d, "qid"), with_vectors(memories(spark, d), spark, d, "key")
    both = R.channel_scores(R.bm25_topk(q, m, 3), R.cosine_topk(q, m, 3))
    return both.select(F.col("user_id").alias("conv_id"), F.col("key").alias("turn"), F.coalesce(F.round("bm25", 6), F.lit(-1.0)).alias("bm25"), F.coalesce(F.round("cosine", 6), F.lit(-1.0)).alias("dense"))


@query(f"""WITH tok AS (SELECT conv_id, turn, list_distinct({content_sql('text')}) AS ts FROM conversations),
lx AS (SELECT q.conv_id, m.turn, CASE WHEN len(q.ts) > 0 THEN len(list_intersect(q.ts, m.ts)) / len(q.ts)::DOUBLE ELSE 0.0 END AS score FROM tok q JOIN tok m ON q.conv_id = m.conv_id WHERE q.turn = 0 AND m.turn > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM lx) SELECT conv_id, turn, round(score, 6) AS score, rank FROM r WHERE rank <= 3""")
def lexical_fallback(spark: SparkSession, d: str) -> DataFrame:
    top = R.lexical_topk(questions(spark, d), memories(spark, d), 3)
    return top.select(F.col("user_id").alias("conv_id"), F.col("key").alias("turn"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH s AS (SELECT q.label AS user_id, q.vec_id AS qid, m.vec_id AS key, {_COS} AS c FROM embeddings q JOIN embeddings m ON q.label = m.label AND q.vec_id <> m.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(c, 9) DESC, key) AS rank FROM s) SELECT user_id, count(*) AS selected, round(avg(c), 6) AS mean_cosine FROM r WHERE rank <= 5 GROUP BY 1""")
def rag_topk_per_user(spark: SparkSession, d: str) -> DataFrame:
    q, m = dense(spark, d)
    pairs = R.cosine_topk(q, m, 5 + 1).where("qid <> key").drop("rank")  # a question may find itself
    top = R.top_k(pairs, ["user_id", "qid"], [F.round("cosine", 9).desc(), F.col("key")], 5)
    return top.groupBy("user_id").agg(F.count(F.lit(1)).alias("selected"), F.round(F.avg("cosine"), 6).alias("mean_cosine"))


_QA = [
    (1, "Would she go?", "1", "", 0), (2, "Could it be?", "", "", 0), (3, "Why?", "3", "", 0), (4, "Order these", "1", "Ordering", 0), (5, "Pick one", "1", "single_choice", 4), (6, "Which of these", "1", "", 0),
    (7, "How many pets?", "1", "", 0), (8, "What did she read because of him?", "1", "", 0), (9, "When did friends and family come?", "1", "", 0), (10, "When did it rain?", "1", "", 1), (11, " would this count", "2", "", 0),
]


def _any_sql(markers: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(q, '" + m.replace("'", "''") + "')" for m in markers) + ")"


@query(f"""SELECT id, CASE WHEN trim(category) = '3' OR starts_with(q, 'would ') OR starts_with(q, 'could ') THEN 'inference' WHEN lower(trim(qa_type)) IN ('multi_select', 'ordering') THEN 'structured_list'
 WHEN n_options > 1 THEN 'options' WHEN {_any_sql(R.LIST_MARKERS)} THEN 'list' WHEN {_any_sql(R.BRIDGE_MARKERS)} THEN 'bridge' WHEN contains(q, ' and ') AND {_any_sql(R.COMPOUND_MARKERS)} THEN 'compound' ELSE '' END AS gate
 FROM (SELECT *, lower(trim(question)) AS q FROM {duck_values(_QA, 'id, question, category, qa_type, n_options')})""")
def multihop_gate(spark: SparkSession, d: str) -> DataFrame:
    qa = inline(spark, _QA, "id int, question string, category string, qa_type string, n_options int")
    return qa.select("id", R.multihop_gate(F.col("question"), F.col("category"), F.col("qa_type"), F.col("n_options")).alias("gate"))


_HOPS = f"""WITH {BM25_CTE}, b AS (SELECT conv_id, turn, bm25 AS score, 1 AS hop, row_number() OVER (PARTITION BY conv_id ORDER BY round(bm25, 9) DESC, turn) AS rank FROM bm),
lx AS (SELECT q.conv_id, m.turn, CASE WHEN len(q.ts) > 0 THEN len(list_intersect(list_distinct(q.ts), list_distinct(m.ts))) / len(list_distinct(q.ts))::DOUBLE ELSE 0.0 END AS score FROM tok q JOIN mem m ON q.conv_id = m.conv_id WHERE q.turn = 0),
l AS (SELECT conv_id, turn, score, 2 AS hop, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS rank FROM lx),
h AS (SELECT * FROM b WHERE rank <= 2 UNION ALL SELECT * FROM l WHERE rank <= 3),
g AS (SELECT conv_id, turn, min(hop * 1000 + rank) AS first, max(score) AS score FROM h GROUP BY ALL), r AS (SELECT conv_id, turn, score, row_number() OVER (PARTITION BY conv_id ORDER BY first, turn) AS rank FROM g)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    q, m = questions(spark, d), memories(spark, d)
    one = R.bm25_topk(q, m, 2).select("user_id", "qid", F.lit(1).alias("hop"), "rank", "key", F.col("bm25").alias("score"))
    two = R.lexical_topk(q, m, 3).select("user_id", "qid", F.lit(2).alias("hop"), "rank", "key", "score")
    return R.multihop_merge(one.unionByName(two), 4)


@query(_HOPS + " SELECT conv_id, turn, round(score, 6) AS score, rank FROM r WHERE rank <= 4")
def multihop_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).select(F.col("user_id").alias("conv_id"), F.col("key").alias("turn"), F.round("score", 6).alias("score"), "rank")


@query(_HOPS + " SELECT r.conv_id, string_agg(r.turn || ':' || c.text, '|' ORDER BY rank) AS selected, count(*) AS n FROM r JOIN conversations c ON r.conv_id = c.conv_id AND r.turn = c.turn WHERE rank <= 4 GROUP BY 1")
def retrieval_payload(spark: SparkSession, d: str) -> DataFrame:
    block = R.payload(_merged(spark, d), memories(spark, d)).where("success")
    line = F.transform("selected", lambda m: F.concat(m["id"].cast("string"), F.lit(":"), m["text"]))
    return block.select(F.col("user_id").alias("conv_id"), F.array_join(line, "|").alias("selected"), F.size("selected").cast("long").alias("n"))


_PLAIN = "list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda t: lower(t))"


@query(f"""WITH t AS (SELECT conv_id, turn, {_PLAIN} AS ts FROM conversations), p AS (SELECT i.conv_id, i.turn AS item, f.turn AS fact, len(list_intersect(list_distinct(i.ts), list_distinct(f.ts))) AS overlap, len(f.ts) AS n FROM t i JOIN t f ON i.conv_id = f.conv_id WHERE i.turn = 0 AND f.turn > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, item ORDER BY CASE WHEN overlap > 0 THEN 0 ELSE 1 END, CASE WHEN overlap > 0 THEN -overlap END NULLS LAST, CASE WHEN overlap > 0 THEN n END NULLS LAST, fact) AS rank FROM p) SELECT conv_id, item, fact, overlap, rank FROM r WHERE rank <= 4""")
def support_facts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    items = c.where("turn = 0").select(F.col("conv_id").alias("group"), F.col("turn").alias("item"), "text")
    facts = c.where("turn > 0").select(F.col("conv_id").alias("group"), F.col("turn").alias("fact"), F.col("turn").alias("pos"), "text")
    return R.support_facts(items, facts, 4).withColumnRenamed("group", "conv_id")
