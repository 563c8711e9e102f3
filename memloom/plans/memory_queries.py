"""Memory-merge queries. Documents are memories of their source: twenty ids of forty form the old table, the others are new facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory as M
from .registry import duck_values, inline, query, table
from .text_queries import words_sql

#: A fact is a whole document: copies and shared passages make known, related and new ones.
_FACT = "trim(text)"


def old_memories(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 40 < 20")
    none = F.lit("")
    return docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("id"), F.trim("text").alias("text"), F.lit("ADD").alias("event"), none.alias("anchor_time"), none.alias("event_anchor"), F.col("lang").alias("type"))


def new_facts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id % 40 >= 20")
    kind = F.when(F.col("doc_id") % 3 == 0, "plan").otherwise("event")
    return docs.select(F.col("source").alias("user_id"), F.col("doc_id").alias("arrival"), F.trim("text").alias("text"), kind.alias("type"), F.lit("2023-05-08").alias("anchor_time"))


_DECIDE = f"""WITH o AS (SELECT source AS user_id, doc_id AS pos, {_FACT} AS text, list_distinct({words_sql(_FACT)}) AS ts FROM documents WHERE doc_id % 40 < 20 AND {_FACT} <> ''),
f AS (SELECT source AS user_id, doc_id AS arrival, {_FACT} AS text, lower({_FACT}) AS low, list_distinct({words_sql(_FACT)}) AS ts, doc_id % 3 = 0 AS plan FROM documents WHERE doc_id % 40 >= 20 AND {_FACT} <> ''),
fresh AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = f.user_id AND lower(o.text) = f.low)),
p AS (SELECT f.user_id, arrival, o.pos, CASE WHEN len(f.ts) > 0 AND len(o.ts) > 0 THEN len(list_intersect(f.ts, o.ts)) / len(list_distinct(list_concat(f.ts, o.ts)))::DOUBLE ELSE 0.0 END AS score, len(list_filter(f.ts, lambda x: NOT list_contains(o.ts, x))) AS added FROM fresh f JOIN o ON f.user_id = o.user_id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, arrival ORDER BY score DESC, pos) AS r FROM p WHERE score > 0) WHERE r = 1),
d0 AS (SELECT f.user_id, f.arrival, f.text, f.low, b.pos AS target, b.score, CASE WHEN score >= 0.92 THEN 'NONE' WHEN score >= 0.7 AND (score >= 0.75 AND added >= 2 OR plan) THEN 'UPDATE' ELSE 'ADD' END AS decision FROM fresh f LEFT JOIN b ON f.user_id = b.user_id AND f.arrival = b.arrival),
d1 AS (SELECT *, CASE WHEN max(CASE WHEN decision = 'ADD' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, low ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 'NONE' ELSE decision END AS dec FROM d0),
u AS (SELECT user_id, target::VARCHAR AS id, text, 'UPDATE' AS event FROM (SELECT *, row_number() OVER (PARTITION BY user_id, target ORDER BY score DESC, arrival) AS r FROM d1 WHERE dec = 'UPDATE') WHERE r = 1),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrival) AS k FROM d1 WHERE dec = 'ADD'),
n AS (SELECT user_id, count(*) AS n FROM a GROUP BY 1), m AS (SELECT user_id, count(*) AS m FROM o GROUP BY 1),
s AS (SELECT n.user_id, n.n, unnest(range(0, n.n + coalesce(m.m, 0) + 1)) AS number FROM n LEFT JOIN m ON n.user_id = m.user_id),
free AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY number) AS k FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = s.user_id AND o.pos = s.number))"""
_OPS = " UNION ALL SELECT a.user_id, free.number::VARCHAR AS id, a.text, 'ADD' AS event FROM a JOIN free ON a.user_id = free.user_id AND a.k = free.k"


@query(f"{_DECIDE} SELECT * FROM u{_OPS}")
def decide_ops(spark: SparkSession, d: str) -> DataFrame:
    return M.decide(old_memories(spark, d), new_facts(spark, d), with_time=False).select("user_id", "id", "text", "event")


@query()
def decide_ops_sequence(spark: SparkSession, d: str) -> DataFrame:
    """The same with the full similarity, a sequence ratio or the Jaccard, and with resolved times."""
    return M.decide(old_memories(spark, d), new_facts(spark, d), M.sequence_similarity).select("user_id", "seq", "id", "text", "event")


@query(f"""{_DECIDE}, ops AS (SELECT * FROM u{_OPS}), om AS (SELECT user_id, pos::VARCHAR AS id, text FROM o)
SELECT coalesce(om.user_id, ops.user_id) AS user_id, coalesce(om.id, ops.id) AS id, coalesce(ops.text, om.text) AS text, CASE WHEN om.id IS NULL THEN 'ADD' WHEN ops.id IS NOT NULL THEN 'UPDATE' ELSE 'ADD' END AS event, ops.id IS NOT NULL AS written
FROM om FULL JOIN ops ON om.user_id = ops.user_id AND om.id = ops.id""")
def apply_delta(spark: SparkSession, d: str) -> DataFrame:
    old = old_memories(spark, d)
    ops = M.decide(old, new_facts(spark, d), with_time=False).withColumns({"event_anchor": F.lit(""), "type": F.lit("")})
    return M.apply_delta(old, ops).select("user_id", "id", "text", "event", "written")


@query("""WITH ids AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN (event_id % 40)::VARCHAR WHEN 1 THEN '0' || event_id % 40 WHEN 2 THEN event_type ELSE (event_id % 7)::VARCHAR END AS id FROM events),
used AS (SELECT user_id, try_cast(id AS BIGINT) AS n FROM ids WHERE id = try_cast(id AS BIGINT)::VARCHAR), wanted AS (SELECT user_id, count(*) % 6 AS n FROM events GROUP BY 1 UNION ALL SELECT DISTINCT -1 - user_id, 3 FROM events),
s AS (SELECT user_id, n AS want, unnest(range(0, 50)) AS number FROM wanted), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY number) AS k FROM s WHERE NOT EXISTS (SELECT 1 FROM used WHERE used.user_id = s.user_id AND used.n = number))
SELECT user_id, k, number::VARCHAR AS id FROM f WHERE k <= want""")
def alloc_ids(spark: SparkSession, d: str) -> DataFrame:
    """Users' events hold numbers, numbers with a leading zero and words as ids; users without events want ids too."""
    e = table(spark, d, "events")
    kind, text = F.col("event_id") % 4, lambda n: (F.col("event_id") % n).cast("string")
    used = e.select("user_id", F.when(kind == 0, text(40)).when(kind == 1, F.concat(F.lit("0"), text(40))).when(kind == 2, F.col("event_type")).otherwise(text(7)).alias("id"))
    wanted = e.groupBy("user_id").agg((F.count(F.lit(1)) % 6).alias("n")).unionByName(e.select((-1 - F.col("user_id")).alias("user_id"), F.lit(3).cast("long").alias("n")).distinct())
    return M.free_ids(used, wanted)


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY ALL""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("version"), "value", F.col("ts").alias("created_at"))
    half = F.col("version.ts") < F.lit("2024-01-15").cast("timestamp")
    merged = M.upsert_latest(e.where(half), e.where(~half), ["user_id", "event_type"], "version")
    return merged.select("user_id", "event_type", "value", "created_at", F.col("version.ts").alias("updated_at"))


@query("SELECT e.vec_id AS id, CASE WHEN e.vec_id % 3 = 0 THEN 0 ELSE len(embedding) END AS dims FROM embeddings e")
def invalidate_embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("label").alias("user_id"), F.col("vec_id").alias("id"), "embedding")
    ops = e.where("id % 3 = 0").select("user_id", "id", F.lit("UPDATE").alias("event")).union(e.where("id % 3 = 1").select("user_id", "id", F.lit("ADD")))
    return M.invalidate_embeddings(e, ops).select("id", F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("dims"))


@query("""WITH new AS (SELECT source AS user_id, doc_id % 400 AS id, doc_id AS pos, lang AS text FROM documents WHERE doc_id % 2 = 1), n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY pos) AS r FROM new) WHERE r = 1),
old AS (SELECT source AS user_id, doc_id % 397 AS id, doc_id AS pos, 'old' AS text FROM documents WHERE doc_id % 2 = 0), o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, id ORDER BY pos) AS r FROM old) WHERE r = 1), b AS (SELECT user_id, id, pos, text, 0 AS side FROM n1 UNION ALL SELECT user_id, id, pos, text, 1 FROM o1 WHERE NOT EXISTS (SELECT 1 FROM n1 WHERE n1.user_id = o1.user_id AND n1.id = o1.id))
SELECT user_id, id, text, row_number() OVER (PARTITION BY user_id ORDER BY side, pos) - 1 AS pos FROM b""")
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    new = docs.where("doc_id % 2 = 1").select(F.col("source").alias("user_id"), (F.col("doc_id") % 400).alias("id"), F.col("doc_id").alias("pos"), F.col("lang").alias("text"))
    old = docs.where("doc_id % 2 = 0").select(F.col("source").alias("user_id"), (F.col("doc_id") % 397).alias("id"), F.col("doc_id").alias("pos"), F.lit("old").alias("text"))
    return M.snapshot_merge(new, old)


@query("""WITH o AS (SELECT conv_id AS user_id, turn, lower(trim(text)) AS low FROM conversations WHERE turn % 2 = 0), l AS (SELECT conv_id AS user_id, turn AS pos, trim(text) AS text, lower(trim(text)) AS low FROM conversations WHERE turn % 2 = 1 AND trim(text) <> ''),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, low ORDER BY pos) AS r FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = l.user_id AND o.low = l.low)) WHERE r = 1), t AS (SELECT user_id, max(turn) AS top FROM o GROUP BY 1)
SELECT n.user_id, (coalesce(top, -1) + row_number() OVER (PARTITION BY n.user_id ORDER BY pos))::VARCHAR AS id, n.text FROM n LEFT JOIN t ON n.user_id = t.user_id""")
def fallback_add(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "user_id")
    old = c.where("turn % 2 = 0").select("user_id", F.col("turn").cast("string").alias("id"), "text")
    return M.append_unknown(old, c.where("turn % 2 = 1").select("user_id", F.col("turn").alias("pos"), "text"))


@query(f"""WITH o AS (SELECT source AS user_id, doc_id::VARCHAR AS id, list_distinct({words_sql(_FACT)}) AS ts FROM documents WHERE doc_id % 40 < 20), f AS (SELECT source AS user_id, doc_id AS arrival, list_distinct({words_sql(_FACT)}) AS ts FROM documents WHERE doc_id % 40 >= 20),
p AS (SELECT f.user_id, arrival, id, CASE WHEN len(f.ts) > 0 AND len(o.ts) > 0 THEN len(list_intersect(f.ts, o.ts)) / len(list_distinct(list_concat(f.ts, o.ts)))::DOUBLE ELSE 0.0 END AS s FROM f JOIN o ON f.user_id = o.user_id), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, arrival ORDER BY s DESC, id) AS rank FROM p)
SELECT arrival, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 3""")
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    got = M.candidates(new_facts(spark, d), old_memories(spark, d), M.jaccard_similarity, 3)
    return got.select("arrival", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("SELECT conv_id AS user_id, turn AS session, coalesce(array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '|'), '') AS history FROM conversations")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "conversations").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("session"), "text")
    return M.history(s).select("user_id", "session", F.array_join("history", "|").alias("history"))


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'error') SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::VARCHAR ELSE event_id::VARCHAR END AS id FROM e""")
def active_memories(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    event = F.when(F.col("event_type") == "error", "delete").otherwise("ADD")
    m = e.select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).alias("id"), event.alias("event"), F.col("event_type").alias("text"))
    return M.active(m).select("user_id", F.col("pos").alias("event_id"), "id")


_SLOT_ROWS = [
    ("u1", 0, "0", "Caroline is a single parent and likes the pride parade."), ("u1", 1, "1", "Melanie has a small black cat named Oliver."), ("u1", 2, "2", "Luna is Melanie's dog and she also has a support group."),
    ("u1", 3, "4", "Melanie bought a red bowl and two blue cups, some shoes yesterday."), ("u1", 4, "5", "Melanie's known pets are Oliver."), ("u2", 0, "a", "Caroline recommends 'Becoming Nicole'."), ("u2", 1, "b", "Melanie is reading the book Caroline recommended."),
    ("u2", 2, "c", "Counseling is the career; mental health for trans people."), ("u2", 3, "d", "The concert featured Matt Patterson."), ("u3", 0, "0", "nothing"),
]
_SLOT_EXPECTED = [
    ("u1", "3", "Caroline's relationship status is single.", "ADD", "2023-05-08"), ("u1", "5", "Melanie's known pets are Oliver and Luna.", "UPDATE", "2023-05-08"), ("u1", "6", "Melanie has bought red bowl and some shoes.", "ADD", "2023-05-08"),
    ("u1", "7", "Caroline's LGBTQ community participation includes support groups and pride parades.", "ADD", "2023-05-08"), ("u2", "0", "Caroline's career path is counseling or mental health work for transgender/LGBTQ people.", "ADD", "2023-05-08"),
    ("u2", "1", "Melanie has seen musical artists or bands including Matt Patterson.", "ADD", "2023-05-08"), ("u2", "2", "The book Melanie read from Caroline's recommendation is 'Becoming Nicole'.", "ADD", "2023-05-08"),
]


@query(f"SELECT * FROM {duck_values(_SLOT_EXPECTED, 'user_id, id, text, event, anchor_time')}")
def slot_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Derived rows of the slots, against rows worked out by hand from the rules."""
    rows = inline(spark, _SLOT_ROWS, "user_id string, pos long, id string, text string").withColumn("anchor_time", F.lit(""))
    anchors = rows.select("user_id").distinct().withColumn("anchor_time", F.lit("2023-05-08"))
    return M.slot_operations(rows, anchors).select("user_id", "id", "text", "event", "anchor_time")
