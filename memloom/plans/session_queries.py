"""Session drivers over the conversations, with deterministic stand-ins for the models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import judged as J
from ..operators import retrieval as R
from ..operators import sessions as S
from ..ports import FunctionPort
from .registry import query, table
from .retrieval_queries import memories, questions



@query("""WITH f AS (SELECT doc_id, 0 AS pos, trim(coalesce(text, '')) AS text, 'event' AS type FROM documents UNION ALL SELECT doc_id, 1, trim(coalesce(source, '')), 'plan' FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, text, type FROM f WHERE text <> ''""")
def extracted_facts(spark: SparkSession, d: str) -> DataFrame:
    """Replies with facts under either name, an unknown type, a bare string and a fact without text."""
    docs = table(spark, d, "documents")
    first = F.to_json(F.struct(F.col("text").alias("fact"), F.col("lang").alias("type")))
    second = F.to_json(F.struct(F.col("source").alias("text"), F.lit(" Plan ").alias("type")))
    reply = F.concat(F.lit('{"facts": ['), first, F.lit(', "bare", '), second, F.lit(', {"type": "plan"}]}'))
    return docs.select("doc_id", F.posexplode(S.extracted_facts(reply)).alias("pos", "f")).select("doc_id", F.col("pos").cast("long").alias("pos"), "f.text", "f.type")


@query("""SELECT event_id, event_type AS text, ['fact', 'character', 'event', 'location'][user_id % 5 + 1] AS type, ['ADD', 'UPDATE', 'NONE'][event_id % 4 + 1] AS operation, CASE WHEN event_id % 3 > 0 THEN user_id::VARCHAR END AS target_id
FROM events WHERE user_id % 5 < 4 AND event_id % 4 < 3 AND event_type IS NOT NULL""")
def extracted_items(spark: SparkSession, d: str) -> DataFrame:
    """Items whose type or operation is unknown are dropped; a blank target is none."""
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    e = table(spark, d, "events")
    item = F.struct(
        F.col("event_type").alias("text"), pick(("Fact", "character", "EVENT", "location", "mood"), F.col("user_id") % 5).alias("type"), pick(("add", "UPDATE", "none", "DROP"), F.col("event_id") % 4).alias("operation"),
        F.when(F.col("event_id") % 3 > 0, F.col("user_id").cast("string")).otherwise(" ").alias("target_id"),
    )
    reply = F.concat(F.lit('{"items": ["x", '), F.to_json(item), F.lit("]}"))
    return e.select("event_id", F.explode(S.extracted_items(reply)).alias("i")).select("event_id", "i.text", "i.type", "i.operation", "i.target_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'said ' || event_type WHEN 1 THEN event_type WHEN 2 THEN 'kind: ' || event_type || '; user: ' || user_id ELSE event_type END AS text, CASE event_id % 4 WHEN 3 THEN 0 ELSE 1 END AS n
FROM events WHERE event_type IS NOT NULL""")
def coerced_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts as strings, under other names and as plain objects, and the list that a reply holds under one of several names."""
    e = table(spark, d, "events").where("event_type IS NOT NULL")
    kind, n = F.col("event_type"), F.col("event_id") % 4
    entry = F.when(n == 0, F.concat(F.lit(" said "), kind)).when(n == 1, F.to_json(F.struct(kind.alias("description")))).when(n == 2, F.to_json(F.struct(kind.alias("kind"), F.lit(" ").alias("none"), F.col("user_id").alias("user")))).otherwise(kind)
    held = F.when(n == 3, F.lit('{"other": []}')).when(n == 2, F.lit('{"data": {"a": 1}}')).otherwise(F.lit('{"memory": 1, "items": [{"a": 1}, 2]}'))
    return e.select("event_id", S.fact_text(entry).alias("text"), F.size(S.memory_entries(held)).cast("long").alias("n"))


_JUDGE = ('{"label": "CORRECT", "reason": "same"}', '```json\n{"label": "wrong"}\n```', "I think it is correct.", "no")


def _judge(prompt: str) -> str:
    return _JUDGE[len(prompt.rsplit("Generated answer: ", 1)[1]) % 4]


@query("""WITH p AS (SELECT q.conv_id, m.turn, length(coalesce(m.text, '')) % 4 AS n FROM conversations q JOIN conversations m ON q.conv_id = m.conv_id AND q.turn = 0 AND m.turn > 0)
SELECT conv_id, turn, CASE WHEN n IN (0, 2) THEN 1 ELSE 0 END AS llm_score, CASE n WHEN 0 THEN 'same' WHEN 1 THEN '```json' WHEN 2 THEN 'I think it is correct.' ELSE 'no' END AS llm_reason FROM p""")
def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every later turn as a generated answer, judged by a stand-in that replies in four ways."""
    q, m = questions(spark, d), memories(spark, d)
    pairs = q.select("user_id", F.col("text").alias("question")).join(m.select("user_id", "key", F.col("text").alias("predicted")), "user_id").withColumn("gold", F.col("question"))
    return S.judge_answers(pairs, FunctionPort(_judge)).select(F.col("user_id").alias("conv_id"), F.col("key").alias("turn"), F.col("llm_score").cast("int").alias("llm_score"), "llm_reason")


@query("SELECT a.conv_id, a.role, a.turn, count(b.turn) AS n, coalesce(string_agg(b.turn || ':' || length(b.text), ',' ORDER BY b.turn), '') AS peers FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn <> b.turn GROUP BY ALL")
def item_peers(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the other turns of their role in their conversation."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("group"), F.col("role").alias("type"), F.col("turn").alias("item"), "text")
    line = F.transform("peers", lambda p: F.concat(p["item"].cast("string"), F.lit(":"), F.length(p["text"]).cast("string")))
    return S.peers(c).select(F.col("group").alias("conv_id"), F.col("type").alias("role"), F.col("item").alias("turn"), F.size("peers").cast("long").alias("n"), F.array_join(line, ",").alias("peers"))


@query("SELECT d.doc_id, l.doc_id IS NULL AS missing, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def attached_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their labels as snapshots, and those that have none."""
    met, lost = S.attach(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])
    return met.select("doc_id", F.lit(False).alias("missing"), "quality").unionByName(lost.select("doc_id", F.lit(True).alias("missing"), F.lit(-1).alias("quality")))


@query("""WITH said AS (SELECT conv_id AS user_id, turn AS session, 'x' AS id FROM conversations WHERE turn % 3 = 2),
snap AS (SELECT conv_id AS user_id, turn AS session, role AS id, text FROM conversations), w AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY session) AS place FROM snap),
l AS (SELECT *, lag(place) OVER p AS was, lag(text) OVER p AS before FROM w WINDOW p AS (PARTITION BY user_id, id ORDER BY session))
SELECT user_id, session, id, CASE WHEN was IS NULL OR was <> place - 1 THEN 'new' ELSE 'changed' END AS change FROM l WHERE (was IS NULL OR was <> place - 1 OR before IS DISTINCT FROM text) AND session % 3 <> 2 UNION ALL SELECT user_id, session, id, 'changed' FROM said""")
def explicit_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every third session names its operations, the others' changes are derived."""
    c = table(spark, d, "conversations")
    snap = c.select(F.col("conv_id").alias("user_id"), F.col("turn").alias("session"), F.col("role").alias("id"), "text", F.lit("ADD").alias("event"), F.lit("").alias("anchor_time"))
    third = snap.where("session % 3 = 2")
    said = third.select("user_id", "session", F.lit("x").alias("id"), F.lit(" update").alias("event")).unionByName(third.select("user_id", "session", F.lit("y").alias("id"), F.lit("NONE").alias("event")))
    return S.session_changes(snap, said)


@query("""SELECT doc_id, list_filter([coalesce(source, ''), trim(coalesce(text, ''))], lambda q: q <> '' AND lower(q) <> lower(trim(coalesce(lang, '')))) AS queries FROM documents""")
def followup_queries(spark: SparkSession, d: str) -> DataFrame:
    """Replies that repeat the question in other case, repeat themselves, and name a third query too many."""
    docs = table(spark, d, "documents")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    reply = F.to_json(F.struct(F.array(F.upper(text("lang")), text("source"), F.lit(" "), text("source"), F.concat(F.lit(" "), F.trim(text("text"))), F.lit("one too many")).alias("queries")))
    return docs.select("doc_id", S.followup_queries(reply, text("lang"), 2).alias("queries"))


def _facts(prompt: str) -> str:
    """A fact per line of the session; every fourth reply is no JSON."""
    lines = [x for x in prompt.split("\nSession:\n", 1)[1].split("\n") if x.strip()]
    return "sorry" if len(prompt) % 4 == 3 else json.dumps({"facts": [{"fact": x, "type": "plan" if i % 3 == 0 else "state"} for i, x in enumerate(lines)]})


@query()
def session_driver(spark: SparkSession, d: str) -> DataFrame:
    """Conversations folded session by session, two turns each, by the rules of the merge; tested against plain Python."""
    c = table(spark, d, "conversations").withColumn("session", (F.floor(F.col("turn") / 2) + 1).cast("long"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    sessions = c.groupBy(F.col("conv_id").cast("string").alias("user_id"), "session").agg(lines.alias("text")).withColumn("anchor_time", F.lit("2023-05-08"))
    memory, _ = S.fold_sessions(sessions, FunctionPort(_facts), with_time=False, slots=False)
    return memory.select("user_id", "pos", "id", "text", "event")


def _ask(prompt: str) -> str:
    words = prompt.split("\nMemories:\n", 1)[1].split()
    return json.dumps({"queries": [" ".join(words[:4]), " ".join(words[-4:])]})


def _pick_last(prompt: str) -> str:
    import re

    return json.dumps({"ids": re.findall(r"\[id=(\d+)\]", prompt)[-2:]})


@query()
def second_hop(spark: SparkSession, d: str) -> DataFrame:
    """The opening questions' two best memories by words, completed by a second hop over two follow-up queries."""
    q, m = questions(spark, d), memories(spark, d)
    recall = lambda asked: R.lexical_topk(asked, m, 3)
    recalled = recall(q)
    first = recalled.where("rank <= 2")
    select = lambda asked, found: J.select_memories(asked, found, m, FunctionPort(_pick_last), 2)
    return S.second_hop(q, first, recalled, m, recall, FunctionPort(_ask), select, 4).select("user_id", "qid", "key", "rank")
