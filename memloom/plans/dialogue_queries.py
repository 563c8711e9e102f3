"""Parsing and normalisation queries: a nested dialogue set built inline, and the conversations table as messages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs
from ..sources import dialogue as D
from .registry import duck_values, inline, query, table


def _say(who: str, text: str, dia: str = "", caption: str | None = None) -> dict:
    return {"speaker": who, "text": text, "dia_id": dia} | ({"blip_caption": caption, "img_url": ["u"]} if caption else {})


#: Gaps, blank sessions, odd ids, choice answers: the shapes that parsing has to stand.
RECORDS = [
    {
        "conversation": {
            "speaker_a": "Ann", "speaker_b": "Bob  Lee", "session_1_date_time": "1 May, 2023", "session_1": [_say("ann ", "Hi", "D1:1"), _say("BOB LEE", "Hello", "D1:2", "a cat"), _say("Ann", "  ")],
            "session_2": [_say("system", "note", "x"), _say("Zed", "who?")], "session_4": [_say("Ann", "late", "D4:1")],
        },
        "qa": [
            {"question": "q0", "answer": "red", "category": 1, "evidence": ["D1:1"]}, {"question": "q1", "answer": "(b)", "qa_type": "single_choice", "options": ["A. cat", "B. dog"], "evidence": [], "evidence_qid": ["E"]},
            {"question": "q2", "answer": ["cat", "B. dog"], "qa_type": "multi_select", "option": ["A. cat", "B. dog", "C. cow"]}, {"question": "q3", "answer": "bird", "qa_type": "single_choice", "options": ["cat", "dog"], "answer_fixed": "x"},
        ],
    },
    {"conversation": {"speaker_a": "Cy", "speaker_b": "Di", "session_1": [_say("Di", "one", "D1:7")], "session_2": [_say("Cy", " ")], "session_3": [_say("Cy", "three")]}, "qa": []},
    {"conversation": None}, {"conversation": {"speaker_a": "E"}},
]


def records(spark: SparkSession) -> DataFrame:
    return inline(spark, [(i, json.dumps(r)) for i, r in enumerate(RECORDS)], "idx long, record string")


@query("SELECT * FROM (VALUES (0, 1, '1 May, 2023', 2), (0, 2, '', 2), (1, 1, '', 1)) AS v(idx, session_index, date_time, n_messages)")
def session_explode(spark: SparkSession, d: str) -> DataFrame:
    return D.sessions(records(spark)).select("idx", "session_index", "date_time", "n_messages")


@query("SELECT DISTINCT conv_id AS idx, CASE conv_id % 5 WHEN 3 THEN 'no session' ELSE 'no conversation' END AS problem FROM conversations WHERE conv_id % 5 IN (1, 2, 3)")
def invalid_records(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as records of one session; of five, one has a null conversation, one none, one no session."""
    said = F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text")))
    record = lambda key: F.to_json(F.struct(F.struct(F.lit("user").alias("speaker_a"), said.alias(key)).alias("conversation")))
    n = F.col("conv_id") % 5
    odd = F.when(n == 1, '{"conversation": null}').when(n == 2, '{"qa": []}').when(n == 3, '{"conversation": {"speaker_a": "E"}}')
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(record("session_1").alias("one"), record("session_2").alias("two"))
    return D.invalid_records(rows.select(F.col("conv_id").alias("idx"), F.coalesce(odd, F.when(n == 0, F.col("one")).otherwise(F.col("two"))).alias("record")))


@query("""SELECT * FROM (VALUES (0, 1, 1, 'user', 'ann', 'Hi', ''), (0, 1, 2, 'assistant', 'BOB LEE', 'Hello', 'a cat'), (0, 2, 1, 'system', 'system', 'note', ''), (0, 2, 2, 'unknown', 'Zed', 'who?', ''), (1, 1, 7, 'assistant', 'Di', 'one', '')) AS v(idx, session_index, message_index, role, speaker, content, caption)""")
def role_normalize(spark: SparkSession, d: str) -> DataFrame:
    return D.messages(D.sessions(records(spark))).drop("img_urls")


@query("""SELECT * FROM (VALUES (0, 0, 'red', '', 'D1:1', ''), (0, 1, 'B', 'single_choice', 'E', 'B'), (0, 2, 'A,B', 'multi_select', '', 'A,B'), (0, 3, 'bird', 'single_choice', '', 'x')) AS v(idx, qa_index, answer, qa_type, evidence, answer_fixed)""")
def qa_letters(spark: SparkSession, d: str) -> DataFrame:
    q = D.questions(records(spark))
    return q.select("idx", "qa_index", "answer", "qa_type", F.array_join("evidence", ",").alias("evidence"), F.array_join("answer_fixed", ",").alias("answer_fixed"))


_SESSIONS = [(1, 1, 2), (1, 2, 0), (1, 3, 4), (2, 1, 1), (2, 3, 1), (3, 2, 1), (4, 1, 1), (4, 2, 1)]


@query(f"""WITH s AS (SELECT *, row_number() OVER w AS rn, max(CASE WHEN n_messages = 0 THEN 1 ELSE 0 END) OVER w AS bad FROM {duck_values(_SESSIONS, 'idx, session_index, n_messages')} WINDOW w AS (PARTITION BY idx ORDER BY session_index)) SELECT idx, session_index, n_messages FROM s WHERE rn = session_index AND bad = 0""")
def prefix_cut(spark: SparkSession, d: str) -> DataFrame:
    return D.prefix_cut(inline(spark, _SESSIONS, "idx int, session_index int, n_messages int"))


def turn_messages(spark: SparkSession, d: str) -> DataFrame:
    """The conversations table as messages: two turns a session, roles as speakers."""
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("idx"), (F.floor(F.col("turn") / 2) + 1).alias("session_index"), F.col("turn").alias("message_index"), F.col("role").alias("speaker"), F.trim("text").alias("content"), F.when(F.col("turn") % 5 == 0, "pic").otherwise("").alias("caption"))


def turn_times(spark: SparkSession, d: str) -> DataFrame:
    t = turn_messages(spark, d).select("idx", "session_index").distinct()
    return t.withColumn("date_time", F.when(F.col("session_index") == 1, "8 May, 2023").otherwise(""))


_TURNS = "m AS (SELECT conv_id AS idx, turn // 2 + 1 AS session_index, turn AS message_index, role AS speaker, trim(text) AS content, CASE WHEN turn % 5 = 0 THEN 'pic' ELSE '' END AS caption FROM conversations)"
_SCRIPT = "t AS (SELECT idx, session_index, '[Session time: ' || CASE WHEN session_index = 1 THEN '8 May, 2023' ELSE 'unknown' END || ']' || chr(10) || string_agg(speaker || ': ' || content || CASE WHEN caption <> '' THEN chr(10) || '[image: ' || caption || ']' ELSE '' END, chr(10) ORDER BY message_index) AS transcript FROM m GROUP BY 1, 2)"


@query(f"WITH {_TURNS}, {_SCRIPT} SELECT * FROM t")
def transcript(spark: SparkSession, d: str) -> DataFrame:
    return D.transcript(turn_messages(spark, d), turn_times(spark, d))


@query(f"""WITH {_TURNS} SELECT idx, session_index, md5(to_json(struct_pack(session_index := session_index, session_time := CASE WHEN session_index = 1 THEN '8 May, 2023' ELSE 'unknown' END))::VARCHAR) AS head, count(*) AS n FROM m GROUP BY 1, 2""")
def session_json(spark: SparkSession, d: str) -> DataFrame:
    j = D.session_json(turn_messages(spark, d), turn_times(spark, d))
    head = F.concat(F.regexp_extract("json", r'^(\{"session_index":\d+,"session_time":"[^"]*")', 1), F.lit("}"))
    return j.select("idx", "session_index", F.md5(head).alias("head"), F.size(F.from_json(F.get_json_object("json", "$.messages"), "array<string>")).cast("long").alias("n"))


@query(f"WITH {_TURNS} SELECT idx, count(DISTINCT session_index) AS sessions FROM m WHERE session_index <= 2 GROUP BY 1")
def first_n_sessions(spark: SparkSession, d: str) -> DataFrame:
    return D.per_parent_limit(turn_times(spark, d), "idx", "session_index", 2).groupBy("idx").agg(F.count(F.lit(1)).alias("sessions"))


@query(f"WITH {_TURNS}, {_SCRIPT} SELECT t.idx, s.speaker, format('conv{{}}_session{{:03d}}', t.idx, t.session_index) AS memory_key, md5(transcript) AS digest FROM t JOIN (SELECT DISTINCT idx, session_index, speaker FROM m) s ON t.idx = s.idx AND t.session_index = s.session_index")
def speaker_sessions(spark: SparkSession, d: str) -> DataFrame:
    m = D.raw_memories(turn_messages(spark, d), turn_times(spark, d))
    return m.select("idx", "speaker", "memory_key", F.md5("text").alias("digest"))


@query("WITH f AS (SELECT conv_id AS idx, role, min(turn) AS first FROM conversations GROUP BY 1, 2) SELECT idx, string_agg(role, ',' ORDER BY first) AS participants FROM f GROUP BY 1")
def participants(spark: SparkSession, d: str) -> DataFrame:
    return D.participants(turn_messages(spark, d)).select("idx", F.array_join("participants", ",").alias("participants"))


_SPOKEN = "(SELECT conv_id AS g, turn AS pos, CASE WHEN turn % 2 = 0 THEN role || ' says ' ELSE '' END || text AS fact, speaker FROM conversations, (VALUES ('USER'), ('Zed')) AS s(speaker))"


@query(f"SELECT \"group\", pos, fact, speaker FROM (SELECT *, max(CASE WHEN contains(lower(fact), lower(speaker)) THEN 1 ELSE 0 END) OVER (PARTITION BY g, speaker) AS a, g AS \"group\" FROM {_SPOKEN}) WHERE a = 0 OR contains(lower(fact), lower(speaker))")
def facts_for_speaker(spark: SparkSession, d: str) -> DataFrame:
    """Turns as facts, every other one names its role; one speaker is a role, the other nobody."""
    fact = F.concat(F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(" says "))).otherwise(F.lit("")), "text")
    speaker = F.explode(F.array(F.lit("USER"), F.lit("Zed")))
    return D.facts_for_speaker(table(spark, d, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("pos"), fact.alias("fact"), speaker.alias("speaker")))


@query("""WITH v AS (SELECT event_id // 5 AS id, event_id AS pos, CASE event_id % 4 WHEN 0 THEN upper(event_type) WHEN 1 THEN ' ' || event_type || ' ' WHEN 2 THEN ' ' ELSE event_type END AS v FROM events),
f AS (SELECT id, arg_min(trim(v), pos) AS v, min(pos) AS first FROM v WHERE trim(v) <> '' GROUP BY id, lower(trim(v))), l AS (SELECT id, list(v ORDER BY first) AS l FROM f GROUP BY 1)
SELECT g.id, CASE WHEN l IS NULL THEN '' WHEN len(l) = 1 THEN l[1] WHEN len(l) = 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[1:len(l) - 1], ', ') || ', and ' || l[len(l)] END AS joined FROM (SELECT DISTINCT id FROM v) g LEFT JOIN l ON g.id = l.id""")
def join_values(spark: SparkSession, d: str) -> DataFrame:
    """Types of five events in a row, in either case, with blanks around them or blank."""
    kind, n = F.col("event_type"), F.col("event_id") % 4
    v = F.when(n == 0, F.upper(kind)).when(n == 1, F.concat(F.lit(" "), kind, F.lit(" "))).when(n == 2, " ").otherwise(kind)
    five = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 5).alias("id")).agg(F.array_sort(F.collect_list(F.struct("event_id", v.alias("v")))).alias("v"))
    return five.select("id", F.transform("v", lambda x: x["v"]).alias("v")).select("id", T.join_values(F.col("v")).alias("joined"))


#: Broken JSON; # stands for an event's number, ~ for its type.
_BROKEN = ['{"~": #,}', 'x {"~": {"b": "}#"}} y', '{"items": [{"id": #}, {"id": 2', "['~#', 'b ', '']", "plain ~ #", '{"~": [#, 2']


_FILLED = "replace(replace({c}, '#', event_id::VARCHAR), '~', event_type) AS {c}"


@query(f"SELECT event_id AS id, {', '.join(_FILLED.format(c=c) for c in ('balanced', 'repaired', 'prediction'))}" + """ FROM events JOIN (VALUES (0, '{"~": #,}', '{"~": #}', '{"~": #,}'), (1, '{"~": {"b": "}#"}}', '', 'x {"~": {"b": "}#"}} y'), (2, '', '{"items": [{"id": #}, {"id": 2}]}', '{"items": [{"id": #}, {"id": 2'), (3, '', '', '~#, b'), (4, '', '', 'plain ~ #'), (5, '', '{"~": [#, 2]}', '{"~": [#, 2')) AS v(n, balanced, repaired, prediction) ON n = event_id % 6""")
def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Balanced extraction, repair and list predictions, against values worked out by hand."""
    raw = F.col("raw")
    form = F.element_at(F.array(*[F.lit(b) for b in _BROKEN]), (F.col("event_id") % len(_BROKEN) + 1).cast("int"))
    filled = F.replace(F.replace(form, F.lit("#"), F.col("event_id").cast("string")), F.lit("~"), F.col("event_type"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), filled.alias("raw")).select("id", udfs.balanced_object_udf(raw).alias("balanced"), udfs.repaired_json_udf(raw).alias("repaired"), udfs.normalized_prediction_udf(raw).alias("prediction"))
