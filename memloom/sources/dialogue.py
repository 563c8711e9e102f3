"""Nested conversation JSON to tables: sessions, messages and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

MESSAGE = "struct<speaker:string,text:string,dia_id:string,img_url:array<string>,blip_caption:string>"
QA = "struct<question:string,answer:string,category:string,character:string,qa_type:string,option:string,options:string,evidence:string,evidence_dialogues:string,evidence_qid:string,answer_fixed:string>"
QA_TYPES = ("single_choice", "multi_select", "ordering")


def load_dataset(spark: SparkSession, path: str, max_conversations: int | None = None, lines: bool = False) -> DataFrame:
    """(idx, record): one row per conversation, idx its position in the array.

    One array is one file and so one task; large sets come with ``lines``, a conversation a line, where idx is the order of lines.
    """
    if lines:
        rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("idx"), F.col("value").alias("record"))
    else:
        rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "record"))
        rows = rows.withColumn("idx", F.col("idx").cast("long"))
    return rows if max_conversations is None else rows.where(F.col("idx") < max_conversations)


def _parts(records: DataFrame) -> DataFrame:
    parts = F.from_json(F.get_json_object("record", "$.conversation"), "map<string,string>")
    return records.select("idx", "record", parts.alias("parts"))


def invalid_records(records: DataFrame) -> DataFrame:
    """(idx, problem) of records without a conversation object or without any session."""
    has = F.exists(F.map_keys("parts"), lambda k: k.rlike(r"^session_\d+$"))
    problem = F.when(F.col("parts").isNull(), "no conversation").when(~has, "no session")
    return _parts(records).select("idx", problem.alias("problem")).where("problem IS NOT NULL")


def prefix_cut(sessions: DataFrame) -> DataFrame:
    """Sessions 1..k up to the first gap or the first empty one, per conversation (idx, session_index, n_messages)."""
    w = Window.partitionBy("idx").orderBy("session_index")
    ok = (F.row_number().over(w) == F.col("session_index")) & (F.max((F.col("n_messages") == 0).cast("int")).over(w) == 0)
    return sessions.withColumn("__ok", ok).where("__ok").drop("__ok")


def sessions(records: DataFrame) -> DataFrame:
    """(idx, speaker_a, speaker_b, session_index, date_time, messages): the contiguous sessions with their messages that aren't blank."""
    p = _parts(records)
    own = p.select("idx", F.trim(F.coalesce(F.col("parts")["speaker_a"], F.lit(""))).alias("speaker_a"), F.trim(F.coalesce(F.col("parts")["speaker_b"], F.lit(""))).alias("speaker_b"), F.explode("parts").alias("key", "value"), "parts")
    own = own.withColumn("session_index", F.regexp_extract("key", r"^session_(\d+)$", 1).try_cast("int")).where("session_index IS NOT NULL")
    raw = F.from_json("value", f"array<{MESSAGE}>")
    placed = F.transform(raw, lambda m, i: F.struct((i + 1).alias("place"), m.alias("m")))
    full = F.filter(placed, lambda x: F.trim(F.coalesce(x["m"]["text"], F.lit(""))) != "")
    own = own.select("idx", "speaker_a", "speaker_b", "session_index", F.coalesce(F.col("parts")[F.concat("key", F.lit("_date_time"))], F.lit("")).alias("date_time"), F.coalesce(full, F.array().cast(f"array<struct<place:int,m:{MESSAGE}>>")).alias("messages"))
    return prefix_cut(own.withColumn("n_messages", F.size("messages")))


def dia_id(value: Column) -> Column:
    """struct(session, message) of an id like D3:12; null if it isn't one."""
    form = r"^D(\d+):(\d+)$"
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v.rlike(form), F.struct(F.regexp_extract(v, form, 1).cast("int").alias("session"), F.regexp_extract(v, form, 2).cast("int").alias("message")))


def messages(sessions_: DataFrame) -> DataFrame:
    """One row per message, with its role and index (its id's, else its place)."""
    m = sessions_.select("idx", "speaker_a", "speaker_b", "session_index", F.explode("messages").alias("x"))
    index = F.coalesce(dia_id(F.col("x.m.dia_id"))["message"], F.col("x.place"))
    role = T.normalize_role(F.col("x.m.speaker"), F.col("speaker_a"), F.col("speaker_b"))
    return m.select("idx", "session_index", index.alias("message_index"), role.alias("role"), F.trim("x.m.speaker").alias("speaker"), F.trim("x.m.text").alias("content"), F.coalesce("x.m.blip_caption", F.lit("")).alias("caption"), F.coalesce("x.m.img_url", F.array().cast("array<string>")).alias("img_urls"))


def participants(messages_: DataFrame) -> DataFrame:
    """(idx, participants): speakers in order of first appearance, names that differ in case only once."""
    first = messages_.groupBy("idx", F.lower("speaker").alias("low")).agg(F.min(F.struct("session_index", "message_index", "speaker")).alias("f"))
    return first.groupBy("idx").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["speaker"]).alias("participants"))


def transcript(messages_: DataFrame, times: DataFrame) -> DataFrame:
    """(idx, session_index, transcript): a time line, then a line per message and per caption, in order."""
    lines = F.concat(F.col("speaker"), F.lit(": "), F.col("content"))
    lines = F.when(F.col("caption") != "", F.concat(lines, F.lit("\n[image: "), F.col("caption"), F.lit("]"))).otherwise(lines)
    body = messages_.groupBy("idx", "session_index").agg(F.array_sort(F.collect_list(F.struct("message_index", lines.alias("line")))).alias("l"))
    head = F.concat(F.lit("[Session time: "), F.coalesce(F.nullif("date_time", F.lit("")), F.lit("unknown")), F.lit("]\n"))
    return body.join(times.select("idx", "session_index", "date_time"), ["idx", "session_index"]).select("idx", "session_index", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("transcript"))


def session_json(messages_: DataFrame, times: DataFrame) -> DataFrame:
    """(idx, session_index, json): a session as one JSON object; captions only where there are any."""
    item = F.struct(F.col("speaker"), F.col("content").alias("text"), F.nullif("caption", F.lit("")).alias("image_caption"))
    body = messages_.groupBy("idx", "session_index").agg(F.array_sort(F.collect_list(F.struct("message_index", item.alias("m")))).alias("l"))
    body = body.join(times.select("idx", "session_index", "date_time"), ["idx", "session_index"])
    obj = F.struct("session_index", F.coalesce(F.nullif("date_time", F.lit("")), F.lit("unknown")).alias("session_time"), F.transform("l", lambda x: x["m"]).alias("messages"))
    return body.select("idx", "session_index", F.to_json(obj).alias("json"))


def _strings(raw: Column) -> Column:
    """A JSON list's items, or the scalar as the only one; blanks dropped."""
    parsed = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return F.filter(F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def questions(records: DataFrame) -> DataFrame:
    """Normalised question rows: choice answers as letters, evidence from the first of its three fields that has any."""
    rows = records.select("idx", F.posexplode(F.from_json(F.get_json_object("record", "$.qa"), f"array<{QA}>")).alias("qa_index", "q"))
    list_only = lambda c: F.when(F.col(c).startswith("["), _strings(F.col(c))).otherwise(F.array().cast("array<string>"))
    evidence = list_only("q.evidence_qid")
    for c in ("q.evidence_dialogues", "q.evidence"):
        evidence = F.when(F.size(list_only(c)) > 0, list_only(c)).otherwise(evidence)
    rows = rows.withColumns({"options": list_only("q.options"), "one": list_only("q.option"), "answer_texts": _strings(F.col("q.answer")), "qa_type": F.lower(F.trim(F.coalesce("q.qa_type", F.lit("")))), "evidence": evidence})
    rows = rows.withColumn("options", F.when(F.size("one") > 0, F.col("one")).otherwise(F.col("options")))
    letters = F.when(F.col("qa_type").isin(*QA_TYPES), F.nullif(T.option_letters(F.col("options"), F.col("answer_texts"), F.col("qa_type")), F.lit("")))
    answer = F.coalesce(letters, F.col("q.answer"), F.lit(""))
    fixed = _strings(F.col("q.answer_fixed"))
    fixed = F.when(F.size(fixed) > 0, fixed).when(F.col("qa_type").isin(*QA_TYPES) & (answer != ""), F.array(answer)).otherwise(F.array().cast("array<string>"))
    return rows.select("idx", "qa_index", F.coalesce("q.question", F.lit("")).alias("question"), answer.alias("answer"), "answer_texts", F.col("q.answer").startswith("[").alias("answer_is_list"), F.coalesce("q.category", F.lit("")).alias("category"), F.trim(F.coalesce("q.character", F.lit(""))).alias("character"), "qa_type", "options", "evidence", fixed.alias("answer_fixed"))


def per_parent_limit(rows: DataFrame, parent: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(parent).orderBy(order))).where(F.col("__r") <= n).drop("__r")


def raw_memories(messages_: DataFrame, times: DataFrame) -> DataFrame:
    """Raw add: one memory per speaker and session they spoke in, the session's transcript, under a readable key."""
    text = transcript(messages_, times)
    spoke = messages_.select("idx", "session_index", "speaker").distinct()
    key = F.format_string("conv%d_session%03d", F.col("idx"), F.col("session_index"))
    return text.join(spoke, ["idx", "session_index"]).select("idx", "speaker", key.alias("memory_key"), F.col("transcript").alias("text"))


def facts_for_speaker(facts: DataFrame) -> DataFrame:
    """Facts (group, pos, fact, speaker) that name the speaker; all of the group's where none does."""
    hit = F.lower("fact").contains(F.lower("speaker"))
    anyone = F.max(hit.cast("int")).over(Window.partitionBy("group", "speaker"))
    return facts.withColumn("__any", anyone).where(hit | (F.col("__any") == 0)).drop("__any")
