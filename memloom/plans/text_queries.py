"""Text, identity and date queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, text
from .registry import duck_values, inline, query, table

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOPWORDS) + "]"
WORDS_SQL = "list_transform(regexp_extract_all({c}, '[a-zA-Z0-9'']+'), lambda t: lower(t))"
METRIC_SQL = r"list_transform(regexp_extract_all({c}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), lambda t: lower(t))"


def words_sql(c: str) -> str:
    return WORDS_SQL.format(c=c)


def content_sql(c: str) -> str:
    return f"list_filter({words_sql(c)}, lambda t: NOT list_contains({_STOP}, t) AND length(t) > 1)"


def metric_sql(c: str) -> str:
    return METRIC_SQL.format(c=c)


@query(f"SELECT conv_id, turn, list_aggregate({content_sql('text')}, 'string_agg', ' ') AS tokens, len({content_sql('text')}) AS n FROM conversations WHERE len({content_sql('text')}) > 0")
def content_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations").withColumn("tok", text.content_tokens(F.col("text")))
    return t.where(F.size("tok") > 0).select("conv_id", "turn", F.array_join("tok", " ").alias("tokens"), F.size("tok").cast("long").alias("n"))


@query(f"SELECT conv_id, turn, array_to_string({metric_sql('text')}, ' ') AS tokens FROM conversations")
def metric_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.metric_tokens(F.col("text")), " ").alias("tokens"))


_PAIRS = "SELECT q.conv_id, m.turn, q.text AS question, m.text AS memory FROM conversations q JOIN conversations m ON q.conv_id = m.conv_id WHERE q.turn = 0 AND m.turn > 0"


def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Opening question and each later turn of a conversation."""
    c = table(spark, d, "conversations")
    q = c.where("turn = 0").select("conv_id", F.col("text").alias("question"))
    return c.where("turn > 0").select("conv_id", "turn", F.col("text").alias("memory")).join(q, "conv_id")


@query(f"""WITH p AS ({_PAIRS}), t AS (SELECT conv_id, turn, list_distinct({content_sql('question')}) AS q, list_distinct({content_sql('memory')}) AS m FROM p)
SELECT conv_id, turn, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, m)) / len(q)::DOUBLE, 6) ELSE 0.0 END AS score FROM t""")
def lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(text.lexical_score(F.col("question"), F.col("memory")), 6).alias("score"))


@query(f"""WITH p AS ({_PAIRS}), t AS (SELECT conv_id, turn, list_distinct({words_sql('question')}) AS q, list_distinct({words_sql('memory')}) AS m FROM p)
SELECT conv_id, turn, CASE WHEN len(q) > 0 AND len(m) > 0 THEN round(len(list_intersect(q, m)) / len(list_distinct(list_concat(q, m)))::DOUBLE, 6) ELSE 0.0 END AS score FROM t""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    sets = text.jaccard(text.token_set(F.col("question")), text.token_set(F.col("memory")))
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(sets, 6).alias("score"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-zA-Z0-9\\s'']+', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM documents""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("clean"))


_REPLIES = [
    (1, "Answer:  a red   hat\nand more"), (2, "  \n\n second  line "), (3, "answer : Yes"), (4, "<think>no (a)</think> {\"label\": \"WRONG\", \"reason\": \"r1\"}"), (5, "<thinking>open {\"label\": \"CORRECT\"}"),
    (6, "before ```json\n{\"label\": \"CORRECT\", \"explanation\": \"why\"}\n``` after"), (7, "It is INCORRECT because"), (8, "prefix {\"status\": \"ok\"} suffix"), (9, ""), (10, "see conv1_session2, conv3_session1 and conv1_session2 conv9_session9"),
]
_REPLIES_SQL = f"(SELECT conv_id * 1000 + turn AS id, v.reply || ' ' || text AS reply FROM conversations JOIN {duck_values(_REPLIES, 'n, reply')} v ON n = (conv_id + turn) % {len(_REPLIES)} + 1)"
_LINES = r"list_filter(list_transform(string_split_regex(regexp_replace(trim(reply), '(?i)^answer\s*:\s*', ''), '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '')"
_THINK = r"trim(regexp_replace(regexp_replace(reply, '(?is)<think(ing)?>.*?</think(ing)?>', '', 'g'), '(?is)<think(ing)?>.*', '', 'g'))"
_FENCED = r"regexp_extract(reply, '(?s)```(?:json)?\s*(\{.*?\})\s*```', 1)"
_OBJECT = rf"CASE WHEN {_FENCED} <> '' THEN {_FENCED} ELSE regexp_extract(reply, '(?s)\{{.*\}}', 0) END"


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """The turns of conversations, each after one of the openings a model may give its reply."""
    opening = F.element_at(F.array(*[F.lit(r) for _, r in _REPLIES]), ((F.col("conv_id") + F.col("turn")) % len(_REPLIES) + 1).cast("int"))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(opening, F.lit(" "), F.col("text")).alias("reply"))


@query(rf"SELECT id, regexp_replace(coalesce({_LINES}[1], ''), '\s+', ' ', 'g') AS answer FROM {_REPLIES_SQL}")
def answer_postprocess(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("id", text.answer_postprocess(F.col("reply")).alias("answer"))


@query(f"SELECT id, {_THINK} AS said FROM {_REPLIES_SQL}")
def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("id", text.strip_thinking(F.col("reply")).alias("said"))


@query(f"SELECT id, {_OBJECT} AS obj, coalesce(json_extract_string(nullif({_OBJECT}, ''), '$.label'), '') AS label FROM {_REPLIES_SQL}")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    obj = text.json_object(F.col("reply"))
    return _replies(spark, d).select("id", obj.alias("obj"), F.coalesce(F.get_json_object(obj, "$.label"), F.lit("")).alias("label"))


@query(rf"""WITH o AS (SELECT id, reply, {_OBJECT} AS obj FROM {_REPLIES_SQL}), l AS (SELECT *, upper(coalesce(json_extract_string(nullif(obj, ''), '$.label'), '')) AS label FROM o)
SELECT id, CASE WHEN contains(label, 'CORRECT') THEN 1 WHEN contains(label, 'WRONG') THEN 0 WHEN regexp_matches(upper(reply), '\bCORRECT\b') THEN 1 ELSE 0 END AS score,
coalesce(nullif(trim(json_extract_string(nullif(obj, ''), '$.reason')), ''), nullif(trim(json_extract_string(nullif(obj, ''), '$.explanation')), ''), nullif(trim(json_extract_string(nullif(obj, ''), '$.rationale')), ''), regexp_replace(regexp_extract(reply, '(?s)^([^{{]*)', 1), '^\s+|\s+$', '', 'g')) AS reason FROM l""")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    obj = text.json_object(F.col("reply"))
    return _replies(spark, d).select("id", text.judge_label(F.get_json_object(obj, "$.label"), F.col("reply")).alias("score"), text.judge_reason(F.col("reply")).alias("reason"))


@query(rf"""SELECT id, array_to_string(list_filter(list_distinct(x), lambda t: t IN ('conv1_session2', 'conv3_session1')), ',') IN ('conv1_session2,conv3_session1', 'conv3_session1,conv1_session2') AS both_found, len(x) AS named FROM (SELECT id, regexp_extract_all(reply, '\bconv\d+_session\d+\b') AS x FROM {_REPLIES_SQL})""")
def recover_ids(spark: SparkSession, d: str) -> DataFrame:
    valid = F.array(F.lit("conv1_session2"), F.lit("conv3_session1"))
    got = text.recovered_ids(F.col("reply"), valid, 5)
    return _replies(spark, d).select("id", (F.array_join(got, ",") == "conv1_session2,conv3_session1").alias("both_found"), F.size(text.all_matches(F.col("reply"), r"\bconv\d+_session\d+\b")).cast("long").alias("named"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / CAST(3.2 AS DOUBLE)))::BIGINT END AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def _uuid_sql(name: str) -> str:
    h = f"sha1(unhex('{ids.URL_NAMESPACE}') || encode({name}))"
    return (
        f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
    )


@query("SELECT conv_id, " + _uuid_sql("'locomo:conv:' || conv_id") + " AS user_id FROM (SELECT DISTINCT conv_id FROM conversations)")
def conv_user_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id").distinct().select("conv_id", ids.conversation_user_id(F.col("conv_id")).alias("user_id"))


@query("SELECT DISTINCT conv_id, role, " + _uuid_sql("'locomo:' || conv_id || ':' || lower(role) || ':' || 'Name ' || role") + " AS user_id FROM conversations")
def speaker_user_id(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "role").distinct()
    return c.select("conv_id", "role", ids.speaker_user_id(F.col("conv_id"), F.col("role"), F.concat(F.lit("Name "), F.col("role"))).alias("user_id"))


@query("SELECT doc_id, " + _uuid_sql("'eval-pipeline:' || source || ':' || CASE WHEN doc_id % 3 = 0 THEN text ELSE doc_id::VARCHAR END") + " AS id FROM documents")
def memory_uuid(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("doc_id") % 3 == 0, F.lit(" ")).otherwise(F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", ids.memory_id(F.col("source"), key, F.col("text")).alias("id"))


_NAMES_SQL = "(SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN page_id || url WHEN 2 THEN '___' WHEN 3 THEN NULL WHEN 4 THEN url || ' ' || url ELSE 'Ünïcode ' || url END AS name FROM pages)"
_IDENT = "regexp_replace(regexp_replace(lower(coalesce(name, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(f"""WITH a AS (SELECT id, CASE WHEN {_IDENT} = '' THEN 'locomo' ELSE {_IDENT} END AS s FROM {_NAMES_SQL}), b AS (SELECT id, CASE WHEN regexp_matches(s, '^[0-9]') THEN 'db_' || s ELSE s END AS s FROM a)
SELECT id, CASE WHEN length(s) > 63 THEN substr(s, 1, 54) || '_' || substr(sha1(s), 1, 8) ELSE s END AS db FROM b""")
def db_identifier(spark: SparkSession, d: str) -> DataFrame:
    """Names made of the pages' addresses: as they are, from a digit on, without letters, missing, too long, not ASCII."""
    n, url = F.col("page_id") % 6, F.col("url")
    name = F.when(n == 0, url).when(n == 1, F.concat(F.col("page_id").cast("string"), url)).when(n == 2, "___").when(n == 4, F.concat(url, F.lit(" "), url)).when(n == 5, F.concat(F.lit("Ünïcode "), url))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), name.alias("name")).select("id", ids.database_identifier(F.col("name")).alias("db"))


_PHRASES = [
    (1, "I went there yesterday"), (2, "today and last week"), (3, "see you Tomorrow"), (4, "three days ago"), (5, "12 days ago we met"), (6, "last week was fun"), (7, "last weekend"), (8, "two weekends ago"),
    (9, "0 weekends ago"), (10, "last Saturday"), (11, "next monday"), (12, "next month"), (13, "last month"), (14, "this month"), (15, "nothing here"), (16, ""), (17, "the last Friday of next month"),
]
_NUM = r"(\d+|one|two|three|four|five|six|seven)"


def _num_sql(p: str) -> str:
    w = f"lower(regexp_extract(t, '{p}', 1))"
    return f"coalesce(nullif(list_position(['one','two','three','four','five','six','seven'], {w}), 0), try_cast({w} AS INTEGER))"


_AGO, _WKND = rf"(?i)\b{_NUM}\s+days?\s+ago\b", rf"(?i)\b(?:last\s+weekend|{_NUM}\s+weekends?\s+ago)\b"
_DAY = r"(?i)\b(last|next)\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
_TARGET = f"(list_position(['monday','tuesday','wednesday','thursday','friday','saturday','sunday'], lower(regexp_extract(t, '{_DAY}', 2))) - 1)"
_BACK = f"coalesce(nullif({_num_sql(_WKND)}, 0), 1)"


@query(rf"""WITH x AS (SELECT DISTINCT id, t, CAST(o_orderdate AS DATE) AS a FROM {duck_values(_PHRASES, 'id, t')}, (SELECT DISTINCT o_orderdate FROM orders)),
y AS (SELECT *, isodow(a) - 1 AS wd, a - CAST(isodow(a) - 1 AS INTEGER) AS monday FROM x)
SELECT id, a AS anchor, CASE
 WHEN regexp_matches(t, '(?i)\b(yesterday|today|tomorrow)\b') THEN strftime(a + CAST(CASE lower(regexp_extract(t, '(?i)\b(yesterday|today|tomorrow)\b', 1)) WHEN 'yesterday' THEN -1 WHEN 'tomorrow' THEN 1 ELSE 0 END AS INTEGER), '%Y-%m-%d')
 WHEN regexp_matches(t, '{_AGO}') THEN strftime(a - CAST({_num_sql(_AGO)} AS INTEGER), '%Y-%m-%d')
 WHEN regexp_matches(t, '(?i)\blast\s+week\b') THEN strftime(monday - 7, '%Y-%m-%d') || ' to ' || strftime(monday - 1, '%Y-%m-%d')
 WHEN regexp_matches(t, '{_WKND}') THEN strftime(monday - CAST(2 + 7 * ({_BACK} - 1) AS INTEGER), '%Y-%m-%d') || ' to ' || strftime(monday - CAST(1 + 7 * ({_BACK} - 1) AS INTEGER), '%Y-%m-%d')
 WHEN regexp_matches(t, '{_DAY}') THEN strftime(CASE lower(regexp_extract(t, '{_DAY}', 1)) WHEN 'last' THEN a - CAST((wd - {_TARGET} + 6) % 7 + 1 AS INTEGER) ELSE a + CAST(({_TARGET} - wd + 6) % 7 + 1 AS INTEGER) END, '%Y-%m-%d')
 WHEN regexp_matches(t, '(?i)\bnext\s+month\b') THEN strftime(a + INTERVAL 1 MONTH, '%Y-%m')
 WHEN regexp_matches(t, '(?i)\blast\s+month\b') THEN strftime(a - INTERVAL 1 MONTH, '%Y-%m')
 WHEN regexp_matches(t, '(?i)\bthis\s+month\b') THEN strftime(a, '%Y-%m') ELSE '' END AS value FROM y""")
def resolve_relative(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "orders").select("o_orderdate").distinct().select(F.to_date("o_orderdate").alias("anchor"))
    found = dates.resolve_relative(F.col("t"), F.col("anchor"))
    return anchors.distinct().join(inline(spark, _PHRASES, "id int, t string")).select("id", "anchor", F.coalesce(found["value"], F.lit("")).alias("value"))


_ANCHORS = [
    (1, "2023-05-08"), (2, "1:56 pm on 8 May, 2023"), (3, "May 8th, 2023"), (4, "Sept 3 2021"), (5, "3 Foo 2021 then Jan 2, 2020"), (6, "2023-02-30"), (7, "31 april 2022"), (8, ""), (9, None), (10, "noon"), (11, "12 december,2020 and 2019-01-01"),
]
_MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in dates.MONTHS) + "]"
_MONTH_NUMBERS = "[" + ", ".join(str(n) for n in dates.MONTHS.values()) + "]"
_ISO, _DMY, _MDY = r"\b(\d{4})-(\d{2})-(\d{2})\b", r"\b(\d{1,2})\s+([A-Za-z]{3,9})\s*,?\s*(\d{4})\b", r"\b([A-Za-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?\s*,?\s*(\d{4})\b"


def _month_sql(p: str, g: int) -> str:
    return f"{_MONTH_NUMBERS}[nullif(list_position({_MONTH_LIST}, lower(regexp_extract(t, '{p}', {g}))), 0)]"


def _pad_sql(x: str) -> str:
    return f"lpad(CAST({x} AS VARCHAR), 2, '0')"


@query(rf"""SELECT id, CASE WHEN regexp_matches(t, '{_ISO}') THEN try_cast(regexp_extract(t, '{_ISO}', 0) AS DATE)
 WHEN regexp_matches(t, '{_DMY}') AND {_month_sql(_DMY, 2)} IS NOT NULL THEN try_cast(regexp_extract(t, '{_DMY}', 3) || '-' || {_pad_sql(_month_sql(_DMY, 2))} || '-' || {_pad_sql(f"regexp_extract(t, '{_DMY}', 1)")} AS DATE)
 WHEN regexp_matches(t, '{_MDY}') AND {_month_sql(_MDY, 1)} IS NOT NULL THEN try_cast(regexp_extract(t, '{_MDY}', 3) || '-' || {_pad_sql(_month_sql(_MDY, 1))} || '-' || {_pad_sql(f"regexp_extract(t, '{_MDY}', 2)")} AS DATE) END AS anchor FROM {duck_values(_ANCHORS, 'id, t')}""")
def parse_anchor(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, _ANCHORS, "id int, t string").select("id", dates.parse_anchor(F.col("t")).alias("anchor"))
