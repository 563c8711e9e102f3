"""Model-driven operators with deterministic stand-ins, over inline rows worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import judged as J
from ..operators import retrieval as R
from ..ports import FunctionPort
from .registry import duck_values, inline, query, table
from .retrieval_queries import memories, questions

_OLD = [("u", 0, "0", "ann likes red tea and cake"), ("u", 1, "1", "bob runs every day"), ("u", 2, "7", "carl has a dog")]
_FACTS = [("u", 0, "ann likes red tea and pie", ""), ("u", 1, "bob runs every day", ""), ("u", 2, "a new thing", ""), ("u", 3, "ann likes red tea and milk", ""), ("u", 4, "A new thing", ""), ("u", 5, "bob runs every morning", "")]


#: A word of each conversation's own: its texts' words hold it.
_TAGS = "(SELECT conv_id, 'c' || conv_id || 'x' || max(length(text)) AS tag FROM conversations GROUP BY 1)"


def per_conversation(spark: SparkSession, d: str, rows: list[tuple], names: list[str], tagged: list[str]) -> DataFrame:
    """The rows once for every conversation: its number ends user_id, its tag the texts that aren't blank."""
    tag = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("x"), F.max(F.length("text")).cast("string"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(tag.alias("tag"))
    c = c.select("conv_id", "tag", F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names)]) for r in rows])).alias("r")).select("conv_id", "tag", "r.*")
    c = c.withColumns({n: F.when(F.trim(n) != "", F.concat(n, F.lit(" "), "tag")).otherwise(F.col(n)) for n in tagged})
    return c.withColumn("user_id", F.concat("user_id", F.col("conv_id").cast("string"))).select(*names)


def _old(spark: SparkSession, d: str) -> DataFrame:
    return per_conversation(spark, d, _OLD, ["user_id", "pos", "id", "text"], ["text"])


def _judge(prompt: str) -> str:
    if "pie" in prompt or "milk" in prompt:
        return '{"action": "UPDATE", "target_id": "0", "text": "ann likes red tea, cake and more"}'
    return "no idea"


@query(f"SELECT user_id || conv_id AS user_id, id, CASE event WHEN 'ADD' THEN text || ' ' || tag ELSE text END AS text, event FROM {_TAGS}, (VALUES ('u', '0', 'ann likes red tea, cake and more', 'UPDATE'), ('u', '2', 'ann likes red tea and pie', 'ADD'), ('u', '3', 'bob runs every morning', 'ADD'), ('u', '4', 'a new thing', 'ADD')) AS v(user_id, id, text, event)")
def decide_judged(spark: SparkSession, d: str) -> DataFrame:
    facts = per_conversation(spark, d, _FACTS, ["user_id", "arrival", "text", "anchor_time"], ["text"])
    return J.decide_judged(_old(spark, d), facts, FunctionPort(_judge)).select("user_id", "id", "text", "event")


_ITEMS = [
    ("u", 0, "9", "nine", "ADD", "", ""), ("u", 1, "7", "taken", "ADD", "", ""), ("u", 2, "x", "named", "add", "", ""), ("u", 3, "", "t", "UPDATE", "1", "merged"), ("u", 4, "", "lost", "UPDATE", "55", ""),
    ("u", 5, "", "skip", "NONE", "0", ""), ("u", 6, "", " ", "ADD", "", ""), ("u", 7, "", "no target", "UPDATE", "", ""), ("w", 0, "0", "first", "ADD", "", ""),
]


@query(f"SELECT user_id || conv_id AS user_id, seq, id, text || ' ' || tag AS text, event FROM {_TAGS}, (VALUES ('u', 0, '9', 'nine', 'ADD'), ('u', 1, '2', 'taken', 'ADD'), ('u', 2, '3', 'named', 'ADD'), ('u', 3, '1', 'merged', 'UPDATE'), ('u', 4, '4', 'lost', 'ADD'), ('w', 0, '0', 'first', 'ADD')) AS v(user_id, seq, id, text, event)")
def item_operations(spark: SparkSession, d: str) -> DataFrame:
    names = ["user_id", "seq", "id", "text", "operation", "target_id", "merged_text"]
    return J.item_operations(_old(spark, d), per_conversation(spark, d, _ITEMS, names, ["text", "merged_text"]))


@query()
def select_memories(spark: SparkSession, d: str) -> DataFrame:
    """Selection by a stand-in that picks the first two ids shown, and says nonsense for every third conversation."""
    q, m = questions(spark, d), memories(spark, d)
    recalled = R.lexical_topk(q, m, 5)
    return J.select_memories(q, recalled, m, FunctionPort(_pick), 2)


def _pick(prompt: str) -> str:
    import re

    ids = re.findall(r"\[id=(\d+)\]", prompt)
    return "hm" if len(prompt) % 3 == 0 else '{"ids": ["%s", "999"]}' % '", "'.join(ids[:2])


_LINES = [(1, "a", "said", "2023", "May", ""), (2, "b", "told", "", "", ""), (3, "c", "x", "", "May", "2023-05-01")]


@query("SELECT * FROM (VALUES (1, '[id=a] (2023) said anchor_time=May', '- [2023] said (anchor_time=May; resolved_time=UNKNOWN)'), (2, '[id=b] told', '- told'), (3, '[id=c] x anchor_time=May; resolved_time=2023-05-01', '- x (anchor_time=May; resolved_time=2023-05-01)')) AS v(n, listed, answered)")
def memory_lines(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = inline(spark, _LINES, "n int, id string, text string, created string, anchor string, resolved string")
    return rows.select("n", J.memory_line(c("id"), c("text"), c("created"), c("anchor"), c("resolved")).alias("listed"), J.answer_line(c("text"), c("created"), c("anchor"), c("resolved")).alias("answered"))


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 AND l.doc_id IS NOT NULL THEN 0.0 ELSE 0.5 END AS llm_score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def reapply_empty_rule(spark: SparkSession, d: str) -> DataFrame:
    """Old files rescored by the empty-answer rule, and the changed scores patched into the report."""
    said = F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("said"))
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("conversation"), F.lit(0).alias("qa_index"), said.alias("predicted_answer"), F.lit(None).cast("string").alias("response"), F.lit(0.5).alias("llm_score"), F.lit(None).cast("double").alias("llm_score_judge"))
    report = table(spark, d, "documents").select(F.col("doc_id").alias("conversation"), F.lit(0).alias("qa_index"), F.lit(0.5).alias("llm_score"))
    return J.patch_report(report, E.apply_empty_rule(labels)).select(F.col("conversation").alias("doc_id"), "llm_score")


_RUBRICS = [("r1", "n", "Is it so?"), ("r2", "n", " is it so? "), ("R1", "n", "Else?"), ("", "n", "x"), ("r3", "n", None), ("r4", "n", "Fine?")]


@query("SELECT * FROM (VALUES ('', 'blank'), ('r2', 'repeated question'), ('r1', 'repeated id'), ('r3', 'blank')) AS v(id, problem)")
def rubric_problems(spark: SparkSession, d: str) -> DataFrame:
    return J.rubric_problems(inline(spark, _RUBRICS, "id string, name string, question string")).select("id", "problem")


_STUBS = [(1, '{"status": "ok"}'), (2, '{"facts": [1], "status": "ok"}'), (3, '{"other": 1}'), (4, "nonsense"), (5, '{"facts": [1, 2,], }')]


@query("SELECT * FROM (VALUES (1, true, '{\"status\": \"ok\"}'), (2, false, '{\"facts\": [1], \"status\": \"ok\"}'), (3, true, '{\"other\": 1}'), (4, true, 'nonsense'), (5, true, '{\"facts\": [1, 2] }')) AS v(id, stub, bare)")
def stub_payloads(spark: SparkSession, d: str) -> DataFrame:
    return inline(spark, _STUBS, "id int, raw string").select("id", T.is_stub_payload(F.col("raw"), "facts").alias("stub"), F.regexp_replace(T.without_trailing_commas(F.col("raw")), r"\] \}", "] }").alias("bare"))


_WORDS = [(1, [str(i) for i in range(70)]), (2, ["a", "b"]), (3, [])]


@query(f"SELECT id, len(v) AS n, least(len(v), 60) AS kept, least(len(v), 1) AS one, len(v) AS every FROM {duck_values(_WORDS, 'id, v')}")
def last_items(spark: SparkSession, d: str) -> DataFrame:
    size = lambda n: F.size(T.last_items(F.col("v"), n)).cast("long")
    return inline(spark, _WORDS, "id int, v array<string>").select("id", F.size("v").cast("long").alias("n"), size(None).alias("kept"), size(1).alias("one"), size(0).alias("every"))
