"""Operators that ask a model and then apply deterministic rules: selection, judged merging, item deltas, rubric checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..ports import TextPort, complete
from . import memory as M
from . import retrieval as R

#: Similarity above which the judge isn't asked because nothing is new, and below which everything is.
SAME, APART = 0.92, 0.55


def memory_line(id_: Column, text: Column, created: Column, anchor: Column, resolved: Column) -> Column:
    """``[id=..] (created) text anchor_time=..; resolved_time=..``, without what is blank."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    times = F.concat_ws("; ", F.concat(F.lit("anchor_time="), some(anchor)), F.concat(F.lit("resolved_time="), some(resolved)))
    return F.concat_ws(" ", F.concat(F.lit("[id="), id_, F.lit("]")), F.concat(F.lit("("), some(created), F.lit(")")), some(text), some(times))


def memory_list(lines: Column) -> Column:
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(F.lit("(no memories)"))


def answer_line(text: Column, created: Column, anchor: Column, resolved: Column) -> Column:
    """``- [created] text (anchor_time=..; resolved_time=..|UNKNOWN)``."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    when = F.concat(F.lit("(anchor_time="), some(anchor), F.lit("; resolved_time="), F.coalesce(some(resolved), F.lit("UNKNOWN")), F.lit(")"))
    return F.concat_ws(" ", F.lit("-"), F.concat(F.lit("["), some(created), F.lit("]")), F.trim(text), when)


def select_memories(questions: DataFrame, recalled: DataFrame, memories: DataFrame, port: TextPort, k: int) -> DataFrame:
    """(user_id, qid, rank, key, score): what a model picks from the recalled memories, as JSON ``{"ids": [...]}``.

    Picks that weren't recalled and repeats are dropped, at most k stay, in the model's order. A reply without a list
    gives the k best by shared words.
    """
    rows = recalled.join(memories.select("user_id", "key", "text"), ["user_id", "key"])
    line = F.concat(F.lit("[id="), F.col("key").cast("string"), F.lit("] "), F.col("text"))
    shown = rows.groupBy("user_id", "qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"), F.collect_set(F.col("key").cast("string")).alias("valid"))
    asked = questions.select("user_id", "qid", "text").join(shown, ["user_id", "qid"])
    asked = asked.select("user_id", "qid", "valid", F.concat(F.lit("Memories:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\nQuestion: "), F.col("text")).alias("prompt"))
    told = complete(asked, "prompt", port, keep_errors=True)
    ids = F.from_json(F.get_json_object(T.json_object(T.strip_thinking(F.col("reply"))), "$.ids"), "array<string>")
    told = told.withColumn("picked", F.when(ids.isNotNull(), F.slice(F.array_intersect(F.array_distinct(ids), "valid"), 1, k)))
    chosen = told.where("picked IS NOT NULL").select("user_id", "qid", F.posexplode("picked").alias("pos", "id"))
    chosen = chosen.join(recalled.select("user_id", "qid", "key", "score"), ["user_id", "qid"]).where(F.col("id") == F.col("key").cast("string"))
    chosen = chosen.select("user_id", "qid", (F.col("pos") + 1).cast("long").alias("rank"), "key", "score")
    failed = questions.join(told.where("picked IS NULL").select("user_id", "qid"), ["user_id", "qid"], "left_semi")
    return chosen.unionByName(R.lexical_topk(failed, memories, k).select("user_id", "qid", "rank", "key", "score"))


def decide_judged(old: DataFrame, facts: DataFrame, port: TextPort, similarity=M.jaccard_similarity) -> DataFrame:
    """Operations where a judge settles what similarity leaves open.

    Facts stand by their best similarity, then their text. Known texts and near-equal ones say nothing, distant ones
    add; for the others the judge replies ``{"action": .., "target_id": .., "text": ..}`` over the three nearest. A
    target that isn't among these or that an earlier fact has claimed makes an add, and a merged text equal to the old
    one says nothing. Without a usable reply a fact updates its nearest memory from M.SPECIFIC on and else adds.
    """
    low = lambda c: F.lower(M.blank(c))
    facts = facts.where(M.blank("text") != "")
    fresh = facts.withColumn("low", low("text")).join(old.select("user_id", low("text").alias("low")).distinct(), ["user_id", "low"], "left_anti")
    near = M.candidates(fresh, old, similarity, 3).join(old.select("user_id", "id", F.col("text").alias("old_text")), ["user_id", "id"])
    near = near.groupBy("user_id", "arrival").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "similarity", "old_text"))).alias("near"))
    f = fresh.join(near, ["user_id", "arrival"], "left").withColumn("top", F.coalesce(F.get("near", F.lit(0))["similarity"], F.lit(0.0)))
    f = f.select("user_id", "arrival", "text", "low", "near", "top", M.blank("anchor_time").alias("anchor_time"))
    shown = F.array_join(F.transform("near", lambda n: F.concat(F.lit("[id="), n["id"], F.lit("] "), n["old_text"])), "\n")
    open_ = (F.col("top") > APART) & (F.col("top") < SAME)
    asked = complete(f.where(open_).withColumn("prompt", F.concat(F.lit("Fact: "), F.col("text"), F.lit("\n"), shown)), "prompt", port, keep_errors=True)
    obj = T.json_object(T.strip_thinking(F.col("reply")))
    said = lambda k: F.trim(F.get_json_object(obj, f"$.{k}"))
    action = F.upper(said("action"))
    usable = F.coalesce(action.isin("ADD", "UPDATE", "NONE"), F.lit(False))
    nearest = F.get("near", F.lit(0))["id"]
    by_rule = F.when(F.col("top") >= M.SPECIFIC, "UPDATE").otherwise("ADD")
    judged = asked.select("user_id", "arrival", "text", "low", "near", "top", "anchor_time", F.when(usable, action).otherwise(by_rule).alias("action"), F.when(usable, said("target_id")).otherwise(nearest).alias("target"), F.coalesce(F.when(usable, F.nullif(said("text"), F.lit(""))), F.col("text")).alias("merged"))
    plain = f.where(~open_).select("*", F.when(F.col("top") >= SAME, "NONE").otherwise("ADD").alias("action"), F.lit(None).cast("string").alias("target"), F.col("text").alias("merged"))
    d = judged.unionByName(plain)
    target_text = F.get(F.filter("near", lambda n: n["id"] == F.col("target")), F.lit(0))["old_text"]
    d = d.withColumn("target_text", target_text).withColumn("action", F.when((F.col("action") == "UPDATE") & F.col("target_text").isNull(), "ADD").when((F.col("action") == "UPDATE") & (F.lower(F.trim("merged")) == F.lower(F.trim("target_text"))), "NONE").otherwise(F.col("action")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("top").desc(), "low", "arrival"))
    d = d.withColumn("place", place)
    claim = F.row_number().over(Window.partitionBy("user_id", "target", "action").orderBy("place"))
    d = d.withColumn("action", F.when((F.col("action") == "UPDATE") & (claim > 1), "ADD").otherwise(F.col("action")))
    earlier = F.max((F.col("action") == "ADD").cast("int")).over(Window.partitionBy("user_id", "low").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("action", F.when(earlier == 1, "NONE").otherwise(F.col("action")))
    updates = d.where("action = 'UPDATE'").select("user_id", "place", F.col("target").alias("id"), F.col("merged").alias("text"), F.lit("UPDATE").alias("event"), "anchor_time")
    adds = d.where("action = 'ADD'").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("place")).cast("long"))
    numbers = M.free_ids(old.select("user_id", "id"), adds.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    adds = adds.join(numbers, ["user_id", "k"]).select("user_id", "place", "id", "text", F.lit("ADD").alias("event"), "anchor_time")
    return updates.unionByName(adds)


def item_operations(old: DataFrame, items: DataFrame) -> DataFrame:
    """Operations from a model's items (user_id, seq, id, text, operation, target_id, merged_text), one after the other.

    Items that say NONE or carry no text change nothing. An update takes the merged text and needs a target; an
    unknown target makes it an add. An add keeps its proposed id if that is a number still free, else gets the
    smallest free one.
    """
    user = items.schema["user_id"].dataType.simpleString()

    def run(key, known, rows):
        import pandas as pd

        have, used, out = set(known["id"]), set(known["id"]), []
        text = lambda v: v.strip() if isinstance(v, str) else ""
        for r in rows.sort_values("seq").to_dict("records"):
            op, target, merged = text(r["operation"]).upper(), text(r["target_id"]), text(r["merged_text"]) or text(r["text"])
            if op == "UPDATE" and target and merged and target in have:
                out.append((key[0], r["seq"], target, merged, "UPDATE"))
                continue
            body = merged if op == "UPDATE" and target else text(r["text"]) if op == "ADD" else ""
            if not body:
                continue
            new = text(r["id"])
            if op == "UPDATE" or not new.isdigit() or new in used:
                new = next(str(n) for n in range(len(used) + 1) if str(n) not in used)
            used.add(new)
            out.append((key[0], r["seq"], new, body, "ADD"))
        return pd.DataFrame(out, columns=["user_id", "seq", "id", "text", "event"])

    both = old.select("user_id", "id").groupBy("user_id").cogroup(items.groupBy("user_id"))
    return both.applyInPandas(run, f"user_id {user}, seq long, id string, text string, event string")


def patch_report(report: DataFrame, scores: DataFrame) -> DataFrame:
    """A report's rows with the scores that the empty-answer rule changed; rows without a match keep theirs."""
    new = scores.select("conversation", "qa_index", F.col("llm_score").alias("__new"))
    return report.join(new, ["conversation", "qa_index"], "left").withColumn("llm_score", F.coalesce("__new", "llm_score")).drop("__new")


def rubric_problems(rubrics: DataFrame) -> DataFrame:
    """Generated rubrics (id, name, question) that can't be used: blank fields, repeated ids, or questions asked already."""
    again = lambda c: F.row_number().over(Window.partitionBy(F.lower(F.trim(c))).orderBy("id", "question")) > 1
    problem = F.when((M.blank("id") == "") | (M.blank("question") == ""), "blank").when(again("id"), "repeated id").when(again("question"), "repeated question")
    return rubrics.withColumn("problem", problem).where("problem IS NOT NULL")
