"""Session drivers: what a model extracts from a session, made into operations and folded into memory, session by session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..ports import TextPort, complete
from ..session import checkpointed
from . import memory as M
from . import retrieval as R

#: Kinds of facts and of items, and what an item may ask for.
FACT_TYPES = ("event", "plan", "state", "feeling", "negative", "attribute")
ITEM_TYPES = ("fact", "character", "event", "location")
ITEM_OPERATIONS = ("ADD", "UPDATE", "NONE")
#: Names under which a reply may hold its list, and a fact its text.
MEMORY_KEYS = ("memory", "memories", "data", "items")
FACT_KEYS = ("fact", "text", "content", "description")

_MEMORY = "user_id {0}, pos long, id string, text string, event string, anchor_time string, event_anchor string, type string"


def _said(entry: Column, key: str) -> Column:
    """A field of a JSON object as trimmed text; blank where it is missing."""
    return F.trim(F.coalesce(F.get_json_object(entry, f"$.{key}"), F.lit("")))


def _list(obj: Column, key: str) -> Column:
    """The list under ``key``, each entry as its JSON (strings bare); null if there is none."""
    raw = F.get_json_object(obj, f"$.{key}")
    return F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>"))


def _is_object(entry: Column) -> Column:
    return F.ltrim(entry).startswith("{")


def extracted_facts(obj: Column) -> Column:
    """Facts (text, type) of a reply's object: entries that aren't objects or have no text are dropped, unknown types are events.

    Null where the reply has no list of facts, which is a failed extraction.
    """
    text = lambda e: F.coalesce(F.nullif(_said(e, "fact"), F.lit("")), _said(e, "text"))
    kind = lambda e: F.when(F.lower(_said(e, "type")).isin(*FACT_TYPES), F.lower(_said(e, "type"))).otherwise(F.lit("event"))
    facts = F.transform(F.filter(_list(obj, "facts"), _is_object), lambda e: F.struct(text(e).alias("text"), kind(e).alias("type")))
    return F.filter(facts, lambda f: f["text"] != "")


def extracted_items(obj: Column) -> Column:
    """Items (id, text, anchor_time, type, operation, target_id, merged_text, reason): those with an unknown type or operation, or no text, are dropped."""
    blank = lambda e, k: F.nullif(_said(e, k), F.lit(""))
    item = lambda e: F.struct(
        _said(e, "id").alias("id"), _said(e, "text").alias("text"), _said(e, "anchor_time").alias("anchor_time"), F.lower(_said(e, "type")).alias("type"), F.upper(_said(e, "operation")).alias("operation"),
        blank(e, "target_id").alias("target_id"), blank(e, "merged_text").alias("merged_text"), _said(e, "reason").alias("reason"),
    )
    items = F.transform(F.filter(_list(obj, "items"), _is_object), item)
    return F.filter(items, lambda i: (i["text"] != "") & i["type"].isin(*ITEM_TYPES) & i["operation"].isin(*ITEM_OPERATIONS))


def memory_entries(obj: Column) -> Column:
    """Objects of the first of ``MEMORY_KEYS`` that holds a list or a single object; none if there is none."""
    none = F.array().cast("array<string>")
    raw = lambda k: F.ltrim(F.get_json_object(obj, f"$.{k}"))
    found = [F.when(raw(k).startswith("["), F.filter(_list(obj, k), _is_object)).when(raw(k).startswith("{"), F.array(raw(k))) for k in MEMORY_KEYS]
    return F.coalesce(*found, none)


def fact_text(entry: Column) -> Column:
    """Text of a fact that may be a string or an object with one of ``FACT_KEYS``; other objects give ``key: value; ...``."""
    named = F.coalesce(*[F.nullif(_said(entry, k), F.lit("")) for k in FACT_KEYS])
    pairs = F.transform(F.json_object_keys(entry), lambda k: F.struct(k.alias("k"), F.trim(F.from_json(entry, "map<string,string>")[k]).alias("v")))
    listed = F.array_join(F.transform(F.filter(pairs, lambda p: p["v"] != ""), lambda p: F.concat(p["k"], F.lit(": "), p["v"])), "; ")
    return F.when(_is_object(entry), F.coalesce(named, listed)).otherwise(F.trim(entry))


def fold_sessions(sessions: DataFrame, port: TextPort, similarity=M.jaccard_similarity, with_time: bool = True, slots: bool = True) -> tuple[DataFrame, DataFrame]:
    """(memory, writes): ``sessions(user_id, session, text, anchor_time)`` of all users folded one after the other.

    All users' n-th sessions are one step: the model is asked for facts, these are decided against the memory so far and
    applied. A session whose reply has no list of facts adds its lines as they are. Then the derived rows
    are brought up to date. Missing sessions are skipped. Every step is written before the next, so no call is repeated,
    and there are as many steps as the longest conversation has sessions. ``writes`` has the rows (user_id, session, id, text, event) that
    each session stored.
    """
    spark = sessions.sparkSession
    memory = spark.createDataFrame([], _MEMORY.format(sessions.schema["user_id"].dataType.simpleString()))
    writes = None
    numbers = sorted(r[0] for r in sessions.select("session").distinct().collect())
    for n in numbers:
        now = sessions.where(F.col("session") == n).select("user_id", F.coalesce("text", F.lit("")).alias("text"), M.blank("anchor_time").alias("anchor_time"))
        held = memory.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda m: m["text"]), "\n").alias("held"))
        prompt = F.concat(F.lit("Memory:\n"), F.coalesce("held", F.lit("")), F.lit("\nSession:\n"), F.col("text"))
        told = complete(now.join(held, "user_id", "left").withColumn("prompt", prompt).drop("held"), "prompt", port, keep_errors=True)
        told = checkpointed(told.withColumn("facts", extracted_facts(T.json_object(T.strip_thinking(F.col("reply"))))).drop("prompt", "reply", "error"))
        facts = told.where("facts IS NOT NULL").select("user_id", "anchor_time", F.posexplode("facts").alias("arrival", "f")).select("user_id", F.col("arrival").cast("long").alias("arrival"), "f.text", "f.type", "anchor_time")
        ops = M.decide(memory, facts, similarity, with_time).select("user_id", "seq", "id", "text", "event", "anchor_time")
        failed = told.where("facts IS NULL")
        lines = failed.select("user_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
        spare = M.append_unknown(memory.join(failed.select("user_id"), "user_id", "left_semi"), lines).join(failed.select("user_id", "anchor_time"), "user_id")
        order = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("id").cast("long")))
        spare = spare.select("user_id", order.cast("long").alias("seq"), "id", "text", F.lit("ADD").alias("event"), "anchor_time")
        ops = ops.unionByName(spare).withColumns({"event_anchor": F.lit(""), "type": F.lit("")})
        merged = checkpointed(M.apply_delta(memory, ops))
        stored = [merged]
        if slots:
            derived = M.slot_operations(merged, now.select("user_id", "anchor_time")).withColumns({"event_anchor": F.lit(""), "type": F.lit("")})
            merged = checkpointed(M.apply_delta(merged.drop("written"), derived))
            stored.append(merged)
        memory = merged.select(*memory.columns)
        for rows in stored:
            new = rows.where("written").select("user_id", F.lit(n).alias("session"), "id", "text", "event")
            writes = new if writes is None else writes.unionByName(new)
    return memory, writes


def followup_queries(obj: Column, question: Column, most: int) -> Column:
    """Queries of a reply for the second hop: not blank, not the question again, without repeats, at most ``most``."""
    said = F.transform(F.coalesce(_list(obj, "queries"), F.array().cast("array<string>")), lambda q: F.trim(F.coalesce(q, F.lit(""))))
    fresh = F.filter(said, lambda q: (q != "") & (F.lower(q) != F.lower(F.trim(question))))
    return F.slice(F.array_distinct(fresh), 1, most)


def second_hop(questions: DataFrame, first: DataFrame, recalled: DataFrame, memories: DataFrame, recall, asker: TextPort, picker_select, k: int, most: int = 2) -> DataFrame:
    """(user_id, qid, key, score, rank): a first selection completed by a second hop.

    A model names follow-up queries from the memories selected first; ``recall(questions)`` (user_id, qid, key, score, rank) finds memories for
    each; ``picker_select(questions, candidates)`` selects again among all recalled ones for the question with the first hop's clues. The first
    selection comes first, then what the second adds. Questions without a selection or a usable query keep the first.
    """
    rows = first.join(memories.select("user_id", "key", "text"), ["user_id", "key"])
    clues = rows.groupBy("user_id", "qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda m: F.concat(F.lit("- "), m["text"])), "\n").alias("clues"))
    asked = questions.join(clues, ["user_id", "qid"]).withColumn("prompt", F.concat(F.lit("Question: "), F.col("text"), F.lit("\nMemories:\n"), F.col("clues")))
    told = checkpointed(complete(asked, "prompt", asker, keep_errors=True).withColumn("queries", followup_queries(T.json_object(T.strip_thinking(F.col("reply"))), F.col("text"), most)).drop("prompt", "reply", "error"))
    more = told.select("user_id", "qid", F.posexplode("queries").alias("hop", "query"))
    extra = recall(more.select("user_id", F.struct("qid", "hop").alias("qid"), F.col("query").alias("text")))
    hops = extra.select("user_id", F.col("qid.qid").alias("qid"), (F.col("qid.hop") + 1).alias("hop"), "rank", "key", "score").unionByName(recalled.select("user_id", "qid", F.lit(0).alias("hop"), "rank", "key", "score"))
    second = told.where("size(queries) > 0").select("user_id", "qid", F.concat("text", F.lit("\n\nFirst-hop clues:\n"), "clues").alias("text"))
    every = checkpointed(R.multihop_merge(hops, 1 << 30).join(second.select("user_id", "qid"), ["user_id", "qid"], "left_semi"))
    picked = picker_select(second, every)
    both = first.select("user_id", "qid", F.lit(0).alias("hop"), "rank", "key", "score").unionByName(picked.select("user_id", "qid", F.lit(1).alias("hop"), "rank", "key", "score"))
    return R.multihop_merge(both, k)


def judge_answers(answered: DataFrame, port: TextPort) -> DataFrame:
    """``answered(..., question, gold, predicted)`` with llm_score (1 or 0) and llm_reason of a judge's reply; without a reply 0."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    prompt = F.concat(F.lit("Question: "), text("question"), F.lit("\nGold answer: "), text("gold"), F.lit("\nGenerated answer: "), text("predicted"))
    told = complete(answered.withColumn("prompt", prompt), "prompt", port, keep_errors=True)
    reply = F.coalesce(T.strip_thinking(F.col("reply")), F.lit(""))
    label = F.get_json_object(T.json_object(reply), "$.label")
    return told.withColumns({"llm_score": T.judge_label(label, reply), "llm_reason": T.judge_reason(reply)}).drop("prompt", "reply", "error")


def peers(items: DataFrame) -> DataFrame:
    """Each of ``items(group, type, item, text)`` with the others of its type in its group, in order of item: (group, type, item, peers)."""
    held = items.groupBy("group", "type").agg(F.array_sort(F.collect_list(F.struct("item", "text"))).alias("every"))
    return items.join(held, ["group", "type"]).select("group", "type", "item", F.filter("every", lambda p: p["item"] != F.col("item")).alias("peers"))


def attach(dataset: DataFrame, snapshots: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of the dataset with their snapshot, rows of the dataset that have none)."""
    return dataset.join(snapshots, keys), dataset.join(snapshots.select(*keys), keys, "left_anti").select(*keys)


def session_changes(snapshots: DataFrame, operations: DataFrame) -> DataFrame:
    """(user_id, session, id, change): a session's explicit operations (user_id, session, id, event), where it has any, win over the derived difference.

    NONE is no change.
    """
    from .rubric import snapshot_diff

    said = operations.select("user_id", "session", "id", F.upper(M.blank("event")).alias("event"))
    named = {"ADD": "new", "UPDATE": "changed", "DELETE": "deleted"}
    change = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("event")]
    explicit = said.withColumn("change", change).where("change IS NOT NULL").select("user_id", "session", "id", "change")
    derived = snapshot_diff(snapshots).join(said.select("user_id", "session").distinct(), ["user_id", "session"], "left_anti")
    return explicit.unionByName(derived.select("user_id", "session", "id", "change"))
