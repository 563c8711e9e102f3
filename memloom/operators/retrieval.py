"""Retrieval: BM25, cosine and lexical top-k per user, rank fusion, and the gated second hop.

Memories are rows (user_id, key, text[, embedding]) and questions are rows (user_id, qid, text[, embedding]).
Everything is keyed by user_id: corpora are never compared across users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed
from .vector_index import VectorIndex

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K = 60


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark trims groups before the shuffle (WindowGroupLimit)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def bm25_statistics(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term frequencies with document length, idf per user and term).

    idf = ln(N - df + 0.5) - ln(df + 0.5); negative ones become EPSILON times the mean idf of the user's vocabulary.
    """
    tokens = checkpointed(memories.select("user_id", "key", T.content_tokens(F.col("text")).alias("tokens")))
    corpus = tokens.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("tokens").cast("double")).alias("avgdl"))
    tf = tokens.select("user_id", "key", F.size("tokens").cast("double").alias("dl"), F.explode("tokens").alias("term"))
    tf = tf.groupBy("user_id", "key", "dl", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = tf.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("df"))
    raw = F.log(F.col("n") - F.col("df") + F.lit(0.5)) - F.log(F.col("df") + F.lit(0.5))
    idf = df.join(corpus, "user_id").withColumn("raw", raw)
    mean = idf.groupBy("user_id").agg(F.avg("raw").alias("mean"))
    floor = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return tf, idf.join(mean, "user_id").select("user_id", "term", floor.alias("idf"), "avgdl")


def bm25(questions: DataFrame, memories: DataFrame) -> DataFrame:
    """(user_id, qid, key, bm25) of memories that share a term; a question's repeated terms count again. Scores <= 0 are dropped."""
    tf, idf = bm25_statistics(memories)
    asked = questions.select("user_id", "qid", F.explode(T.content_tokens(F.col("text"))).alias("term"))
    asked = asked.groupBy("user_id", "qid", "term").agg(F.count(F.lit(1)).cast("double").alias("times"))
    weight = F.col("times") * F.col("idf") * (F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
    hits = asked.join(idf, ["user_id", "term"]).join(tf, ["user_id", "term"])
    return hits.groupBy("user_id", "qid", "key").agg(F.sum(weight).alias("bm25")).where("bm25 > 0")


def bm25_topk(questions: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    # scores that differ in the last bits only are ties, broken by key
    return top_k(bm25(questions, memories), ["user_id", "qid"], [F.round("bm25", 9).desc(), F.col("key")], k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_topk(questions: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """(user_id, qid, key, cosine, rank) of the k nearest memories that have an embedding; none for k <= 0.

    An index is built for the call; to ask more than once, keep a ``VectorIndex``. Null, zero and non-finite embeddings have no neighbours.
    """
    return VectorIndex.build(memories).search(questions, k)


def lexical_topk(questions: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """(user_id, qid, key, score, rank) by the share of the question's content words; zero scores stay in.

    Only memories that share a word are scored, through (user, word). A question that has fewer than k of them is filled
    up with the user's first keys that aren't among them, which are among the first k keys. Keys are unique per user.
    """
    words = lambda c: F.array_distinct(T.content_tokens(F.col(c)))
    asked = questions.select("user_id", "qid", words("text").alias("words"))
    terms = asked.select("user_id", "qid", F.size("words").alias("n"), F.explode("words").alias("term"))
    postings = memories.select("user_id", "key", F.explode(words("text")).alias("term"))
    shared = terms.join(postings, ["user_id", "term"]).groupBy("user_id", "qid", "n", "key").agg(F.count(F.lit(1)).alias("c"))
    order = [F.col("score").desc(), F.col("key")]
    scored = checkpointed(top_k(shared.select("user_id", "qid", "key", (F.col("c") / F.col("n")).alias("score")), ["user_id", "qid"], order, k))
    found = scored.groupBy("user_id", "qid").agg(F.max("rank").alias("found"))
    short = asked.join(found, ["user_id", "qid"], "left").where(F.coalesce("found", F.lit(0)) < k).select("user_id", "qid")
    first = top_k(memories.select("user_id", "key"), ["user_id"], [F.col("key")], k).drop("rank")
    fill = short.join(first, "user_id").join(scored.select("user_id", "qid", "key"), ["user_id", "qid", "key"], "left_anti")
    return top_k(scored.drop("rank").unionByName(fill.withColumn("score", F.lit(0.0))), ["user_id", "qid"], order, k)


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(user_id, qid, key, rrf): reciprocal ranks of all rankings (user_id, qid, key, rank) summed."""
    ranked = rankings[0].select("user_id", "qid", "key", "rank")
    for r in rankings[1:]:
        ranked = ranked.unionByName(r.select("user_id", "qid", "key", "rank"))
    return ranked.groupBy("user_id", "qid", "key").agg(F.sum(F.lit(1.0) / (F.lit(max(1, k)) + F.col("rank"))).alias("rrf"))


def channel_scores(lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """Scores of both channels by memory; one is null where only the other recalled it."""
    a = lexical.select("user_id", "qid", "key", "bm25")
    return a.join(dense.select("user_id", "qid", "key", "cosine"), ["user_id", "qid", "key"], "full")


def hybrid_recall(questions: DataFrame, memories: DataFrame, k: int, recall_k: int = 80, rrf_k: int = RRF_K) -> DataFrame:
    """(user_id, qid, key, rrf, rank): BM25 and dense recall fused; questions that neither serves fall back to words.

    The fallback's rows carry rrf 0.0.
    """
    deep = max(k, recall_k)
    sparse, dense = bm25_topk(questions, memories, deep), cosine_topk(questions, memories, deep)
    fused = checkpointed(top_k(rrf([sparse, dense], rrf_k), ["user_id", "qid"], [F.round("rrf", 12).desc(), F.col("key")], k))
    missed = questions.join(fused.select("user_id", "qid").distinct(), ["user_id", "qid"], "left_anti")
    missed = checkpointed(missed.select("user_id", "qid", "text"))  # only their users' memories are cut into words
    theirs = memories.select("user_id", "key", "text").join(missed.select("user_id").distinct(), "user_id", "left_semi")
    spare = lexical_topk(missed, theirs, k).select("user_id", "qid", "key", F.lit(0.0).alias("rrf"), "rank")
    return fused.select("user_id", "qid", "key", "rrf", "rank").unionByName(spare)


#: The markers of the second-hop gate, in the order of its rules.
LIST_MARKERS = ("what are ", "what were ", "what items", "what things", "what names", "what symbols", "what musical artists", "what artists", "what bands", "what pets", "what ways", "which ", "list ", "how many", "in what ways")
BRIDGE_MARKERS = ("from caroline's suggestion", "from melanie's suggestion", "recommended", "suggestion", "because of", "as a result", "related to", "relationship between", "the book", "the photo", "in the photo", "that caroline", "that melanie")
COMPOUND_MARKERS = ("friends", "family", "mentors", "pets", "children")


def contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def multihop_gate(question: Column, category: Column, qa_type: Column, n_options: Column) -> Column:
    """Why a question gets a second hop: inference, structured_list, options, list, bridge, compound, or '' (the first rule that holds)."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return (
        F.when((F.trim(category) == "3") | q.startswith("would ") | q.startswith("could "), "inference")
        .when(F.lower(F.trim(qa_type)).isin("multi_select", "ordering"), "structured_list")
        .when(n_options > 1, "options")
        .when(contains_any(q, LIST_MARKERS), "list")
        .when(contains_any(q, BRIDGE_MARKERS), "bridge")
        .when(q.contains(" and ") & contains_any(q, COMPOUND_MARKERS), "compound")
        .otherwise("")
    )


def multihop_merge(hops: DataFrame, k: int) -> DataFrame:
    """(user_id, qid, key, score, rank): union of all hops (user_id, qid, hop, rank, key, score).

    Keys stand in order of their first hop and rank there, once, with their best score; at most k a question.
    """
    first = hops.groupBy("user_id", "qid", "key").agg(F.min(F.struct("hop", "rank")).alias("first"), F.max("score").alias("score"))
    return top_k(first, ["user_id", "qid"], [F.col("first"), F.col("key")], k).drop("first")


def payload(selected: DataFrame, memories: DataFrame) -> DataFrame:
    """Retrieval block per question from (user_id, qid, rank, key, score): memories in rank order; unknown keys are skipped.

    A missing score counts 1.0; success says whether any memory was selected.
    """
    rows = selected.join(memories.select("user_id", "key", "text"), ["user_id", "key"])
    item = F.struct("rank", F.col("key").alias("id"), "text", F.coalesce("score", F.lit(1.0)).alias("score"))
    blocks = rows.groupBy("user_id", "qid").agg(F.array_sort(F.collect_list(item)).alias("selected"))
    asked = selected.select("user_id", "qid").distinct()
    return asked.join(blocks, ["user_id", "qid"], "left").select("user_id", "qid", F.coalesce(F.size("selected") > 0, F.lit(False)).alias("success"), "selected")


def support_facts(items: DataFrame, facts: DataFrame, limit: int) -> DataFrame:
    """Facts that support an item by shared words, then the group's other facts in order up to ``limit``.

    ``items(group, item, text)`` and ``facts(group, fact, pos, text)``. Supporting facts stand by overlap, then fewer words, then number.
    """
    i = items.select("group", "item", F.array_distinct(T.plain_tokens(F.col("text"))).alias("a"))
    f = facts.select("group", "fact", "pos", T.plain_tokens(F.col("text")).alias("b"))
    both = i.join(f, "group").withColumn("overlap", F.size(F.array_intersect("a", "b")).cast("long"))
    hit = F.col("overlap") > 0
    order = [hit.cast("int").desc(), F.when(hit, F.col("overlap")).desc_nulls_last(), F.when(hit, F.size("b")), F.when(hit, F.col("fact").try_cast("long")), F.col("pos"), F.col("fact")]
    return top_k(both, ["group", "item"], order, limit).select("group", "item", "fact", "overlap", "rank")
