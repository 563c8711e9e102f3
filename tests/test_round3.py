"""Findings of the third round: results that changed with size."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memloom.functions import udfs
from memloom.operators import evaluation as E
from memloom.operators import memory as M
from memloom.streaming.session_fold import fold_session


def test_rows_are_numbered_alike_wherever_they_are_read(spark):
    """rows and their counts must come from the same ranges, also where narrow rows are merged into fewer."""
    rows = spark.range(200_000, numPartitions=4).select((F.col("id") * 7919 % 200_000).alias("id"), F.sha2(F.col("id").cast("string"), 512).alias("load"))
    got = E.row_numbers(rows, "id")
    assert got.where("rn = id AND total = 200000 AND load > ''").count() == 200_000
    assert {r.id for r in E.systematic_sample(rows, "id", 16).collect()} == set(range(0, 200_000, 12_500))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(rng, n):
    words = [f"w{i}" for i in range(60)]
    out = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 12, 30]), weights=range(60, 0, -1))) for _ in range(n)]
    return out + [" ".join([*t.split()[1:], "new"]) for t in out[: n // 2]] + out[: n // 4]


def jaccard(a, b):
    a, b = set(a.split()), set(b.split())
    return len(a & b) / len(a | b) if a and b else 0.0


def nearest_by_hand(facts, olds, k, least):
    want = {}
    for u, i, t in facts:
        every = sorted(((-jaccard(t, o), p) for v, p, o in olds if v == u and u is not None))[:k]
        want |= {(u, i, p): -s for s, p in every if -s >= least}
    return want


def test_blocks_find_what_brute_force_finds(spark, monkeypatch):
    """tiles of several blocks, postings and products, give the nearest of all pairs; no pair becomes a row."""
    from memloom.operators import alike

    monkeypatch.setattr(alike, "LETTERS", 900)
    monkeypatch.setattr(alike, "ROWS", 7)
    monkeypatch.setattr(alike, "COLUMNS", 9)
    monkeypatch.setattr(alike, "WORDS", 3)
    rng = random.Random(3)
    users = ["a", "b", None]
    facts = [(u, i, t) for u in users for i, t in enumerate(texts(rng, 40))] + [("c", 0, "w1")]
    stored = texts(rng, 40) + [f[2] for f in facts[:30]]
    olds = [(u, p, t) for u in users for p, t in enumerate(rng.sample(stored, len(stored)))]
    new, old = spark.createDataFrame(facts, "user_id string, arrival long, text string"), spark.createDataFrame(olds, "user_id string, pos long, text string").withColumn("id", F.lpad(F.col("pos").cast("string"), 4, "0"))
    for share in (0.0045, 2.0):
        monkeypatch.setattr(alike, "FREQUENT", share)
        got = M.candidates(new, old, M.jaccard_similarity, 3)
        assert {(r.user_id, r.arrival, int(r.id)): r.similarity for r in got.collect()} == nearest_by_hand(facts, olds, 3, 0)
        near = M.related(new.withColumnRenamed("text", "fact"), old)
        want = nearest_by_hand(facts, olds, 1, 0.7)
        assert len(want) > 30 and {(r.user_id, r.arrival, r.pos): r.score for r in near.collect()} == want


def test_pairs_and_texts_are_not_joined(spark):
    """the nearest need no join, and a delta that names no id twice no grouping of whole tables."""
    new, old = spark.createDataFrame([("a", 0, "x y")], "user_id string, arrival long, text string"), spark.createDataFrame([("a", 0, "0", "x y")], "user_id string, pos long, id string, text string")
    assert "Join" not in plan(M.candidates(new, old, M.jaccard_similarity, 3))
    assert "Join" not in plan(M.related(new.withColumnRenamed("text", "fact"), old))
    old = old.select("*", *[F.lit("").alias(c) for c in ("event", "anchor_time", "event_anchor", "type")])
    assert "CoGroup" not in plan(M.apply_delta(old, old.withColumnRenamed("pos", "seq")))


MOVED = {
    "alloc_ids": "events", "answer_postprocess": "conversations", "json_extract": "conversations", "judge_parse": "conversations", "db_identifier": "pages", "decide_judged": "conversations", "item_operations": "conversations", "facts_for_speaker": "conversations", "final_scores": "events", "invalid_records": "conversations", "join_values": "events", "json_repair": "events",
}


@pytest.mark.parametrize("name", MOVED)
def test_reads_its_table(spark, name):
    """F10 to F21: Spark reads the table."""
    files = entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
    assert {f.rsplit("/", 1)[1] for f in files} == {f"{MOVED[name]}.parquet"}


def test_far_texts_are_not_aligned(monkeypatch):
    """a fact far from every memory costs no sequence match, and near ones keep their similarity."""
    rng = random.Random(8)
    calls = []
    ratio = udfs.SequenceMatcher.ratio
    monkeypatch.setattr(udfs.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    far = ["".join(rng.choices("abcdefghijklmnopqrst ", k=500)) for _ in range(6)]
    assert len(fold_session([{"id": "0", "text": far[0]}], [{"text": t, "type": "event"} for t in far[1:]])) == 5 and not calls
    for _ in range(200):
        a = "".join(rng.choices("abc ", k=rng.randint(1, 60)))
        b = "".join(c if rng.random() > 0.2 else rng.choice("abc ") for c in a)
        whole, bounded = udfs.similarity(a, b), udfs.similarity_from(0.7, a, b)
        assert whole == bounded if whole >= 0.7 else bounded <= whole
