"""Index structures: results equal brute force, and only a part is read."""

import datetime
import math
import random
import threading

import numpy as np
import pytest

from memloom.operators import retrieval
from memloom.operators.vector_index import VectorIndex
from memloom.sources import tables

VECTORS = "user_id string, key int, embedding array<float>"
ASKED = "user_id string, qid int, embedding array<float>"


@pytest.fixture(scope="module")
def clustered(spark):
    rnd = np.random.default_rng(4)
    middles = rnd.normal(size=(30, 16))
    vectors = [("hot", i, (middles[i % 30] + 0.05 * rnd.normal(size=16)).tolist()) for i in range(1500)]
    vectors += [(None, i, rnd.normal(size=16).tolist()) for i in range(60)] + [("small", i, rnd.normal(size=3).tolist()) for i in range(2)]
    vectors += [("hot", 2000 + i, vectors[7][2]) for i in range(5)]  # ties
    vectors += [("hot", 3000, None), ("hot", 3001, [0.0] * 16), ("hot", 3002, [math.nan] * 16), ("hot", 3003, [1.0, None] * 8), ("hot", 3004, []), ("hot", 3005, [1.0, 2.0])]
    asked = [("hot", i, (middles[i] + 0.05 * rnd.normal(size=16)).tolist()) for i in range(20)] + [("hot", 50, vectors[7][2]), (None, 0, rnd.normal(size=16).tolist()), ("small", 0, [1.0, 0.5, 0.0]), ("none", 0, [1.0] * 16), ("hot", 60, None)]
    return vectors, asked, spark.createDataFrame(vectors, VECTORS), spark.createDataFrame(asked, ASKED)


def nearest(vectors, asked, k):
    usable = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float))
    out = {}
    for user, qid, q in asked:
        if usable(q):
            near = [(-round(float(unit(q) @ unit(v)), 9), key) for u, key, v in vectors if u == user and usable(v) and len(v) == len(q)]
            out |= {(user, qid, rank): key for rank, (_, key) in enumerate(sorted(near)[:k], 1)}
    return out


def found(df):
    return {(r.user_id, r.qid, r["rank"]): r.key for r in df.collect()}


@pytest.mark.parametrize("k", [1, 7, 100])
def test_vector_index_equals_brute_force(clustered, k):
    vectors, asked, rows, questions = clustered
    assert found(VectorIndex.build(rows).search(questions, k)) == nearest(vectors, asked, k)


def test_vector_index_compares_a_part(clustered):
    """Twenty-one questions of a user of 1,505 vectors in 30 clusters."""
    _, _, rows, questions = clustered
    hot = questions.where("user_id = 'hot' AND embedding IS NOT NULL")
    compared = VectorIndex.build(rows).candidates(hot, 5)
    assert compared.count() <= 21 * 1505 / 8
    assert compared.count() == compared.distinct().count()  # nothing is compared twice
    plan = compared._jdf.queryExecution().explainString(compared.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_vector_index_without_rows(clustered):
    _, _, rows, questions = clustered
    assert VectorIndex.build(rows.where("false")).search(questions, 3).count() == 0
    index = VectorIndex.build(rows)
    assert index.search(questions.where("false"), 3).count() == 0 and index.search(questions, 0).count() == 0


def test_vector_index_is_kept_and_grows(clustered, tmp_path):
    vectors, asked, rows, questions = clustered
    some = rows.where("user_id = 'hot' AND key % 3 > 0")
    index = VectorIndex.build(some).save(f"{tmp_path}/i")
    before = sorted(p.name for p in (tmp_path / "i/entries").iterdir())
    rest = rows.where("NOT (user_id <=> 'hot' AND key % 3 > 0)")
    index = index.append(rest, f"{tmp_path}/i")
    assert set(before) < {p.name for p in (tmp_path / "i/entries").iterdir()}  # appended, not rewritten
    assert found(index.search(questions, 4)) == nearest(vectors, asked, 4)
    assert found(VectorIndex.load(rows.sparkSession, f"{tmp_path}/i").search(questions, 4)) == nearest(vectors, asked, 4)


# memory tables


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def memory_rows(spark, rows):
    """(user, id, text, day[, embedding])"""
    full = [(i, u, "SHORT", 0, t, ("s", None, None, None, None, None, None, None, None), list(e) or None, datetime.datetime(2024, 1, d), datetime.datetime(2024, 1, d)) for u, i, t, d, *e in rows]
    return spark.createDataFrame(full, tables.MEMORY_SCHEMA)


def state(df):
    return {(r.user_id, r.id): (r.summary, r.created_at.day, list(r.embedding) if r.embedding else None) for r in df.collect()}


def data_files(path):
    return {str(p) for p in path.glob("data/*/*.parquet")}


def test_one_user_reads_one_bucket_and_joins_without_shuffle(spark, tmp_path):
    t = tables.MemoryTable(spark, f"{tmp_path}/m", 8)
    t.upsert(memory_rows(spark, [(f"u{i % 9}", str(i), "x", 1) for i in range(200)]))
    t.upsert(memory_rows(spark, [(f"u{i % 9}", str(i), "y", 2) for i in range(0, 200, 3)]))
    one = t.read("u3")
    assert "SelectedBucketsCount: 1 out of 8" in plan(one) and one.count() == sum(i % 9 == 3 for i in range(200))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = t.read()
        both = rows.groupBy("user_id").count().join(rows.select("user_id", "id"), "user_id")
        assert "Exchange" not in plan(rows) and "Exchange" not in plan(both) and both.count() == 200
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_writes_are_as_large_as_their_batch(spark, tmp_path):
    t = tables.MemoryTable(spark, f"{tmp_path}/m", 4)
    t.upsert(memory_rows(spark, [("u", str(i), "x" * 50, 1) for i in range(3000)]))
    before = data_files(tmp_path / "m")
    t.upsert(memory_rows(spark, [("u", "7", "new", 2), ("w", "1", "other", 2)]))
    t.clear_user("w")
    t.set_embeddings(spark.createDataFrame([("u", "7", [1.0])], "user_id string, id string, embedding array<double>"))
    added = data_files(tmp_path / "m") - before
    assert before < data_files(tmp_path / "m")
    assert sum(spark.read.parquet(f).count() for f in added) == 4
    got = state(t.read())
    assert len(got) == 3000 and got["u", "7"] == ("new", 1, [1.0])


def test_concurrent_writers_take_different_versions(spark, tmp_path):
    one, two = tables.MemoryTable(spark, f"{tmp_path}/m", 4), tables.MemoryTable(spark, f"{tmp_path}/m", 4)
    one.upsert(memory_rows(spark, [("u", "1", "a", 1)]))
    assert two.version == 0
    two.upsert(memory_rows(spark, [("u", "2", "b", 1), ("u", "1", "c", 2)]))  # from a version that is no longer the latest
    assert (one.version, two.version) == (1, 2)
    assert state(one.read()) == {("u", "1"): ("a", 1, None)}  # readers keep their version
    assert state(one.refresh().read()) == state(two.read()) == {("u", "1"): ("c", 1, None), ("u", "2"): ("b", 1, None)}
    many = [tables.MemoryTable(spark, f"{tmp_path}/m", 4) for _ in range(4)]
    threads = [threading.Thread(target=t.upsert, args=(memory_rows(spark, [("v", str(i), "t", 1)]),)) for i, t in enumerate(many)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(t.version for t in many)[-1] == one.refresh().version == 6
    assert {k for k in state(one.read()) if k[0] == "v"} == {("v", str(i)) for i in range(4)}


def test_lost_writers_are_not_seen(spark, tmp_path, monkeypatch):
    t = tables.MemoryTable(spark, f"{tmp_path}/m", 4)
    t.upsert(memory_rows(spark, [("u", "1", "a", 1)]))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(t, "_record", lost)
        with pytest.raises(RuntimeError):
            t.upsert(memory_rows(spark, [("u", "1", "never", 9)]))
    assert state(t.refresh().read()) == {("u", "1"): ("a", 1, None)} and t.version == 1
    (tmp_path / f"m/log/{2:020}.json").touch()  # lost after it took its number
    assert state(t.refresh().read()) == {("u", "1"): ("a", 1, None)}
    t.upsert(memory_rows(spark, [("u", "1", "b", 2)]))
    assert t.version == 3 and state(t.read()) == {("u", "1"): ("b", 1, None)}


def test_compaction_and_time_travel(spark, tmp_path):
    t = tables.MemoryTable(spark, f"{tmp_path}/m", 4)
    rnd, want, seen = random.Random(8), {}, {}
    late = tables.MemoryTable(spark, f"{tmp_path}/m", 4)
    for step in range(1, 9):
        if step in (3, 6):
            user = rnd.choice("ab")
            t.clear_user(user)
            want = {k: v for k, v in want.items() if k[0] != user}
        elif step == 5:
            t.compact()
        else:
            rows = [(rnd.choice("abc"), str(i), f"{step}-{i}", step, *([float(step)] if rnd.random() < 0.4 else [])) for i in rnd.sample(range(8), 5)]
            t.upsert(memory_rows(spark, rows))
            for u, i, text, day, *e in rows:
                old = want.get((u, i))
                want[u, i] = (text, old[1] if old else day, old[2] if old else list(e) or None)
        seen[step] = dict(want)
        assert state(t.read()) == want and t.version == step
    assert all(state(t.read(version=v)) == seen[v] for v in seen)
    # a writer compacts what it knew while another has gone on
    late.refresh()
    t.upsert(memory_rows(spark, [("c", "new", "x", 9)]))
    late.compact()
    assert late.version == 10 and state(late.read()) == want | {("c", "new"): ("x", 9, None)}
    files = len(data_files(tmp_path / "m"))
    late.vacuum()
    assert len(data_files(tmp_path / "m")) < files and state(t.refresh().read()) == want | {("c", "new"): ("x", 9, None)}
    spark.sql(f"DROP TABLE {t.name}")  # as in a new session, which has no catalog entry
    assert state(tables.MemoryTable(spark, f"{tmp_path}/m").read()) == want | {("c", "new"): ("x", 9, None)}


def test_keys_must_not_be_null(spark, tmp_path):
    t = tables.MemoryTable(spark, f"{tmp_path}/m", 4)
    with pytest.raises(Exception, match="a memory without user_id"):
        t.upsert(memory_rows(spark, [(None, "1", "a", 1)]))
    assert t.refresh().version == 0 and t.read().count() == 0


def test_lexical_topk_scores_only_what_shares_a_word(spark):
    rnd = random.Random(5)
    vocab = [f"word{i}" for i in range(40)]
    rows = [(rnd.choice(["u", "v"]), i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 4))) or None) for i in range(120)] + [("w", 1, "word1"), ("w", 2, "")]
    asked = [(u, q, " ".join(rnd.choice(vocab) for _ in range(q)) or None) for u in ("u", "v", "w", "x") for q in range(4)]
    m, q = spark.createDataFrame(rows, "user_id string, key int, text string"), spark.createDataFrame(asked, "user_id string, qid int, text string")
    for k in (1, 5, 200):
        want = {}
        for user, qid, text in asked:
            words = set((text or "").split())
            near = sorted((-len(words & set((t or "").split())) / max(1, len(words)), key) for u, key, t in rows if u == user)
            want |= {(user, qid, rank): (key, -score) for rank, (score, key) in enumerate(near[:k], 1)}
        assert {(r.user_id, r.qid, r["rank"]): (r.key, r.score) for r in retrieval.lexical_topk(q, m, k).collect()} == want
