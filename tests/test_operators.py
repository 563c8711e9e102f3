"""Operators against plain Python: sequential re-statements, published examples, seeded random cases."""

import collections
import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memloom.functions import dates, scores, udfs
from memloom.operators import memory as M
from memloom.operators import rubric as R
from memloom.plans.flow import Flow, step_range
from memloom.plans.flow_queries import session_facts
from memloom.ports import BudgetExceeded, Caller, FunctionPort, Limits, complete
from memloom.sources import dialogue, tables
from memloom.streaming import session_fold as S

SF = "/root/testdata/sf0.001"


def sequential_decide(old, facts):
    """One fact after the other, with Jaccard similarity and no times."""
    token = lambda t: set(udfs._TOKEN.findall(t.lower()))
    share = lambda a, b: len(token(a) & token(b)) / len(token(a) | token(b)) if token(a) and token(b) else 0.0
    known, used, best, adds = {t.lower() for _, t in old}, {i for i, _ in old}, {}, []
    for text, kind in facts:
        if text.lower() in known:
            continue
        target, top = "", 0.0
        for i, t in old:
            if share(text, t) > top:
                target, top = i, share(text, t)
        if target and top >= 0.92:
            continue
        if target and top >= 0.70 and (kind == "plan" or top >= 0.75 and len(token(text) - token(dict(old)[target])) >= 2):
            if target not in best or top > best[target][0]:
                best[target] = (top, text)
            continue
        n = next(str(k) for k in range(1000) if str(k) not in used)
        used.add(n)
        adds.append((n, text, "ADD"))
        known.add(text.lower())
    return [(i, t, "UPDATE") for i, (_, t) in sorted(best.items(), key=lambda kv: -kv[1][0])] + adds


def random_cases(n):
    rnd = random.Random(11)
    for u in range(n):
        base = [" ".join(rnd.sample("a1 b2 c3 d4 e5 f6 g7 h8 i9 j0 k1 l2".split(), rnd.randint(3, 9))) for _ in range(5)]
        old = [(str(rnd.choice([k, 10 + k])), t) for k, t in enumerate(base[: rnd.randint(0, 5)])]
        facts = []
        for _ in range(rnd.randint(1, 8)):
            words = rnd.choice(base).split()
            if rnd.random() < 0.7:
                words = words[: rnd.randint(2, len(words))] + rnd.sample("x1 y2 z3 w4".split(), rnd.randint(0, 3))
            facts.append((" ".join(words), rnd.choice(["plan", "event"])))
        yield f"u{u}", old, facts


def test_decide_is_the_sequential_rule(spark):
    cases = list(random_cases(150))
    old = spark.createDataFrame([(u, k, i, t, "") for u, o, _ in cases for k, (i, t) in enumerate(o)], "user_id string, pos long, id string, text string, anchor_time string")
    facts = spark.createDataFrame([(u, k, t, kind, "") for u, _, f in cases for k, (t, kind) in enumerate(f)], "user_id string, arrival long, text string, type string, anchor_time string")
    got = {}
    for r in M.decide(old, facts, with_time=False).orderBy("user_id", "seq").collect():
        got.setdefault(r.user_id, []).append((r.id, r.text, r.event))
    for u, o, f in cases:
        want = sequential_decide(o, f)
        assert sorted(got.get(u, [])) == sorted(want), u
        assert [x for x in got.get(u, []) if x[2] == "ADD"] == [x for x in want if x[2] == "ADD"]


def test_apply_delta_joined_and_folded_agree(spark):
    rnd = random.Random(5)
    old, ops, single = [], [], {}
    for u in range(60):
        table = [dict(user_id=f"u{u}", pos=k, id=str(k), text=f"t{rnd.randint(0, 3)}", event="ADD", anchor_time=rnd.choice(["", "2020"]), event_anchor=rnd.choice(["", "e"]), type=rnd.choice(["", "fact"])) for k in range(rnd.randint(0, 5))]
        batch = [dict(user_id=f"u{u}", seq=k, id=str(rnd.randint(0, 7)), text=rnd.choice(["", "t1", "new"]), event=rnd.choice(["ADD", "UPDATE", "NONE", "delete"]), anchor_time=rnd.choice(["", "2021"]), event_anchor=rnd.choice(["", "f"]), type=rnd.choice(["", "Event"])) for k in range(rnd.randint(0, 6))]
        old += table
        ops += batch
        clean = [dict(o, event=o["event"].upper(), type=o["type"].lower()) for o in batch]
        single[f"u{u}"] = [(r["id"], r["text"], r["event"], r["anchor_time"], r["event_anchor"], r["type"], r["written"]) for r in M._fold(table, clean)]
    o = spark.createDataFrame(old, "user_id string, pos long, id string, text string, event string, anchor_time string, event_anchor string, type string")
    n = spark.createDataFrame(ops, "user_id string, seq long, id string, text string, event string, anchor_time string, event_anchor string, type string")
    got = {}
    for r in M.apply_delta(o, n).orderBy("user_id", "pos").collect():
        got.setdefault(r.user_id, []).append((r.id, r.text, r.event, r.anchor_time, r.event_anchor, r.type, r.written))
    assert got == {u: rows for u, rows in single.items() if rows}


@pytest.mark.parametrize(
    "text,anchor,value",
    [("yesterday", "2023-05-08", "2023-05-07"), ("last Saturday", "2023-05-25", "2023-05-20"), ("next month", "2023-06-09", "2023-07"), ("two weekends ago", "2023-07-17", "2023-07-08 to 2023-07-09"), ("next month", "5 December, 2023", "2024-01"), ("last monday", "May 8th, 2023", "2023-05-01"), ("x", "2023-05-08", ""), ("today", "2023-02-30", ""), ("0 weekends ago", "2023-07-17", "2023-07-15 to 2023-07-16")],
)
def test_relative_times(spark, text, anchor, value):
    df = spark.createDataFrame([(text, anchor)], "t string, a string")
    assert df.select(dates.resolved_value(F.col("t"), F.col("a"))).first()[0] == value


def test_similarity_is_not_symmetric():
    assert udfs.similarity("tide", "diet") != udfs.similarity("diet", "tide") or udfs.similarity("a b", "a b") == 1.0
    assert udfs.similarity("", "x") == 0.0 and udfs.similarity("The CAT!", "the cat") == 1.0


def test_score_coercions(spark):
    df = spark.createDataFrame([("0.26",), ("junk",), ("-1",), ("7",), ("true",), ("1.0",), ("0.123456",)], "s string")
    got = df.select(scores.clamp(F.col("s")), scores.trilevel(F.col("s")), scores.binary(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(0.26, 0.5, 0), (0.0, 0.0, 0), (0.0, 0.0, 0), (1.0, 1.0, 0), (0.0, 0.0, 1), (1.0, 1.0, 1), (0.1235, 0.0, 0)]


def test_published_rubric_arithmetic(spark):
    one = spark.range(1)
    assert round(one.select(R.count_weighted(F.lit(0.8929), F.lit(228), F.lit(0.8737), F.lit(105))).first()[0], 4) == 0.8868
    assert one.select(R.strict_score(F.lit(10), F.lit(11), F.lit(1), F.lit(10))).first()[0] == 0.8182
    assert one.select(R.count_weighted(F.lit(1.0), F.lit(0), F.lit(1.0), F.lit(0))).first()[0] == 0.0


def test_gate_exactly_at_its_threshold(spark):
    defs = spark.createDataFrame([("a", 1.0, True), ("b", 3.0, False)], "rubric string, weight double, is_gate boolean")
    raw = spark.createDataFrame([(1, "a", 0, "0.3"), (1, "b", 0, "1"), (2, "a", 0, "0.31"), (2, "b", 0, "1"), (2, "a", 1, "0")], "unit int, rubric string, pos int, score string")
    assert {r.unit: r.score for r in R.weighted_capped(raw, defs, raw, ["unit"]).collect()} == {1: 0.4, 2: 0.8275}


def test_snapshot_diff_sees_returning_ids(spark):
    rows = [("u", 1, "a", "x"), ("u", 1, "b", "x"), ("u", 2, "a", "x"), ("u", 3, "a", "y"), ("u", 3, "b", "x")]
    s = spark.createDataFrame(rows, "user_id string, session int, id string, text string").withColumns({"event": F.lit("ADD"), "anchor_time": F.lit("")})
    got = {(r.session, r.id): r.change for r in R.snapshot_diff(s).collect()}
    assert got == {(1, "a"): "new", (1, "b"): "new", (3, "a"): "changed", (3, "b"): "new"}


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    """Sessions out of order, and one without facts; a closing row of another user moves the watermark past the last sessions."""
    facts = session_facts(spark, SF).where("session <> 2 OR user_id % 2 = 0")
    rows = facts.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("session") * 3600))
    end = spark.createDataFrame([("end", 1, 0, "", "", datetime.datetime(2030, 1, 1))], rows.schema)
    # later sessions arrive before earlier ones
    rows.where("session % 2 = 0").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    rows.where("session % 2 = 1").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    end.coalesce(1).write.parquet(f"{tmp_path}/in/3")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = S.stream_fold(stream, "2 days").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(300)
    key = lambda df: sorted(map(tuple, df.collect()))
    got = key(spark.read.parquet(f"{tmp_path}/out"))
    assert got == key(S.batch_fold(facts)) and len({r[1] for r in got}) > 2


def test_fold_passes_over_sessions_without_facts(spark):
    facts = spark.createDataFrame([("u", 1, 0, "one thing", "event"), ("u", 3, 0, "quite another", "event"), ("u", 4, 0, "a third matter", "event")], "user_id string, session long, arrival long, text string, type string")
    assert [(r.session, r.text) for r in sorted(S.batch_fold(facts).collect())] == [(1, "one thing"), (3, "quite another"), (4, "a third matter")]


def test_session_driver_is_the_sequential_rule(spark):
    """Session by session in plain Python: the stand-in's facts, or the lines where it fails."""
    from memloom.plans import session_queries as Q

    sessions = collections.defaultdict(dict)
    for r in sorted(spark.read.parquet(f"{SF}/conversations.parquet").collect()):
        sessions[str(r.conv_id)].setdefault(r.turn // 2, []).append(r.text)
    want, failed = {}, 0
    for user, by in sessions.items():
        memory = []
        for n in sorted(by):
            text = "\n".join(by[n])
            reply = Q._facts("Memory:\n" + "\n".join(t for _, t in memory) + "\nSession:\n" + text)
            if reply == "sorry":
                failed += 1
                known, top = {t.strip().lower() for _, t in memory}, max([int(i) for i, _ in memory], default=-1)
                for x in text.split("\n"):
                    if x.strip(" ") and x.strip(" ").lower() not in known:
                        known.add(x.strip(" ").lower())
                        top += 1
                        memory.append((str(top), x.strip(" ")))
                continue
            ops = sequential_decide(memory, [(f["fact"].strip(), f["type"]) for f in json.loads(reply)["facts"] if f["fact"].strip()])
            for i, t, event in ops:
                if event == "UPDATE":
                    memory = [(j, t if j == i else u) for j, u in memory]
                else:
                    memory.append((i, t))
        want[user] = memory
    got = collections.defaultdict(list)
    for r in sorted(entry.queries()["session_driver"](spark, SF).collect(), key=lambda r: (r.user_id, r.pos)):
        got[r.user_id].append((r.id, r.text))
    assert failed and dict(got) == {u: m for u, m in want.items() if m}


def test_second_hop_completes_the_first(spark):
    first = collections.defaultdict(list)
    for r in sorted(entry.queries()["second_hop"](spark, SF).collect(), key=lambda r: r["rank"]):
        first[r.user_id, r.qid].append(r.key)
    assert first and all(len(k) == len(set(k)) <= 4 for k in first.values()) and any(len(k) > 2 for k in first.values())


def test_windowed_stream(spark, tmp_path):
    events = spark.createDataFrame([(datetime.datetime(2024, 1, 1, h), "a", 1.0) for h in (0, 0, 1)], "ts timestamp, event_type string, value double")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = S.windowed_counts(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]


def test_ports_retry_and_give_up(spark):
    calls, naps = [], []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("timeout")
        return ["ok"] * len(texts)

    limits = Limits(sleep=naps.append)
    assert Caller(limits).call(flaky, ["a", "b"]) == ["ok", "ok"] and naps == [0.5, 1.0]

    def broken(texts):
        raise OSError("down")

    c = Caller(Limits(failures=2, sleep=naps.append))
    with pytest.raises(BudgetExceeded):
        c.call(broken, ["x"])
    now = [0.0]
    slow = Caller(Limits(tokens_per_minute=10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s)))
    slow.call(lambda t: t, ["x" * 32])
    slow.call(lambda t: t, ["x" * 32])
    assert now[0] >= 60
    df = complete(spark.createDataFrame([("a",), (None,)], "p string"), "p", FunctionPort(lambda p: p + "!"))
    assert sorted(r.reply for r in df.collect()) == ["!", "a!"]


def test_flow_end_to_end(spark, tmp_path):
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    q = c.where("turn = 0").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("qid"), "text")
    m = c.where("turn > 0").select(F.col("conv_id").alias("user_id"), F.col("turn").alias("key"), "text")
    refs = c.where("turn > 0").groupBy(F.col("conv_id").alias("user_id")).agg(F.collect_list("text").alias("candidates")).withColumn("qid", F.lit(0).cast("long"))
    for backend in ("rag", "lexical"):
        out = Flow(backend=backend, top_k=2).run(spark, q, m, refs, f"{tmp_path}/{backend}")
        overall = {r.metric: r for r in out.where("scope = 'overall'").collect()}
        assert overall["f1_score"]["count"] == q.count() and 0 < overall["f1_score"]["mean"] <= 1
    assert step_range("search", "eval") == ("search", "answer", "eval")
    with pytest.raises(ValueError):
        step_range("score", "add")


def test_memory_table(spark, tmp_path):
    t = tables.MemoryTable(spark, f"{tmp_path}/m", 4)
    at = lambda d: datetime.datetime(2024, 1, d)
    meta = ("s", "k1", "ADD", 1, "", "", "", "", "")
    row = lambda i, u, text, d, e: (i, u, "SHORT", 0, text, meta, e, at(d), at(d))
    make = lambda rows: spark.createDataFrame(rows, tables.MEMORY_SCHEMA)
    t.upsert(make([row("1", "u", "a", 1, [1.0]), row("2", "v", "b", 1, None)]))
    t.upsert(make([row("1", "u", "c", 5, None)]))
    got = {r.id: r for r in t.read().collect()}
    assert got["1"].summary == "c" and got["1"].created_at == at(1) and list(got["1"].embedding) == [1.0] and got["1"].updated_at == at(5)
    t.backfill(lambda c: F.array(F.lit(9.0).cast("float")))
    assert {r.id: list(r.embedding) for r in t.read().collect()} == {"1": [1.0], "2": [9.0]}
    t.clear_user("u")
    assert [r.id for r in t.read().collect()] == ["2"] and tables.MemoryTable(spark, f"{tmp_path}/m").version == 4
    assert [r.id for r in t.items("v").collect()] == ["k1"]


def test_dialogue_files(spark, tmp_path):
    data = [{"conversation": {"speaker_a": "A", "session_1": [{"speaker": "A", "text": "x"}]}}, {"conversation": {"speaker_a": "B", "session_1": [{"speaker": "B", "text": "y"}]}}]
    (tmp_path / "d.json").write_text(json.dumps(data))
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, data)))
    assert dialogue.sessions(dialogue.load_dataset(spark, f"{tmp_path}/d.json")).count() == 2
    assert dialogue.load_dataset(spark, f"{tmp_path}/d.json", 1).count() == 1
    assert dialogue.sessions(dialogue.load_dataset(spark, f"{tmp_path}/d.jsonl", lines=True)).count() == 2
    (tmp_path / "l.json").write_text('[{"a": 1}, 3, {"a": 2}]')
    (tmp_path / "m.json").write_text('{"x": [{"a": 1}], "y": [{"a": 5}]}')
    (tmp_path / "bad.json").write_text("oops")
    read = lambda n: sorted(r.a for r in tables.read_json_list(spark, f"{tmp_path}/{n}", "a int").collect())
    assert read("l.json") == [1, 2] and read("bad.json") == [] == read("none.json")
    assert sorted(r.a for r in tables.read_score_records(spark, f"{tmp_path}/m.json", "a int").collect()) == [1, 5]
    assert tables.rubric_sections('A: [{"id": 1}] B: [] ', ["A:", "B:"]) == {"A:": [{"id": 1}], "B:": []}
    tables.write_flat(spark.createDataFrame([(1, "x", 2)], "a int, b string, c int"), f"{tmp_path}/flat", ["b", "a"])
    assert spark.read.csv(f"{tmp_path}/flat", header=True).columns == ["b", "a"]
