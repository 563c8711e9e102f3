"""Rules of the merge and of the statistics against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import evaluation as E
from memloom.operators import memory as M
from memloom.streaming.session_fold import fold_session

OLD = "user_id string, pos long, id string, text string, anchor_time string"
FACTS = "user_id string, arrival long, text string, type string, anchor_time string"


def test_new_words_are_tokens():
    old = "Melanie has a red cat and likes green tea in May and June"
    memory = [{"id": "0", "text": old}]
    ops = fold_session(memory, [{"text": "Melanie has a red, cat, and likes green tea", "type": ""}])
    assert [o["event"] for o in ops] == ["ADD"] and memory[0]["text"] == old


def test_stream_rules_agree_with_the_merge(spark):
    """Random sessions without times: what the fold does to texts is what ``decide`` decides."""
    rnd = random.Random(6)
    vocab = "Melanie Caroline has a red cat, likes green tea; runs often 'daily' with friends in town".split()
    say = lambda: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(4, 12)))
    old, facts, want = [], [], {}
    for u in range(25):
        memory = [{"id": str(i), "text": say()} for i in range(4)]
        session = []
        for _ in range(4):
            words = rnd.choice(memory)["text"].split()
            for _ in range(rnd.randint(0, 3)):
                words.insert(rnd.randint(0, len(words)), rnd.choice(["new", "late,", "also", "Paris"]))
            session.append({"text": " ".join(words), "type": rnd.choice(["", "plan"])})
        old += [(f"u{u}", i, m["id"], m["text"], "") for i, m in enumerate(memory)]
        facts += [(f"u{u}", i, f["text"], f["type"], "") for i, f in enumerate(session)]
        want[f"u{u}"] = [(o["event"], o["id"], o["text"]) for o in fold_session([dict(m) for m in memory], session)]
    got = M.decide(spark.createDataFrame(old, OLD), spark.createDataFrame(facts, FACTS), M.sequence_similarity, with_time=False)
    found = {u: [] for u in want}
    for r in got.orderBy("user_id", "seq").collect():
        found[r.user_id].append((r.event, r.id, r.text))
    assert {u: sorted(v) for u, v in found.items()} == {u: sorted(v) for u, v in want.items()}


def test_a_null_user_is_a_user(spark):
    old = [("u", 0, "0", "Ann likes tea", ""), (None, 0, "0", "Ann likes tea", "")]
    facts = [(u, i, t, "", "") for u in ("u", None) for i, t in enumerate(["Ann likes tea", "Bob runs far", "Bob runs far", "Cid paints blue doors"])]
    got = M.decide(spark.createDataFrame(old, OLD), spark.createDataFrame(facts, FACTS)).collect()
    by = lambda u: sorted((r.seq, r.event, r.id, r.text) for r in got if r.user_id == u)
    assert by("u") == by(None) == [(1, "ADD", "1", "Bob runs far"), (2, "ADD", "2", "Cid paints blue doors")]


@pytest.mark.parametrize("text,value", [("The concert featured Matt Patterson'.", "Matt Patterson"), ("They saw the concert by 'The Ants'.", "The Ants"), ("The concert was performed by Bo's.", "Bo's")])
def test_concert_values_lose_their_quotes(spark, text, value):
    rows = spark.createDataFrame([("u", 0, "0", text, "")], OLD)
    got = {r.slot: r.value for r in M.slot_values(rows).collect()}
    assert got["melanie_music_seen"] == value


@pytest.mark.parametrize("kind", ["double", "long", "int"])
def test_order_statistics(spark, kind):
    rnd = random.Random(1)
    rows = [rnd.choice([rnd.gauss(0, 1) * 10 ** rnd.randint(-3, 9), 7.0, 7.5, -3.0]) for _ in range(3000)]
    rows = [int(x) % 10**8 if kind != "double" else x for x in rows]
    df = spark.createDataFrame([(x,) for x in rows] + [(None,)] * 20, f"v {kind}")
    ordered, shares = sorted(rows), {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    got = E.nearest_rank(df, "v", shares).first()
    assert [got[k] for k in shares] == [ordered[round(2999 * p)] for p in shares.values()]
    assert (got["min"], got["max"]) == (ordered[0], ordered[-1]) and dict(E.nearest_rank(df, "v", shares).dtypes)["c"] in (kind, "bigint")
    assert tuple(E.nearest_rank(df.where("v IS NULL"), "v", {"p50": 0.5}).first()) == (None,) * 4
    assert tuple(E.nearest_rank(df.where(F.col("v") == 7).limit(3), "v", {"p50": 0.5}).first())[:3] == (7, 7, 7)
