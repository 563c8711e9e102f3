"""Queries over whole tables and texts, against plain Python on small tables."""

import random
import re

import pytest

import __spark_entry__ as entry
from memloom.functions import udfs
from memloom.operators import memory as M

SF = "/root/testdata/sf0.001"


@pytest.fixture
def run(spark, tmp_path):
    def go(name, **tables):
        for t, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
        return entry.queries()[name](spark, str(tmp_path) if tables else SF).collect()

    return go


DOCS = "doc_id long, source string, lang string, text string"
START = "one two three four five six seven eight nine ten eleven twelve thirteen "
TEXTS = [(1, "s", "en", START + "a b c d e f g h i j k l m n o p"), (20, "s", "en", START + "q r s t u v w x y z aa bb cc dd ee ff"), (21, "s", "en", START + "a b c d e f g h i j k l m n o p")]


@pytest.mark.parametrize("name, event", [("decide_ops", "ADD"), ("decide_ops_sequence", "UPDATE")])
def test_facts_are_whole_texts(run, name, event):
    """A fact that differs from a memory only after 60 characters says something new (the words are few in common, the letters many), one that is equal throughout doesn't."""
    got = run(name, documents=(TEXTS, DOCS))
    assert [(r.text, r.event) for r in got] == [(TEXTS[1][3], event)]


def test_delta_writes_whole_texts(run):
    got = run("apply_delta", documents=(TEXTS, DOCS))
    assert sorted((r.text, r.written) for r in got) == sorted([(TEXTS[0][3], False), (TEXTS[1][3], True)])


def test_candidates_see_whole_texts(run):
    words = {i: set(re.findall("[a-z]+", t)) for i, _, _, t in TEXTS}
    got = {r.arrival: r.similarity for r in run("top_candidates", documents=(TEXTS, DOCS))}
    assert got == {i: round(len(words[i] & words[1]) / len(words[i] | words[1]), 6) for i in (20, 21)}


def test_turns_are_returned_whole(run, spark):
    rows = [(1, t, f"turn {t} with a long enough text", "user") for t in range(4)]
    got = run("history_window", conversations=(rows, "conv_id long, turn long, text string, role string"))
    assert {r.session: r.history for r in got} == {t: "|".join(x[2] for x in rows[max(0, t - 2) : t]) for t in range(4)}
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    for r in entry.queries()["retrieval_payload"](spark, SF).limit(20).collect():
        assert any(r.selected.startswith(f"{t}:{texts[c, t]}") for c, t in texts if c == r.conv_id)


def test_snapshot_merges_every_old_row(run):
    """Documents beyond id 397 take part; the first of an id wins on either side."""
    ids = [1, 3, 396, 398, 800, 1190, 1192, 1194, 2001]
    new, old = {}, {}
    for i in ids:
        (new if i % 2 else old).setdefault(i % 400 if i % 2 else i % 397, i)
    want = [(k, "en") for k in sorted(new, key=new.get)] + [(k, "old") for k in sorted(old, key=old.get) if k not in new]
    got = run("snapshot_merge", documents=([(i, "s", "en", "x") for i in ids], DOCS))
    assert [(r.id, r.text) for r in sorted(got, key=lambda r: r.pos)] == want and [r.pos for r in sorted(got, key=lambda r: r.pos)] == list(range(len(want)))


def test_every_conversation_has_a_best_score(run, spark):
    pairs = {r.conv_id for r in entry.queries()["token_f1"](spark, SF).collect()}
    assert {r.conv_id for r in run("best_of_candidates")} == pairs and any(c % 2 for c in pairs)


def test_every_label_is_rescored(run, monkeypatch):
    from memloom.operators import judged

    seen, patch = [], judged.patch_report
    monkeypatch.setattr(judged, "patch_report", lambda report, scores: seen.append({r.conversation for r in scores.collect()}) or patch(report, scores))
    documents = [(i, "s", "en", "x") for i in range(12)]
    got = run("reapply_empty_rule", documents=(documents, DOCS), labels=([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int"))
    assert seen == [set(range(10))] and {r.doc_id: r.llm_score for r in got} == {i: 0.0 if i in (0, 5) else 0.5 for i in range(12)}


def test_every_order_date_is_an_anchor(run, spark):
    days = {str(r[0])[:10] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderdate").distinct().collect()}
    got = run("resolve_relative")
    assert len(days) > 60 and {str(r.anchor) for r in got} == days
    assert len(got) == len(days) * len({r.id for r in got})


def test_sequence_join_is_brute_force(spark):
    """The join by lengths, letters and common subsequences finds for every fact what comparing it with each memory finds."""
    rng = random.Random(5)
    words = ["at", "tea", "nest", "seat", "don't", "zebra", "x1", "Été", "a\\b"]
    olds = [(u, p, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 9, 60])))) for u in "ab" for p in range(25)]
    facts = [(u, i, mutate(rng, rng.choice(olds)[2])) for u in "ab" for i in range(30)] + [("a", 99, None), ("c", 0, "tea"), ("a", 98, olds[3][2])]
    got = M.related_by_sequence(spark.createDataFrame(facts, "user_id string, arrival long, fact string"), spark.createDataFrame(olds + olds[:3], "user_id string, pos long, text string"))
    want = {}
    for u, i, fact in facts:
        best = max(((udfs.similarity(fact, t), -p) for v, p, t in olds if v == u), default=(0, 0))
        if best[0] >= M.RELATED:
            want[u, i] = (round(best[0], 9), -best[1])
    assert len(want) > 20
    assert {(r.user_id, r.arrival): (round(r.score, 9), r.pos) for r in got.collect()} == want


def mutate(rng, text):
    letters = [c if rng.random() > 0.15 else rng.choice("abet ") for c in text]
    return "".join(letters) if rng.random() < 0.8 else " ".join(rng.sample(text.split(), len(text.split())))


def test_common_letters():
    rng = random.Random(6)
    for longest in [700] * 5 + [40] * 195:
        a, b = ("".join(rng.choices("abc ", k=rng.randint(1, longest))) for _ in "xy")
        row = [0] * (len(b) + 1)
        for x in a:
            above = row
            row = [0]
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
        assert udfs.common_letters(a, b, 0) == row[-1]
        assert udfs.common_letters(a, b, row[-1]) == row[-1]
        assert udfs.common_letters(a, b, row[-1] + 1) <= row[-1]
