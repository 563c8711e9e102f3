"""Sequence ratios, block against block."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from memloom.functions import udfs
from memloom.operators import memory as M
from memloom.operators import sequence as S


def text(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 7))) + rng.choice(["", "", "", "q", "x7"]) for _ in range(n))


def changed(rng, t, share):
    return "".join(rng.choice("abcd jqz") if rng.random() < share else c for c in t if rng.random() > share / 3)


@pytest.fixture
def texts():
    rng = random.Random(8)
    old = [text(rng, rng.choice([3, 20, 60, 120])) for _ in range(60)] + ["ab" * 150, "a" * 250, "\\" * 9]
    new = [changed(rng, rng.choice(old), rng.choice([0, 0.01, 0.03, 0.1])) for _ in range(40)] + [text(rng, 100) for _ in range(20)] + old[-3:] + [old[2][50:] + old[2][:50], ""]
    return new, old


def test_ratio_is_difflibs(texts):
    new, old = texts
    for a in new:
        for b in old[::7]:
            want = SequenceMatcher(None, a, b).ratio()
            need = int(0.35 * (len(a) + len(b)))
            assert S.ratio_from(a, b) == want
            assert S.ratio_from(a, b, need) in ({want} if want >= 0.7 else {want, 0.0})


@pytest.mark.parametrize("floor", [0.7, 0.95])
@pytest.mark.parametrize("held", [3, 2048])
def test_tile_is_brute_force_and_compares_few_letters(texts, monkeypatch, floor, held):
    new, old = texts
    monkeypatch.setattr(S, "HELD_ROWS", held)
    calls, ratio = [], S.ratio_from
    monkeypatch.setattr(S, "ratio_from", lambda a, b, need: calls.append(1) or ratio(a, b, need))
    pos = np.arange(len(old))[::-1].copy()
    got = S.tile(pa.chunked_array([new]), np.full(len(new), floor), pa.chunked_array([old]), pos, 0.7)
    want = {}
    for i, a in enumerate(new):
        best = max((SequenceMatcher(None, a, b).ratio() if a else 0.0, -int(pos[j])) for j, b in enumerate(old))
        if best[0] >= floor:
            want[i] = best
    assert {i: (s, -int(pos[j])) for i, j, s in zip(*got)} == want and len(want) > 10
    assert len(calls) < 0.05 * len(new) * len(old)


def test_pairs_of_texts_are_no_rows(spark, monkeypatch):
    """A user's texts meet in blocks, also in several; what is joined are facts with their own best memory."""
    rng = random.Random(9)
    old = [("u", i, text(rng, 60)) for i in range(60)]
    facts = [("u", i, changed(rng, old[i][2], 0.02) if i % 3 else text(rng, 60)) for i in range(60)]
    f, o = spark.createDataFrame(facts, "user_id string, arrival long, fact string"), spark.createDataFrame(old, "user_id string, pos long, text string")
    one = sorted(M.related_by_sequence(f, o).collect())
    near = {i for i in range(60) if i % 3 and udfs.similarity(facts[i][2], old[i][2]) >= 0.7}
    assert {r.arrival: r.pos for r in one} == {i: i for i in near} and len(near) > 10
    monkeypatch.setattr(S, "BLOCK_ROWS", 20)
    many = M.related_by_sequence(f, o)
    assert sorted(many.collect()) == one
    plan = many._jdf.queryExecution().explainString(many.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "FlatMapCoGroupsInArrow" in plan and "Cartesian" not in plan and "step" not in plan


def test_frequent_runs_are_not_followed(monkeypatch):
    """Runs that most texts share tell least and cost most: pairs are bounded without their postings."""
    rng = random.Random(10)
    common = [text(rng, 2) for _ in range(6)]
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.3 else text(rng, 1) for _ in range(120))
    old = [prose() for _ in range(150)]
    new = [t + " " + text(rng, 5) for t in old[:30]] + [prose() for _ in range(120)]
    followed, spread = [], S._spread
    monkeypatch.setattr(S, "_spread", lambda at, rows: followed.append(int((at[rows + 1] - at[rows]).sum())) or spread(at, rows))
    got = S.tile(pa.chunked_array([new]), np.full(len(new), 0.7), pa.chunked_array([old]), np.arange(len(old)), 0.7)
    ratios = [SequenceMatcher(None, a, b).ratio() for a, b in zip(new, old)]
    assert sorted(zip(*got)) == [(i, i, r) for i, r in enumerate(ratios) if r >= 0.7] and len(got[0]) > 10
    texts = sum(map(len, new + old))
    assert sum(followed) < 3 * texts


def test_texts_without_pairs_have_no_rows():
    """Empty texts on either side, and texts of one letter."""
    none = pa.chunked_array([["", "a"]])
    assert S.tile(none, np.full(2, 0.7), pa.chunked_array([["", ""]]), np.arange(2), 0.7) == ([], [], [])
    got = S.tile(none, np.full(2, 0.7), pa.chunked_array([["b", "a"]]), np.arange(2), 0.7)
    assert [list(map(int, got[0])), list(map(int, got[1])), got[2]] == [[1], [1], [1.0]]
