"""Vectors meet in tiles: many small users in one, a large one in several, and pairs are no rows."""

import numpy as np
import pytest

from memloom.operators import vector_index as V


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(5)
    vectors = [(u, i, np.round(rnd.normal(size=4), 1).tolist()) for u in range(40) for i in range(3 + u % 3)] + [(100, i, np.round(rnd.normal(size=4), 1).tolist()) for i in range(300)]
    asked = [(u, 0, rnd.normal(size=4).tolist()) for u in range(45)] + [(100, i, vectors[-i][2]) for i in range(1, 20)]
    kind = "user_id long, {} long, embedding array<double>"
    return vectors, asked, spark.createDataFrame(vectors, kind.format("key")), spark.createDataFrame(asked, kind.format("qid"))


def brute(vectors, asked, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    out = {}
    for user, qid, q in asked:
        near = sorted((-round(float(unit(q) @ unit(v)), 9), key) for u, key, v in vectors if u == user and any(v))
        out |= {(user, qid, r): key for r, (_, key) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("k", [1, 4, 80])
def test_tiles_are_brute_force(rows, monkeypatch, k):
    vectors, asked, memories, questions = rows
    monkeypatch.setattr(V, "ENTRIES", 70)
    monkeypatch.setattr(V, "ASKED", 7)
    got = V.VectorIndex.build(memories).search(questions, k).collect()
    assert {(r.user_id, r.qid, r["rank"]): r.key for r in got} == brute(vectors, asked, k)


def test_rows_of_a_search_do_not_follow_the_pairs(rows):
    _, asked, memories, questions = rows
    index = V.VectorIndex.build(memories)
    assert index.candidates(questions, 4).count() <= 4 * len(asked)
    text = index.candidates(questions, 4)._jdf.queryExecution().toString()
    assert "Join" not in text


def test_far_cells_are_not_compared():
    rnd = np.random.default_rng(6)
    middles = rnd.normal(size=(30, 16))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    v, x = unit(np.repeat(middles, 50, 0) + 0.02 * rnd.normal(size=(1500, 16))), unit(middles + 0.02 * rnd.normal(size=(30, 16)))
    cell = np.repeat(np.arange(30), 50)

    class Seen(np.ndarray):
        pairs = 0

        def __matmul__(self, other):
            Seen.pairs += self.shape[0] * other.shape[1]
            return np.asarray(self) @ np.asarray(other)

    i, j, _ = V._nearest(x.view(Seen), v, cell, np.arccos(np.clip((v * unit(middles)[cell]).sum(1), -1, 1)), np.arange(1500), 5)
    assert Seen.pairs < 30 * 1500 / 8
    cosine = x @ v.T
    assert all(set(j[i == q]) == set(np.argsort(-cosine[q])[:5]) for q in range(30))
