"""What the findings of the fourth round asked for."""

import random

import numpy as np
import pyarrow as pa
import pytest

from memloom.operators import alike


def sets(rng, n):
    """Sets of words of four vocabularies that have little in common, as numbers; some words are frequent."""
    out = []
    for i in range(n):
        base = 10_000 * (1 + i % 4)
        out.append([*{base + int(400 * rng.random() ** 2) for _ in range(rng.choice([20, 50, 80]))}, *rng.sample(range(30), 2)])
    return out


def brute(new, old, rank, k, least):
    want = set()
    for i, a in enumerate(map(set, new)):
        every = sorted((-len(a & set(b)) / len(a | set(b)) if a and b else 0.0, r, j) for j, (b, r) in enumerate(zip(old, rank)))[:k]
        want |= {(i, j, -s) for s, _, j in every if -s >= least}
    return want


@pytest.mark.parametrize("k,least", [(3, 0.0), (1, 0.3)])
def test_texts_of_other_kinds_are_not_compared(monkeypatch, k, least):
    """F2: pairs of texts whose words can't reach the third best score are left out, and the nearest are those of brute force."""
    rng = random.Random(2)
    new, old = [*sets(rng, 400), [], [7]], [*sets(rng, 500), []]
    rank = rng.sample(range(len(old)), len(old))
    monkeypatch.setattr(alike, "COLUMNS", 16)
    pairs, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: pairs.append(minlength) or bincount(x, weights, minlength))
    column = lambda lists: pa.chunked_array([pa.array(lists, pa.list_(pa.int64()))])
    got = alike.tile(column(new), column(old), pa.chunked_array([rank]), k, least)
    assert {(int(i), int(j), float(s)) for i, j, s in zip(*got)} == brute(new, old, rank, k, least)
    assert sum(pairs) < 0.6 * len(new) * len(old)


def test_nothing_on_one_side_of_the_words():
    """Texts that share no word, and texts without words: the first by order, with score 0."""
    column = lambda lists: pa.chunked_array([pa.array(lists, pa.list_(pa.int64()))])
    got = alike.tile(column([[1], []]), column([[2], [], [3]]), pa.chunked_array([[5, 4, 3]]), 2, 0.0)
    assert sorted(zip(map(int, got[0]), map(int, got[1]), map(float, got[2]))) == [(0, 1, 0.0), (0, 2, 0.0), (1, 1, 0.0), (1, 2, 0.0)]
