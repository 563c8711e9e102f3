"""Op 8. Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import prepare

BITS = 18
#: Most labelled documents that are learned from: those with the smallest hash of their id. Scoring has no bound.
MAX_TRAIN = 12_000
EPOCHS = 3
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.0005, 0.001

_U = np.uint64


def _forms(words: W.Words) -> W.Words:
    """The same words by form: letters give a or A, digits 0, a run of equal signs one sign."""
    b = words.buf
    form = b.copy()
    form[(b >= 97) & (b <= 122) | (b >= 128)] = 97
    form[(b >= 65) & (b <= 90)] = 65
    form[(b >= 48) & (b <= 57)] = 48
    keep = np.ones(len(b), bool)
    keep[1:] = form[1:] != form[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    return W.Words(form[keep], place[words.start], place[words.end], words.first)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its hashed feature numbers and values, of length one.

    Features are n-grams of words (1 and 2, lower case) and of word forms (1 to 3, with a mark for a word that repeats
    the one before); a feature's value is the logarithm of one plus its count. The last feature is the bias.
    """
    words = W.split(texts)
    low = W.Words(np.where((words.buf >= 65) & (words.buf <= 90), words.buf + np.uint8(32), words.buf), words.start, words.end, words.first)
    plain, form = low.hashes(), _forms(words).hashes()
    again = np.zeros(len(plain), _U)
    again[1:] = plain[1:] == plain[:-1]
    again[words.first[:-1][words.first[:-1] < len(again)]] = 0  # not across documents
    form = W.mix(form + again)
    families = [(plain, 1), (plain, 2), (form, 1), (form, 2), (form, 3)]
    grams = [(W.mix(W.shingles(h, k) + _U(977 * i + k)) >> _U(64 - BITS), k) for i, (h, k) in enumerate(families)]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        own = [g[a : max(a, b - k + 1)] for g, k in grams]
        at, n = np.unique(np.concatenate(own), return_counts=True)
        value = np.log1p(n)
        norm = np.sqrt((value * value).sum()) or 1.0
        yield np.append(at.astype(np.int64), 1 << BITS), np.append(value / norm, 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights by FTRL-proximal, one update a row, in the rows' order."""
    z, n, w = (np.zeros((1 << BITS) + 1) for _ in range(3))
    for _ in range(epochs):
        for at, value, label in rows:
            p = 1 / (1 + np.exp(-np.clip(w[at] @ value, -35, 35)))
            g = (p - label) * value
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w[at]
            n[at] = new
            lead = z[at]
            w[at] = np.where(np.abs(lead) > L1, -(lead - np.sign(lead) * L1) / ((BETA + np.sqrt(new)) / ALPHA + L2), 0.0)
    return w


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> np.ndarray:
    """Weights learned from at most ``bound`` labelled documents outside the held-out fold.

    The sample is chosen from the labels alone and is so small by its bound that it is sent to all tasks; one task
    learns from its texts in order of the ids' hashes, so reruns agree. Without labels all weights are zero (score 0.5).
    """
    prepare(docs.sparkSession)
    seed = F.xxhash64(F.col("doc_id"), F.lit(11))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.orderBy(seed, "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").repartition(1).sortWithinPartitions(seed, "doc_id", "text")

    def learn(frames: Iterator) -> Iterator:
        import pandas as pd

        seen = []
        for frame in frames:
            raw = W.utf8(frame["text"])
            for lo, hi in W.batches(raw):
                seen += [(at.astype(np.int32), v.astype(np.float32), int(y)) for (at, v), y in zip(features(raw[lo:hi]), frame["quality"].iloc[lo:hi])]
        yield pd.DataFrame({"weights": [train(seen).astype("<f4").tobytes()]})

    weights = rows.mapInPandas(learn, "weights binary").collect()
    return np.frombuffer(bytes(weights[0][0]), "<f4") if weights else np.zeros((1 << BITS) + 1, "<f4")


def score(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; the weights have a fixed size."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights.tobytes())

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        w = np.frombuffer(sent.value, "<f4").astype(np.float64)
        for frame in frames:
            raw, scores = W.utf8(frame["text"]), []
            for lo, hi in W.batches(raw):
                scores += [float(w[at] @ v) for at, v in features(raw[lo:hi])]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(scores, -35, 35)))})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every whole text; null and empty texts score by the bias alone. Rows come back one for one."""
    return score(docs, fit(docs, labels))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns and in place, that the classifier accepts; nothing is shuffled."""
    weights = fit(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast(weights.tobytes())
    level = float(np.log(threshold / (1 - threshold)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        w = np.frombuffer(sent.value, "<f4").astype(np.float64)
        for batch in batches:
            raw, good = W.utf8(batch.column(at).to_pylist()), []
            for lo, hi in W.batches(raw):
                good += [float(w[i] @ v) >= level for i, v in features(raw[lo:hi])]
            yield batch.filter(pa.array(good, pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(run, docs.schema)
