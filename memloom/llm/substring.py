"""Op 7. Substring dedup with a log-structured fingerprint index of sorted immutable runs.

A repeated passage is judged by windows of 20 words. The index holds fingerprints of 10 words, of every window the
least of its eleven (winnowing), so two equal windows always share a fingerprint while one word in six is stored.
A run has a row per fingerprint and document, sorted by fingerprint, and is never changed; a new batch is
merge-joined with the runs, hits are verified window by window on the documents themselves, and before a batch
meets too many runs, these are merged into one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import discard, materialize, parallelism, prepare

WINDOW = 20
GRAM = 10
#: Runs that a new batch finds at most; more are compacted first.
FANOUT = 1
#: Batches that a whole table is fed in.
BATCHES = 3
#: A key is heavy above this part of all rows, so there are fewer heavy keys than this: these are broadcast.
HEAVY = 512

_U = np.uint64


def _anchors(words: W.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, their documents, the fingerprint of each window and its place."""
    reach = WINDOW - GRAM + 1
    grams = W.shingles(h, GRAM)
    if len(grams) < reach:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, _U), none
    low = np.lib.stride_tricks.sliding_window_view(grams, reach).argmin(1)
    doc = np.searchsorted(words.first, np.arange(len(low)), "right") - 1
    start = np.flatnonzero(np.arange(len(low)) + WINDOW <= words.first[doc + 1])
    at = start + low[start]
    return start, doc[start], grams[at], at


def fingerprints(docs: DataFrame) -> DataFrame:
    """(fp, doc_id, twice): the fingerprints of each document; twice if a document has one at several places."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            texts, ids = W.utf8(frame["text"]), frame["doc_id"].to_numpy(np.int64)
            for lo, hi in W.batches(texts):
                words = W.split(texts[lo:hi])
                _, doc, fp, at = _anchors(words, words.hashes())
                if not len(fp):
                    continue
                new = np.flatnonzero(np.diff(at, prepend=-1))  # windows with the same place are neighbours
                doc, fp = doc[new], fp[new]
                order = np.lexsort((fp, doc))
                doc, fp = doc[order], fp[order]
                lead = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])]))
                yield pd.DataFrame({"fp": fp[lead].view(np.int64), "doc_id": ids[lo:hi][doc[lead]], "twice": np.diff(np.append(lead, len(fp))) > 1})

    return docs.mapInPandas(run, "fp long, doc_id long, twice boolean")


def windows_of(hits: DataFrame) -> DataFrame:
    """(doc_id, new, all_pos, pos, w1, w2) of ``hits(doc_id, new, text, fps)``: windows whose fingerprint is in the array fps.

    all_pos has the starts of all these windows; the other arrays have a window that a document repeats once, at its first start.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, ids, new = W.utf8(batch.column("text").to_pylist()), batch.column("doc_id").to_numpy(), batch.column("new").to_numpy(zero_copy_only=False)
            fps, cuts = batch.column("fps").values.to_numpy(), batch.column("fps").offsets.to_numpy()
            for lo, hi in W.batches(texts):
                words = W.split(texts[lo:hi])
                h = words.hashes()
                start, doc, fp, _ = _anchors(words, h)
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                ok = np.zeros(len(start), bool)
                for i in range(hi - lo):
                    a, b = bounds[i], bounds[i + 1]
                    ok[a:b] = np.isin(fp[a:b].view(np.int64), fps[cuts[lo + i] : cuts[lo + i + 1]])
                start, doc = start[ok], doc[ok]
                w1, w2 = (W.shingles(h, WINDOW)[start], W.shingles(words.hashes(1), WINDOW, 1)[start]) if len(start) else (np.empty(0, _U), np.empty(0, _U))
                pos = (start - words.first[doc]).astype(np.int32)
                key = w1 ^ W.mix(doc.astype(_U))
                order = np.argsort(key, kind="stable")
                same = (key[order[1:]] == key[order[:-1]]) & (w2[order[1:]] == w2[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
                first = np.ones(len(start), bool)
                first[order[1:][same]] = False
                docs = np.arange(hi - lo + 1)
                whole, once = np.searchsorted(doc, docs).astype(np.int32), np.searchsorted(doc[first], docs).astype(np.int32)
                lists = [pa.ListArray.from_arrays(whole, pos)] + [pa.ListArray.from_arrays(once, x[first]) for x in (pos, w1.view(np.int64), w2.view(np.int64))]
                yield pa.record_batch([pa.array(ids[lo:hi]), pa.array(new[lo:hi]), *lists], names=["doc_id", "new", "all_pos", "pos", "w1", "w2"])

    return hits.select("doc_id", "new", "text", "fps").mapInArrow(run, "doc_id long, new boolean, all_pos array<int>, pos array<int>, w1 array<long>, w2 array<long>")


def _matching(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """Rows whose fp is in ``keys(fp, n)``, n being the rows that have it, of ``total`` rows.

    Keys that more than a part in ``HEAVY`` of all rows have are fewer than ``HEAVY``; they are broadcast, so that no task gets all
    rows of a hot key.
    """
    heavy = F.broadcast(keys.where(F.col("n") > total / HEAVY).select("fp"))
    light = keys.where(F.col("n") <= total / HEAVY).select("fp")
    return rows.join(heavy, "fp", "left_semi").union(rows.join(heavy, "fp", "left_anti").join(light.hint("merge"), "fp", "left_semi"))


class RunIndex:
    """Sorted runs of fingerprints over the documents of all batches so far, and those documents."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        prepare(spark)
        self.spark, self.fanout, self.runs, self.history = spark, fanout, [], None

    def _write(self, rows: DataFrame, name: str) -> DataFrame:
        # a fingerprint of very many documents is dealt out by document
        return materialize(rows.repartitionByRange(parallelism(self.spark), "fp", "doc_id").sortWithinPartitions("fp", "doc_id"), name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Feed a batch ``docs(doc_id, text)``; returns (doc_id, starts): window starts that are seen earlier.

        Earlier means in a former batch, or in this one with a smaller doc_id or, in the same document, start.
        Former batches are never judged again. doc_id must not be null and tells documents apart.
        """
        if len(self.runs) > self.fanout:
            self.compact()
        run = self._write(fingerprints(docs), "run")
        stats = run.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
        old = self._old()
        if old is not None:
            seen = old.groupBy("fp").agg(F.count(F.lit(1)).alias("n_old"))
            stats = stats.join(seen.hint("merge"), "fp", "left")
        else:
            stats = stats.withColumn("n_old", F.lit(None).cast("long"))
        stats = materialize(stats.where("n > 1 OR twice OR n_old > 0").select("fp", "n", "n_old"), "repeated")
        hits = _matching(run.select("fp", "doc_id"), stats, run.count()).groupBy("doc_id").agg(F.collect_list("fp").alias("fps"))
        found = windows_of(docs.join(hits, "doc_id").withColumn("new", F.lit(True)))
        if old is not None:
            past = _matching(old.select("fp", "doc_id"), stats.where("n_old > 0").select("fp", F.col("n_old").alias("n")), old.count())
            past = past.groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
            found = found.union(windows_of(self.history.join(past, "doc_id").withColumn("new", F.lit(False))).withColumn("all_pos", F.array().cast("array<int>")))
        found = materialize(found, "windows")
        # windows that no former batch has stay where they come first
        rows = found.select(F.when(F.col("new"), F.col("doc_id")).alias("doc"), F.explode(F.arrays_zip("pos", "w1", "w2")).alias("w")).select("doc", "w.*")
        if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
            first = rows.groupBy("w1", "w2").agg(F.count("doc").alias("new"), F.count(F.lit(1)).alias("all"), F.min("doc").alias("doc_id"), F.min_by("pos", "doc").alias("pos"))
        else:  # of rows that share a doc_id the one that has the window earliest
            first = rows.groupBy("w1", "w2").agg(F.count("doc").alias("new"), F.count(F.lit(1)).alias("all"), F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "pos"))).alias("f"))
            first = first.select("new", "all", F.col("f.doc").alias("doc_id"), "f.pos")
        stay = first.where(F.col("new") == F.col("all")).groupBy("doc_id").agg(F.collect_list("pos").alias("stay"))
        again = F.array_except("all_pos", F.coalesce("stay", F.array().cast("array<int>")))
        out = materialize(found.where("new").select("doc_id", "all_pos").join(stay, "doc_id", "left").select("doc_id", again.alias("starts")).where("size(starts) > 0"), "starts")
        for used in (stats, found):
            discard(used)
        self.runs.append(run)
        self.history = docs if self.history is None else self.history.union(docs)
        return out

    def _old(self) -> DataFrame | None:
        out = None
        for r in self.runs:
            out = r if out is None else out.union(r)
        return out

    def compact(self) -> None:
        """Merge all runs into one."""
        merged = self._write(self._old(), "run")
        for r in self.runs:
            discard(r)
        self.runs = [merged]


def cut(docs: DataFrame, starts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): documents without the words that the windows at ``starts`` cover."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for text, at in zip(W.utf8(frame["text"]), frame["starts"]):
                words = text.split()  # bytes: exactly the ASCII white space
                n, gone = len(words), 0
                if at is not None and len(at) and n:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.asarray(at)[np.asarray(at) < n]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + window, n), -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words, gone = list(compress(words, keep)), int(n - keep.sum())
                rows.append((n, gone, b" ".join(words).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"]).assign(doc_id=frame["doc_id"].astype("Int64").to_numpy(object))[["doc_id", "n_words", "n_removed", "kept"]]

    starts = starts.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))  # of rows that share an id
    return docs.join(starts, "doc_id", "left").select("doc_id", "text", "starts").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept string")


def repeated_windows(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (text), feeding ``docs`` in batches of ascending doc_id.

    Words are unchanged runs of anything but ASCII white space. Null and short texts have no windows. Rows with a
    null doc_id are kept whole and not indexed; rows that share a doc_id count as one document, whose windows stay where a
    row has them earliest. Other columns are ignored. A window, fingerprint or document of any number of rows or words
    is spread over all tasks, but for the list of one document's fingerprints.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    index, starts, low = RunIndex(docs.sparkSession), None, None
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000)).first()[0] if batches > 1 else None
    for high in [*dict.fromkeys(cuts or []), None]:
        inside = F.col("doc_id").isNotNull()
        inside &= F.lit(True) if low is None else F.col("doc_id") > low
        inside &= F.lit(True) if high is None else F.col("doc_id") <= high
        found, low = index.add(docs.where(inside)), high
        starts = found if starts is None else starts.union(found)
    return cut(docs, starts)


def substring_dedup(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Digest of the deduplicated texts: the kept text gives way to its sha256."""
    return repeated_windows(docs, batches).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
