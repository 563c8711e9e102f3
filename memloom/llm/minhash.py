"""Op 6. MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import discard, materialize, parallelism, prepare
from .components import components

#: Words of a shingle, and the least Jaccard similarity of a link as a fraction.
SHINGLE = 5
LEAST = (80, 100)
#: 26 bands of 5 bins: a pair at 0.80 is in no common bucket with probability 3e-5, at 0.85 with 2e-7.
BANDS, ROWS = 26, 5
#: Rows of a bucket that are compared at a time where stars leave it in more than one component.
TILE = 1024

_U = np.uint64
_BINS = BANDS * ROWS


def _probes() -> np.ndarray:
    """For every bin the order in which an empty one asks the others, a fixed random permutation each."""
    ask = W.mix(np.arange(_BINS * _BINS, dtype=_U) + _U(1)).reshape(_BINS, _BINS)
    return np.argsort(ask, axis=1)


_PROBES = _probes()


def signature(hashes: np.ndarray) -> np.ndarray:
    """Densified one-permutation signature of a non-empty sorted set of 64-bit hashes."""
    bins = ((hashes >> _U(32)) * _U(_BINS) >> _U(32)).astype(np.int64)
    lead = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted, so the first of a bin is its least
    out, full = np.zeros(_BINS, _U), np.zeros(_BINS, bool)
    out[bins[lead]], full[bins[lead]] = hashes[lead], True
    empty = np.flatnonzero(~full)
    if len(empty):
        asked = _PROBES[empty]
        donor = asked[np.arange(len(empty)), full[asked].argmax(1)]
        out[empty] = out[donor]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One bucket key a band; a band's number is part of its keys."""
    key = np.arange(1, BANDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        key = W.mix(key ^ sig[r::ROWS])
    return key


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (128 bits of the set), bands; one row per document."""

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            texts, ids = W.utf8(frame["text"]), frame["doc_id"].astype("Int64")
            for lo, hi in W.batches(texts):
                words = W.split(texts[lo:hi], lower=True)
                rows = []
                for h in W.document_shingles(words, words.hashes(), SHINGLE):
                    h = np.unique(h)
                    if len(h):
                        s1, s2 = W.mix(h).sum(dtype=_U), W.mix(h ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)
                        rows.append((len(h), s1.view(np.int64), s2.view(np.int64), band_keys(signature(h)).view(np.int64)))
                    else:
                        rows.append((0, 0, 0, np.empty(0, np.int64)))
                yield pd.DataFrame(rows, columns=["n_shingles", "s1", "s2", "bands"]).assign(doc_id=ids.iloc[lo:hi].to_numpy(object))[["doc_id", "n_shingles", "s1", "s2", "bands"]]

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def texts_of(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``need(doc_id)``, written once for all comparisons."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(plain.hint("merge").join(need, "doc_id"), "texts")


def confirm(pairs: DataFrame, texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Of ``pairs(a, b)`` those whose full shingle sets reach the similarity."""
    both = pairs.join(texts.toDF("a", "text_a").hint("merge"), "a").join(texts.toDF("b", "text_b").hint("merge"), "b")

    def run(frames: Iterator) -> Iterator:
        held: dict[int, np.ndarray] = {}  # the sets of the last frames' hubs
        for frame in frames:
            if frame.empty:
                continue
            todo: dict[int, str] = {}
            for side in "ab":
                todo.update((i, t) for i, t in zip(frame[side], frame[f"text_{side}"]) if i not in held)
            ids, texts = list(todo), W.utf8(todo.values())
            for lo, hi in W.batches(texts):
                words = W.split(texts[lo:hi], lower=True)
                for i, h in zip(ids[lo:hi], W.document_shingles(words, words.hashes(), SHINGLE)):
                    held[i] = np.unique(h)
            good = []
            for a, b in zip(frame["a"], frame["b"]):
                x, y = held[a], held[b]
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(least[1] * common >= least[0] * (len(x) + len(y) - common))
            yield frame.loc[good, ["a", "b"]]
            last = frame["b"].iloc[-1]
            held = {last: held[last]}

    return both.mapInPandas(run, "a long, b long")


def _common(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets p[k] and q[k]."""
    every, place = np.unique(np.concatenate(sets), return_inverse=True)
    if len(sets) * len(every) <= 1 << 24:  # as rows of a matrix
        has = np.zeros((len(sets), len(every)), np.float32)
        has[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), place] = 1
        return (has @ has.T)[p, q].astype(np.int64)
    return np.array([np.isin(sets[i], sets[j], assume_unique=True).sum() for i, j in zip(p, q)], np.int64)


def likely(g) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs in one tile that are worth comparing, some at a time.

    Such a pair is of different components, its sizes fit, and the tile's bucket is the first one that it shares.
    """
    n, comp, tile = g["n"].to_numpy(), g["comp"].to_numpy(), g["tile"].to_numpy()
    bands = np.stack(g["bands"].to_list())
    at = int(np.flatnonzero(bands[0] == g["key"].iloc[0])[0])
    i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
    left, right, least = np.flatnonzero(tile == i), np.flatnonzero(tile == j), g.attrs["least"]
    for lo in range(0, len(left), 128):
        x = left[lo : lo + 128]
        ok = (comp[x, None] != comp[right]) & (least[1] * np.minimum(n[x, None], n[right]) >= least[0] * np.maximum(n[x, None], n[right]))
        if i == j:
            ok &= x[:, None] < right
        p, q = np.nonzero(ok)
        for k in range(0, len(p), 1 << 16):
            a, b = x[p[k : k + (1 << 16)]], right[q[k : k + (1 << 16)]]
            equal = bands[a] == bands[b]
            first = equal[:, at] & (equal.argmax(1) == at)
            if first.any():
                yield a[first], b[first]


def deal(members: DataFrame) -> DataFrame:
    """``members(key, rep, n, comp, bands)`` with the tiles (i, j) that each goes to, and its own block, ``tile``.

    A bucket's largest component needs no comparison inside. Its members and the others, the strays, are each dealt to blocks
    of about TILE rows; a tile is two blocks of strays, or one of strays and one of the largest component. So a bucket of
    a million rows with one stray is a thousand tiles with that stray in each.
    """
    parts = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = parts.groupBy("key").agg(F.sum("c").alias("every"), F.max(F.struct("c", "comp")).alias("top"))
    blocks = lambda c: F.ceil(c / TILE).cast("int")
    sizes = sizes.select("key", F.col("top.comp").alias("top"), blocks(F.col("every") - F.col("top.c")).alias("strays"), blocks(F.col("top.c")).alias("rest"))
    m, stray, h = members.join(sizes, "key"), F.col("comp") != F.col("top"), F.xxhash64("rep")
    own = F.when(stray, F.pmod(h, F.col("strays"))).otherwise(F.col("strays") + F.pmod(h, F.col("rest"))).cast("int")
    meets = F.sequence(F.lit(0), F.col("strays") - 1 + F.when(stray, F.col("rest")).otherwise(F.lit(0)))
    m = m.where("strays > 0").withColumn("tile", own).withColumn("other", F.explode(meets))
    return m.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "n", "comp", "bands")


def _tiles(members: DataFrame, texts: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Confirmed links between one bucket's rows from different components, as few as join the same rows.

    ``members(key, rep, n, comp, bands)``, ``texts(doc_id, text)``. Tiles are first looked through by sizes and bands; only
    rows that are in some pair worth comparing get their texts, one a tile, and are compared on
    full sets there. Nothing but a spanning forest of links leaves a tile.
    """
    sort, order = parallelism(members.sparkSession), ("key", "i", "j", "rep")
    dealt = deal(members).repartition(sort, "key", "i", "j").sortWithinPartitions(*order)

    def used(g):
        seen = np.zeros(len(g), bool)
        for a, b in likely(g):
            seen[a] = seen[b] = True
        return g[seen] if seen.any() else None

    def look(frames: Iterator) -> Iterator:
        yield from (g for g in map(used, _whole(frames, least)) if g is not None)

    found = materialize(dealt.mapInPandas(look, dealt.schema), "tiles")
    m = found.join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep").select(*found.columns, "text")
    m = m.repartition(sort, "key", "i", "j").sortWithinPartitions(*order)

    def compare(g) -> list[tuple[int, int]]:
        found = list(likely(g))
        if not found:
            return []
        p, q = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
        used, place = np.unique(np.concatenate([p, q]), return_inverse=True)
        p, q, raw, sets = place[: len(p)], place[len(p) :], W.utf8(g["text"].iloc[used]), []
        for lo, hi in W.batches(raw):
            words = W.split(raw[lo:hi], lower=True)
            sets += [np.unique(h) for h in W.document_shingles(words, words.hashes(), SHINGLE)]
        size = np.array([len(h) for h in sets])
        common = _common(sets, p, q)
        link = least[1] * common >= least[0] * (size[p] + size[q] - common)
        rep, up, out = g["rep"].to_numpy()[used], list(range(len(used))), []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for a, b in zip(p[link].tolist(), q[link].tolist()):
            a_root, b_root = root(a), root(b)
            if a_root != b_root:
                up[b_root] = a_root
                out.append((rep[a], rep[b]))
        return out

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for g in _whole(frames, least):
            if out := compare(g):
                yield pd.DataFrame(out, columns=["a", "b"])

    links = materialize(m.mapInPandas(run, "a long, b long"), "more-links")
    discard(found)
    return links


def _whole(frames: Iterator, least: tuple[int, int]) -> Iterator:
    """Tiles of two or more rows out of frames in their order; the last tile of a frame may go on in the next."""
    import pandas as pd

    rest = None
    for frame in _ending(frames):
        if frame is not None:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if rest is None or rest.empty:
            continue
        keys = rest[["key", "i", "j"]].to_numpy()
        bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(rest)]
        if frame is not None:
            bounds.pop()
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo > 1:
                g = rest.iloc[lo:hi]
                g.attrs["least"] = least
                yield g
        rest = rest.iloc[bounds[-1] :] if frame is not None else None


def _ending(frames: Iterator) -> Iterator:
    yield from frames
    yield None


def near_duplicates(docs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    1. Documents with equal shingle sets become one representative, the smallest doc_id, before anything is compared.
    2. Every bucket of two or more links its members to its smallest one, a star; links are confirmed on full sets.
    3. Buckets whose members the stars leave in different components may hide a link between two members that the
       centre isn't like; there the members outside of the bucket's largest component are compared with all of other
       components, by their bands and then on full sets, tile by tile. So every pair that shares a band ends in the component it belongs to.
    Documents without words link with nothing; so do rows with a null doc_id. Rows that share a doc_id are one node.
    """
    spark = docs.sparkSession
    prepare(spark)
    sig = materialize(signatures(docs), "signatures")
    full = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = full.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    reps = materialize(reps.withColumnRenamed("n_shingles", "n"), "representatives")

    rows = reps.select("rep", "n", F.explode("bands").alias("key"))
    centres = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(rows.join(centres.drop("size"), "key").select("key", "rep", "n", F.col("centre.rep").alias("hub"), F.col("centre.n").alias("hub_n")), "buckets")
    texts = texts_of(docs, shared.select(F.col("rep").alias("doc_id")).distinct())
    fits = least[1] * F.least("n", "hub_n") >= least[0] * F.greatest("n", "hub_n")
    stars = materialize(shared.where((F.col("rep") != F.col("hub")) & fits).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct(), "stars")
    links = materialize(confirm(stars, texts, least), "links")
    discard(stars)
    parts = materialize(components(links), "parts")

    placed = shared.select("key", "rep", "n").join(parts.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    placed = materialize(placed, "placed")
    discard(shared, parts)
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    members = materialize(placed.join(mixed.hint("merge"), "key").join(reps.select("rep", "bands").hint("merge"), "rep"), "members")
    more = _tiles(members, texts, least)
    final = components(links.union(more))
    discard(placed, members, texts, links, more)

    placed = reps.join(final.toDF("rep", "component_id"), "rep", "left").select(F.col("n").alias("n_shingles"), "s1", "s2", F.coalesce("component_id", "rep").alias("c"))
    out = sig.drop("bands").join(placed, ["n_shingles", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """The rows of ``docs`` (all columns) whose document stays; rows are told apart by doc_id."""
    keep = near_duplicates(docs, least).where("kept").select(F.col("doc_id").alias("__near_id")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__near_id")), "left_semi")
