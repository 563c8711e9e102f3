"""Op 11. Divergence of sources inside a language, from runs of sorted (lang, term, source, document) rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .codepoints import together, whole_texts
from .common import materialize, parallelism, prepare

#: Documents of a language that must hold a term, terms listed per group, and the scale of probabilities.
LEAST, TOP, SCALE = 10, 10, 1_000_000_000
#: Characters of text whose rows are merged before they are shuffled, rows of a sorted scan that are looked at together, and
#: pairs of sources that a scan holds before it hands them on.
BLOCK, ROWS, PAIRS = 1 << 24, 1 << 16, 1 << 20
#: Bytes of terms: letters, A-Z in lower case, and whatever isn't ASCII; the others separate.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _changes(*codes: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.ones(len(codes[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in codes], axis=0)
    return np.flatnonzero(new)


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def counted(texts: list[str], group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, first document, documents, occurrences) per group and term of a block, by a sort and its runs."""
    raw = "".join(t + " " for t in texts).encode("utf-8", "surrogatepass").translate(_BYTES)
    solid = np.frombuffer(raw, np.uint8) != 32
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0))
    offsets = np.append(edge, len(raw)).astype(np.int64)
    every = pa.Array.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    terms = every.take(pa.array(np.arange(0, len(edge), 2))).dictionary_encode()
    size = np.array([len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts], np.int64)
    doc = np.searchsorted(np.cumsum(size), edge[::2], "right")
    code, docs, kinds = terms.indices.to_numpy(), max(len(texts), 1), max(len(terms.dictionary), 1)
    key = np.sort((group[doc] * kinds + code) * docs + doc)
    once = key[_changes(key)]  # a document counts once
    pair = once // docs
    starts = _changes(pair)
    first = once[starts]
    n = np.diff(np.append(np.searchsorted(key, first), len(key)))
    return terms.dictionary.take(pa.array(first // docs % kinds)).cast(pa.large_string()).cast(pa.string()), first // docs // kinds, first % docs, np.diff(np.append(starts, len(once))), n


def partial_rows(docs: DataFrame) -> DataFrame:
    """lang, term, source, doc, n_docs, n: of each block of documents, one row per term and (lang, source), doc the first that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _blocks(batches):
            names, group = [], np.empty(len(texts), np.int64)
            known: dict[tuple[str, str], int] = {}
            for i, name in enumerate(zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())):
                group[i] = known.setdefault(name, len(known))
            names = list(known)
            term, at, first, n_docs, n = counted(texts, group)
            lang, source = (pa.array([name[k] for name in names], pa.string()).take(pa.array(at)) for k in (0, 1))
            out = [lang, term, source, rows.column("doc_id").take(pa.array(first)), pa.array(n_docs), pa.array(n)]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in out], names=["lang", "term", "source", "doc", "n_docs", "n"])

    return docs.mapInArrow(run, "lang string, term string, source string, doc long, n_docs long, n long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    rows, texts, held = [], [], 0
    for some, more in whole_texts(batches, BLOCK):
        rows.append(some)
        texts += more
        held += sum(map(len, more))
        if held >= BLOCK:
            yield pa.concat_batches(rows), texts
            rows, texts, held = [], [], 0
    if rows:
        yield pa.concat_batches(rows), texts


def kept_terms(partial: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, source, n, total, first: counts of the terms that enough documents hold.

    Rows are dealt by (lang, term), sorted by (lang, term, source, document) and scanned as runs: document frequency and
    counts come out where a run ends. A run that goes on carries only its sums per source.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in _then_none(together(batches, ROWS)):
            if batch is not None:
                batch = batch.select(["lang", "term", "source", "n_docs", "n"])
            rows = left if batch is None else batch if left is None else pa.concat_batches([left, batch])
            if rows is None:
                continue
            lang, term, source = (_codes(rows.column(c)) for c in ("lang", "term", "source"))
            inner = _changes(lang, term, source)
            sums = [np.add.reduceat(rows.column(c).to_numpy(), inner) for c in ("n_docs", "n")]
            rows = rows.take(pa.array(inner))
            rows = pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(sums[0]), pa.array(sums[1])], names=rows.schema.names)
            outer = _changes(lang[inner], term[inner])
            whole = len(rows) if batch is None else int(outer[-1])
            left = rows.slice(whole) if whole < len(rows) else None
            outer = outer[outer < whole]
            if not len(outer):
                continue
            docs, total = (np.add.reduceat(x[:whole], outer) for x in sums)
            length = np.diff(np.append(outer, whole))
            first = np.zeros(whole, bool)
            first[outer] = True
            keep = np.repeat(docs >= least, length)
            done = rows.slice(0, whole)
            out = [done.column("lang"), done.column("term"), done.column("source"), done.column("n"), pa.array(np.repeat(total, length)), pa.array(first)]
            yield pa.RecordBatch.from_arrays(out, names=["lang", "term", "source", "n", "total", "first"]).filter(pa.array(keep))

    dealt = partial.repartition(parallelism(partial.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source", "doc")
    return dealt.mapInArrow(run, "lang string, term string, source string, n long, total long, first boolean")


def _then_none(items: Iterator) -> Iterator:
    yield from items
    yield None


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_terms(rows: DataFrame) -> DataFrame:
    """(lang, a, b, v), a < b: what terms that both sources have change in the sum over all terms.

    ``rows(lang, term, source, p, p0)`` are scanned in order; p0 is the source's p of a term that it doesn't have. Pairs of
    sources are summed up while the scan goes on and handed on as partial sums.
    """

    def summed(parts: list[tuple]) -> tuple:
        a, b, c, v = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((c, b, a))
        a, b, c, v = a[order], b[order], c[order], v[order]
        at = _changes(a, b, c)
        return a[at], b[at], c[at], np.add.reduceat(v, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, known, held = None, {}, []

        def code(column: pa.Array) -> np.ndarray:
            coded = column.dictionary_encode()
            own = np.array([known.setdefault(x, len(known)) for x in coded.dictionary.to_pylist()], np.int64)
            return own[coded.indices.to_numpy(zero_copy_only=False)]

        def out() -> pa.RecordBatch:
            names = pa.array(list(known), pa.string())
            lang, a, b, v = summed(held)
            held.clear()
            return pa.RecordBatch.from_arrays([*[names.take(pa.array(x)) for x in (lang, a, b)], pa.array(v)], names=["lang", "a", "b", "v"])

        for batch in _then_none(together(batches, ROWS)):
            rows = left if batch is None else batch if left is None else pa.concat_batches([left, batch])
            if rows is None:
                continue
            lang, term, source = code(rows.column("lang")), _codes(rows.column("term")), code(rows.column("source"))
            p, p0 = (rows.column(c).to_numpy() for c in ("p", "p0"))
            outer = _changes(lang, term)
            whole = len(rows) if batch is None else int(outer[-1])
            left = rows.slice(whole) if whole < len(rows) else None
            end = np.repeat(np.append(outer, len(rows))[1:], np.diff(np.append(outer, len(rows))))[:whole]
            at, step = np.arange(whole), 0
            while True:  # each row with the row that many places later in its run
                step += 1
                at = at[at + step < end[at]]
                if not len(at):
                    break
                x, y = at, at + step
                v = _f(p[x], p[y]) - _f(p[x], p0[y]) - _f(p0[x], p[y]) + _f(p0[x], p0[y])
                held.append((lang[x], source[x], source[y], v))
                if sum(len(h[0]) for h in held) > PAIRS:
                    held[:] = [summed(held)]
                    if len(held[0][0]) > PAIRS // 2:
                        yield out()
        if held:
            yield out()

    dealt = rows.repartition(parallelism(rows.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.select("lang", "term", "source", "p", "p0").mapInArrow(run, "lang string, a string, b string, v long")


def probability(count: str, size: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (size + 2 * terms)) in whole numbers; null where there are no terms."""
    whole = "CAST({} AS DECIMAL(19, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + {SCALE} * {whole.format(f'({count} + 2)')} div {whole.format(f'({size} + 2 * {terms})')} END")


def divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) in whole numbers."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def source_audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms are from the other sources' and from its language's.

    Part ``pair`` has every other source of the language and the divergence summed over all terms of the language;
    part ``term`` the ``top`` terms by which the source exceeds its language. Terms are letters and anything outside
    ASCII, A-Z in lower case, that at least ``least`` documents (rows) of the language hold.

    A term that a pair of sources lacks adds the same to the pair's sum, and one that only one of them has adds what
    its count alone says, so the sums are put together from counts of counts per source and from runs of the
    terms that both have. Nothing is as long as terms times pairs of sources, and no source's list of terms meets in one task: a
    term's run has at most one row a source and block of text.

    Null text, lang and source are ''. Groups without terms are listed with value 0 where the language has no terms. Repeated rows
    count one by one; other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *named)
    kept = materialize(kept_terms(partial_rows(rows), least), "terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("first").alias("terms"))
    groups = docs.select(*named).distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("size", "lang_size", "terms")])
    groups = materialize(groups.withColumn("p0", probability("0", "size", "terms")), "groups")

    met = kept.join(groups, ["lang", "source"]).withColumn("p", probability("n", "size", "terms"))
    above = met.withColumn("q", probability("total", "lang_size", "terms")).where("p > q")
    above = above.select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))

    one, two = groups.alias("x"), groups.alias("y")
    both = (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") != F.col("y.source"))
    names = [F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b")]
    none = one.join(two, both).select(*names, F.coalesce(F.col("x.terms") * divergence("x.p0", "y.p0"), F.lit(0)).alias("v"))
    counts = met.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")).alias("x")
    own = counts.join(two, both).select(*names, (F.col("x.m") * (divergence("x.p", "y.p0") - divergence("x.p0", "y.p0"))).alias("v"))
    own = own.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))
    common = shared_terms(met)
    swapped = lambda d: d.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "v")
    pairs = none.union(own).union(swapped(own)).union(common).union(swapped(common)).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = [d.withColumn("rank", F.row_number().over(ranked)) for d in (pairs, above)]
    out = [d.select("lang", "source", F.lit(n).alias("part"), "item", "value", "rank") for n, d in zip(("pair", "term"), (parts[0], parts[1].where(F.col("rank") <= top)))]
    return out[0].union(out[1])


def source_divergence(docs: DataFrame) -> DataFrame:
    """The audit with the contract's figures: terms of 10 documents, ten terms a group."""
    return source_audit(docs, LEAST, TOP)
