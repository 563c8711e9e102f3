"""Op 12. Alignment of two tokenizers: distinct segments are tokenised and aligned once, documents composed from them."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .codepoints import BLANKS, byte_sizes, code_points, gathered, together, whole_texts
from .common import discard, materialize, parallelism, prepare
from .tokens import _BYTE_LETTERS, vocabulary

#: Characters of text whose segments share one list (a block), distinct segments at which a block ends, and characters that are cut at a time.
BLOCK, DISTINCT, PIECE = 1 << 26, 1 << 20, 1 << 20
#: White space before which texts may be split.
SPLITS = "\t\n\r "
#: How the second vocabulary writes a space.
SPACE = "▁"
#: Segments that are aligned at a time, and documents that are composed at a time.
SEGMENTS, TOGETHER = 20_000, 256

_pairs: dict[tuple[str, str], "Pair"] = {}


class Pair:
    """Both tokenizers, their tokens' bytes, and where neither can merge across."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens = True
        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        # the byte-level pattern ends a piece before every white space run
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("the first vocabulary may merge across white space")
        letters = {c: b for b, c in _BYTE_LETTERS.items()}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = _Bytes([bytes(letters[c] for c in t) if set(t) <= letters.keys() else t.encode() for t in names])
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = _Bytes([bytes([int(t[3:-1], 16)]) if self.b.is_byte(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(names)])
        self.space = self.b.piece_to_id(SPACE)
        inside = {(x, y) for t in names for x, y in zip(t.replace(SPACE, " "), t.replace(SPACE, " ")[1:]) if y in SPLITS}
        if self.b_bytes.of([self.space]) != b" ":
            raise ValueError("the second vocabulary has no space of its own")
        # a split needs the prefix space to stand alone before it, so white space that some piece joins to a space is none
        self.splits = [c for c in SPLITS if c == " " or (" ", c) not in inside]
        #: (character, white space) that some piece of the second vocabulary holds side by side
        self.joined = np.array(sorted((ord(x) << 21) | ord(y) for x, y in inside if y in self.splits), np.int64)
        self.is_split, self.is_blank = np.zeros((2, 0x110000), bool)
        self.is_split[[ord(c) for c in self.splits]] = True
        self.is_blank[BLANKS + [ord(SPACE)]] = True
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        if self.b.normalize(every) != SPACE + every.replace(" ", SPACE):
            raise ValueError("the second vocabulary changes texts before it cuts them")

    def segments(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(UTF-8 of all texts, each after a space; starts of segments; number of segments of each text)."""
        joined = "".join(" " + t for t in texts)
        points = code_points(joined)
        first = np.cumsum([len(t) + 1 for t in texts]) - [len(t) + 1 for t in texts]
        before = np.concatenate([points[:1], points[:-1]])
        at = np.flatnonzero(self.is_split[points] & ~self.is_blank[before])
        kept = at[~np.isin(before[at].astype(np.int64) << 21 | points[at], self.joined)]
        begins = np.zeros(len(points), bool)
        begins[kept] = begins[first] = True
        start = np.flatnonzero(begins)
        size = byte_sizes(points)
        count = np.diff(np.append(np.searchsorted(start, first), len(start)))
        return joined.encode("utf-8", "surrogatepass"), (np.cumsum(size) - size)[start], count

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments as they stand inside a text; the library puts a space before each."""
        out = self.b.encode([s[1:] if s[:1] == " " else s for s in segments], num_threads=1)
        for i, s in enumerate(segments):
            if s == " ":
                out[i] = [self.space]
            elif s[:1] != " ":
                if out[i][:1] != [self.space]:
                    raise ValueError(f"no boundary before {s[:20]!r}")
                out[i] = out[i][1:]
        return out

    def align(self, segments: list[str]) -> pa.RecordBatch:
        """groups (as text), n_a, n_b, links_a and links_b (ids of the links) of each segment."""
        ids_a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        ids_b = self.encode_b(segments)
        raw = [s.encode() for s in segments]
        (flat_a, ends_a), (flat_b, ends_b) = self.a_bytes.ends(ids_a, raw), self.b_bytes.ends(ids_b, raw)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)  # of each group
        size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        upto = np.searchsorted(common, np.cumsum([len(r) for r in raw]), "right")  # groups of the segments so far
        # a group's tokens of A, then those of B
        words = np.empty(len(flat_a) + len(flat_b), object)
        at_a = np.arange(len(flat_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        at_b = np.arange(len(flat_b)) + np.repeat(np.cumsum(size_a), size_b)
        words[at_a], words[at_b] = self.a_bytes.after[","][flat_a], self.b_bytes.after[","][flat_b]
        first_a, first_b = last_a - size_a + 1, last_b - size_b + 1
        words[at_a[first_a]], words[at_b[first_b]] = self.a_bytes.after[";"][flat_a[first_a]], self.b_bytes.after["|"][flat_b[first_b]]
        ends, words = np.cumsum(n_a + n_b), words.tolist()
        groups = ["".join(words[x:y])[1:] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]
        offsets = pa.array(np.concatenate([[0], upto]), pa.int32())
        links = [pa.ListArray.from_arrays(offsets, pa.array(flat[last], pa.int32())) for flat, last in ((flat_a, last_a), (flat_b, last_b))]
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(n_a), pa.array(n_b), *links], names=["groups", "n_a", "n_b", "links_a", "links_b"])


class _Bytes:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat, self.start = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.size) - self.size
        #: every id as text after a separator
        self.after = {c: np.array([f"{c}{i}" for i in range(len(tokens))], object) for c in ",;|"}

    def of(self, ids: list[int]) -> bytes:
        return gathered(self.flat, self.start[ids], self.size[ids]).tobytes()

    def ends(self, ids: list[list[int]], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each token ends) in the segments, one after the other, whose bytes they must give back."""
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
        if self.of(flat) != b"".join(raw):
            raise ValueError("tokens don't give back their text")
        return flat, np.cumsum(self.size[flat])


def pair(byte_level: str, pieces: str) -> Pair:
    if (byte_level, pieces) not in _pairs:
        _pairs[byte_level, pieces] = Pair(byte_level, pieces)
    return _pairs[byte_level, pieces]


def _squeezed(numbers: np.ndarray, kind: str) -> bytes:
    return pa.compress(np.ascontiguousarray(numbers, kind).tobytes(), codec="zstd", asbytes=True)


def _unsqueezed(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


_BLOCKS = "block long, code int, segment string, n long, n_docs int, n_codes long, has_id binary, doc_ids binary, counts binary, codes binary"


class Block:
    """Documents as numbers of segments, and the segments they hold with their numbers of occurrences."""

    def __init__(self):
        self.places: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.codes: list[np.ndarray] = []
        self.held = 0

    def add(self, both: Pair, ids: list[int | None], texts: list[str]) -> None:
        self.held += sum(map(len, texts))
        # a text that holds the sign for a space itself can't be given back: no tokens
        texts = ["" if SPACE in t else t for t in texts]
        raw, start, count = both.segments(texts)
        offsets = np.append(start, len(raw)).astype(np.int64)
        every = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        own = np.repeat([bool(t) for t in texts], count)
        coded = every.filter(pa.array(own, pa.bool_())).dictionary_encode()
        place = np.array([self.places.setdefault(s, len(self.places)) for s in coded.dictionary.to_pylist()], np.int64)
        self.ids += ids
        self.counts.append(np.where([bool(t) for t in texts], count, 0))
        self.codes.append(place[coded.indices.to_numpy()].astype(np.uint32))

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """Frequent segments get small codes, which compress better."""
        codes, count = np.concatenate(self.codes), np.concatenate(self.counts)
        size = len(self.places)
        n = np.bincount(codes, minlength=size)
        order = np.argsort(-n, kind="stable")
        place = np.empty(size, np.int64)
        place[order] = np.arange(size)
        ids, known = np.array([d or 0 for d in self.ids], np.int64), np.array([d is not None for d in self.ids], np.uint8)
        packed = [known.tobytes(), _squeezed(ids, "<i8"), _squeezed(count, "<i8"), _squeezed(place[codes], "<u4")]
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
        segments = pa.array(self.places, pa.string()).take(pa.array(order))
        for at in range(0, size, SEGMENTS):
            some = segments.slice(at, SEGMENTS)
            numbers = [pa.array(np.full(len(some), block)), pa.array(np.arange(at, at + len(some)), pa.int32()), some, pa.array(n[order[at : at + SEGMENTS]])]
            yield pa.RecordBatch.from_arrays([*numbers, *[pa.nulls(len(some), k) for k in kinds]], names=_names(_BLOCKS))
        own = [pa.array([v], k) for v, k in zip([len(ids), len(codes), *packed], kinds)]
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), *own], names=_names(_BLOCKS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def blocks(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Rows (block, code, segment, n) list a block's distinct segments and how often they occur; one more row per block
    has its documents' ids and their segments' codes, compressed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, block, number = pair(byte_level, pieces), Block(), TaskContext.get().partitionId() << 32
        for rows, texts in whole_texts(batches, PIECE):
            block.add(both, rows.column("doc_id").to_pylist(), texts)
            if block.held >= BLOCK or len(block.places) >= DISTINCT:
                yield from block.rows(number)
                block, number = Block(), number + 1
                pa.default_memory_pool().release_unused()
        if block.ids:
            yield from block.rows(number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCKS)


def aligned(segments: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """segment, n, and its alignment: groups, n_a, n_b, links_a, links_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_level, pieces)
        for batch in together(batches, SEGMENTS):
            out = both.align(batch.column("segment").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *out.columns], names=["segment", "n", *out.schema.names])

    return segments.mapInArrow(run, "segment string, n long, groups string, n_a long, n_b long, links_a array<int>, links_b array<int>")


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def _composed(row: dict, packed: pa.Array) -> Iterator[pa.RecordBatch]:
    """Documents of one block from its segments' alignments, in order of code, as n_a/n_best/count_sum/groups."""
    fields = pc.split_pattern(packed, "/").flatten()
    at = np.arange(len(packed)) * 4
    n_a, n_best, count_sum = (fields.take(pa.array(at + i)).cast(pa.int64()).to_numpy() for i in range(3))
    groups = fields.take(pa.array(at + 3))
    del fields
    n = pc.count_substring(groups, "|").to_numpy()
    numbers = [n_a, pc.count_substring(groups, ",").to_numpy() + 2 * n - n_a, n, n_best, count_sum]
    ids, count = (_unsqueezed(row[c], row["n_docs"], "<i8") for c in ("doc_ids", "counts"))
    codes, known = _unsqueezed(row["codes"], row["n_codes"], "<u4"), np.frombuffer(row["has_id"], np.uint8)
    ends = np.cumsum(count)
    for at in range(0, len(ids), TOGETHER):
        some = slice(at, at + TOGETHER)
        first = int(ends[at] - count[at])
        own, upto = codes[first : int(ends[some][-1])], ends[some] - first
        sums = [np.concatenate([[0], np.cumsum(x[own], dtype=np.int64)]) for x in numbers]
        n = [pa.array(x[upto] - x[upto - count[some]]) for x in sums]
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, upto), pa.int32()), groups.take(pa.array(own))), ";")
        doc = pa.array(ids[some], pa.int64(), mask=known[some] == 0)
        yield pa.RecordBatch.from_arrays([doc, n[0], n[1], n[2], n[2], n[3], n[4], text], names=_names(_OUT))


def composed(rows: DataFrame) -> DataFrame:
    """Documents from ``rows`` of whole blocks in order: of each block first its documents, then its segments' alignments by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, packed = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if row is not None:
                yield from _composed(row, pa.concat_arrays([pa.array([], pa.string()), *packed]))
                packed.clear()
                pa.default_memory_pool().release_unused()

        for batch in together(batches, SEGMENTS):
            begins = np.flatnonzero(batch.column("code").is_null().to_numpy(zero_copy_only=False)).tolist()
            bounds = [0, *begins, batch.num_rows]
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if i:  # a block starts
                    yield from done()
                    row, a = batch.slice(a, 1).to_pylist()[0], a + 1
                packed.append(batch.column("packed").slice(a, b - a))
        yield from done()

    return rows.mapInArrow(run, _OUT)


def align_documents(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups per row of ``docs``.

    Space and text are cut by a byte-level vocabulary (A) and text by a piece vocabulary that adds the space itself
    (B); byte offsets where tokens of both end bound the groups, and the last tokens of a group are linked. n_best counts
    links whose id pair is linked most often, over all rows, among those of its B id; count_sum adds up the pairs' counts;
    groups has ids as ``a1,a2|b1;a3|b2,b3``.

    Texts are split before white space runs where no piece of either vocabulary can reach across (``Pair`` checks it),
    each distinct segment is tokenised and aligned once for the whole table, alignments are joined back to the blocks
    that hold the segment, and each block composes its documents. A segment meets at most one row a block, so no
    frequent word makes a hot key, and a block is a bounded amount of text or one document.

    Null and empty texts and texts that hold U+2581 (which B can't give back) have no tokens: zeros and ''. Repeated rows and ids
    count one by one; a null doc_id stays null; other columns are ignored; an empty table gives an empty one.
    """
    prepare(docs.sparkSession)
    held = materialize(blocks(docs, byte_level, pieces), "blocks", "zstd")
    listed = held.where("segment IS NOT NULL").select("block", "code", "segment", "n")
    once = listed.groupBy("segment").agg(F.sum("n").alias("n"))
    known = materialize(aligned(once, byte_level, pieces), "alignments")

    links = known.select("segment", "n", F.explode(F.arrays_zip("links_a", "links_b")).alias("l")).select("segment", "n", F.col("l.links_a").alias("a"), F.col("l.links_b").alias("b"))
    pairs = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    pairs = pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))
    pairs = materialize(pairs, "pairs")
    scored = links.join(pairs, ["a", "b"]).groupBy("segment").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    scored = known.select("segment", "groups", "n_a").join(scored, "segment").select("segment", F.concat_ws("/", *[F.col(c).cast("string") for c in ("n_a", "n_best", "count_sum", "groups")]).alias("packed"))
    scored = materialize(scored, "scored", "zstd")
    discard(known, pairs)
    back = listed.select("block", "code", "segment").join(scored, "segment").drop("segment")
    whole = held.where("codes IS NOT NULL").drop("segment", "n")
    rows = whole.unionByName(back, allowMissingColumns=True)
    return composed(rows.repartition(parallelism(docs.sparkSession), "block").sortWithinPartitions("block", "code"))


def alignments(docs: DataFrame, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> DataFrame:
    """Digest of the alignment: the groups give way to their SHA-256 ('' without tokens)."""
    out = align_documents(docs, vocabulary(byte_level), vocabulary(pieces))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.withColumn("groups_sha256", digest).drop("groups")
