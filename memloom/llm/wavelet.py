"""Op 1. Token ids in wavelet-matrix shards: access, rank, select, counting and occurrence lookup on one compressed file.

A shard is one binary file: a header, the document table, and per bit of the largest id one plane of n bits, cut
into blocks that are compressed one by one, with a directory of the ones before each block. A lookup inflates one
or two blocks a plane and never the whole file. Shards are kept as a Parquet table of one row a shard (``part``, ``shard``,
``n_tokens``, ``payload``), so Spark's own writers and readers carry them on any file system.

File format (all little-endian): magic ``WMX2``; u32 levels, u64 tokens, u64 documents, u64 bytes of the document table;
the table (zstd frame): per document i64 doc_id, u8 is-null, u64 tokens; per level u64 zeros, u32 blocks, then per block
u64 ones before it and u32 bytes of its frame, then the zstd frames (with checksums) of ``BLOCK`` bits each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, parallelism, prepare
from .tokens import encoded, encoder, vocabulary

#: Ids after which a shard ends (with its current document).
SHARD_TOKENS = 1 << 20
#: Bits of a block.
BLOCK = 1 << 15
#: Inflated blocks that a matrix keeps.
HELD = 256


class Plane:
    """One level's bits in compressed blocks, with the ones before each block (and, last, of all)."""

    def __init__(self, zeros: int, before: np.ndarray, blocks: list):
        self.zeros, self.before, self.blocks = zeros, before, blocks


class WaveletMatrix:
    """Succinct sequence of unsigned ids; rank and select per plane answer every query."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes, self.levels = n, planes, len(planes)
        self._held: dict[tuple[int, int], bytes] = {}
        self._inflate = zstandard.ZstdDecompressor()

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        levels = int(ids.max()).bit_length() if len(ids) else 0
        ids = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        deflate, planes = zstandard.ZstdCompressor(level=1, write_checksum=True), []
        for level in range(levels - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << level)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            blocks = [packed[i : i + BLOCK // 8] for i in range(0, len(packed), BLOCK // 8)]
            ones = np.add.reduceat(bit, np.arange(0, len(bit), BLOCK), dtype=np.int64)
            before = np.concatenate([[0], np.cumsum(ones)])
            planes.append(Plane(len(ids) - int(before[-1]), before, [deflate.compress(b.tobytes()) for b in blocks]))
            ids = np.concatenate([ids.compress(~bit), ids.compress(bit)])
        return cls(len(ids), planes)

    def _block(self, level: int, block: int) -> bytes:
        raw = self._held.get((level, block))
        if raw is None:
            if len(self._held) >= HELD:
                self._held.clear()
            raw = self._held[level, block] = self._raw(self.planes[level].blocks[block])
        return raw

    def _raw(self, frame) -> bytes:
        try:
            return self._inflate.decompress(frame)
        except zstandard.ZstdError as e:
            raise ValueError("damaged wavelet shard") from e

    def _bit(self, level: int, i: int) -> int:
        return self._block(level, i // BLOCK)[i % BLOCK >> 3] >> (i & 7) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, rest = divmod(i, BLOCK)
        total = int(self.planes[level].before[block])
        if rest:
            head = int.from_bytes(self._block(level, block)[: rest + 7 >> 3], "little")
            total += (head & ((1 << rest) - 1)).bit_count()
        return total

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        before = self.planes[level].before
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(np.frombuffer(self._block(level, block), np.uint8), bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, plane in enumerate(self.planes):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value, i = value << 1 | bit, plane.zeros + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` in positions lo:hi stand behind the last plane."""
        for level, plane in enumerate(self.planes):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = plane.zeros + a, plane.zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often ``token`` stands in positions start:stop."""
        if token >> self.levels:
            return 0
        lo, hi = self._range(token, start, self.n if stop is None else stop)
        return max(0, hi - lo)

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        if k < 0 or token >> self.levels:
            return -1
        lo, hi = self._range(token, 0, self.n)
        if k >= hi - lo:
            return -1
        at = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._select(level, bit, at - self.planes[level].zeros if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last to the first."""
        ids = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            packed = np.frombuffer(b"".join(map(self._raw, self.planes[level].blocks)), np.uint8)
            bit = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            order = np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])
            merged = np.empty_like(ids)
            merged[order] = ids
            merged |= bit.astype(ids.dtype) << ids.dtype.type(self.levels - 1 - level)
            ids = merged
        return ids.astype(np.uint32)


def pack_shard(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    table = zstandard.ZstdCompressor(level=1, write_checksum=True).compress(b"".join(struct.pack("<q?Q", d or 0, d is None, n) for d, n in zip(doc_ids, lengths)))
    parts = [struct.pack("<4sIQQQ", b"WMX2", matrix.levels, len(ids), len(doc_ids), len(table)), table]
    for plane in matrix.planes:
        directory = np.empty(len(plane.blocks), _ENTRY)
        directory["before"], directory["size"] = plane.before[:-1], [len(b) for b in plane.blocks]
        parts += [struct.pack("<QI", plane.zeros, len(plane.blocks)), directory.tobytes(), *plane.blocks]
    return b"".join(parts)


_ENTRY = np.dtype([("before", "<u8"), ("size", "<u4")])


def open_shard(payload: bytes) -> tuple[list[int | None], list[int], WaveletMatrix]:
    """(doc_ids, lengths, matrix) of a shard file, no plane inflated; ValueError if it is damaged, here or when a block is read."""
    magic, levels, n, docs, size = struct.unpack_from("<4sIQQQ", payload)
    if magic != b"WMX2":
        raise ValueError("not a wavelet shard")
    at = struct.calcsize("<4sIQQQ")
    try:
        rows = list(struct.iter_unpack("<q?Q", zstandard.ZstdDecompressor().decompress(payload[at : at + size])))
    except zstandard.ZstdError as e:
        raise ValueError("damaged wavelet shard") from e
    if len(rows) != docs:
        raise ValueError("damaged wavelet shard")
    at, view, planes = at + size, memoryview(payload), []
    for _ in range(levels):
        zeros, count = struct.unpack_from("<QI", payload, at)
        at += 12
        directory = np.frombuffer(payload, _ENTRY, count, at)
        at += directory.nbytes
        blocks = []
        for length in directory["size"].tolist():
            blocks.append(view[at : at + length])
            at += length
        planes.append(Plane(zeros, np.append(directory["before"].astype(np.int64), n - zeros), blocks))
    return [None if null else d for d, null, _ in rows], [length for _, _, length in rows], WaveletMatrix(n, planes)


def write_shards(docs: DataFrame, vocabulary_path: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards in ascending doc_id order; returns the written table.

    Null texts are empty (the end id alone); rows that share a doc_id follow one another by their text; a null
    doc_id comes first. Documents are never cut: a shard ends after the document that fills it.
    Other columns are ignored. An empty input gives no shard.
    """
    spark = docs.sparkSession
    prepare(spark)

    def encode(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        tokens = encoder(vocabulary_path, glued=True)
        doc_ids, lengths, chunks, total = [], [], [], 0

        def flush():
            nonlocal shard, total
            ids = np.concatenate(chunks)
            row = pd.DataFrame({"part": [part], "shard": [shard], "n_tokens": [len(ids)], "payload": [pack_shard(doc_ids, lengths, ids)]})
            shard += 1
            total = 0
            for held in (doc_ids, lengths, chunks):
                held.clear()
            return row

        for some, ids, length in encoded(frames, tokens, end_id):
            ends, begin, at = np.cumsum(length), 0, 0
            while begin < len(some):
                # documents up to the one that fills the shard
                end = min(len(some), int(np.searchsorted(ends, at + shard_tokens - total)) + 1)
                doc_ids += some[begin:end]
                lengths += length[begin:end].tolist()
                chunks.append(ids[at : ends[end - 1]])
                total += len(chunks[-1])
                begin, at = end, int(ends[end - 1])
                if total >= shard_tokens:
                    yield flush()
        if doc_ids:
            yield flush()

    text = F.coalesce("text", F.lit(""))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))
    ordered = ordered.repartitionByRange(parallelism(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return materialize(ordered.mapInPandas(encode, "part int, shard int, n_tokens long, payload binary"), "wavelet")


def read_shards(shards: DataFrame, digest: bool = False) -> DataFrame:
    """Documents of written shards: (doc_id, start, n_tokens, ids), start counting the ids of all documents before.

    With ``digest`` the crc32 of the ids as little-endian unsigned 32-bit integers stands in their place.
    """
    prepare(shards.sparkSession)

    read, kind = (zlib.crc32, "long") if digest else (np.ndarray.tobytes, "binary")

    def decode(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for part, shard, payload in zip(frame["part"], frame["shard"], frame["payload"]):
                doc_ids, lengths, matrix = open_shard(payload)
                ids = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                for lo in range(0, len(doc_ids), 2000):
                    cut = slice(lo, lo + 2000)
                    yield pd.DataFrame({"part": part, "shard": shard, "doc_id": pd.array(doc_ids[cut], "Int64"), "at": starts[cut], "n_tokens": lengths[cut], "ids": [read(ids[a:b]) for a, b in zip(starts[cut], ends[cut])]})

    # a row a shard, then a row a partition: the offsets are small at any size
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    offsets = shards.select("part", "shard", inside.alias("shard_start")).join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("base"))
    docs = shards.select("part", "shard", "payload").mapInPandas(decode, f"part int, shard int, doc_id long, at long, n_tokens long, ids {kind}")
    return docs.join(offsets, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def token_shards(docs: DataFrame, vocabulary_name: str = "byte_bpe_50k.json") -> DataFrame:
    """Digest of the stored sequence, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    return read_shards(write_shards(docs, vocabulary(vocabulary_name)), digest=True).withColumnRenamed("ids", "ids_crc32")
