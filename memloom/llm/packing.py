"""Op 9. Sequence packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .tokens import encoded, encoder, vocabulary

CAPACITY = 4096
#: Windows that are balanced together.
GROUP = 32
#: Share of a group's capacity that is left free, so that equal windows fit at the first attempt.
SLACK = 0.01
#: Longest piece of a rest: small pieces balance well.
PIECE = 1024


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Largest differencing: k lists of indexes into ``sizes`` with near-equal sums.

    Each size starts as a partition of k - 1 empty sets and itself. The two partitions with the largest spread
    are merged, the largest set of one with the smallest of the other, until one is left.
    """
    if k <= 1:
        return [list(range(len(sizes)))]
    heap = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, (size, *[0] * (k - 1)), ([i], *[None] * (k - 1))))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        merged = sorted(((x + y, p, q) for (x, p), (y, q) in zip(zip(a, in_a), zip(reversed(b), reversed(in_b)))), key=lambda s: -s[0])
        low = merged[-1][0]
        sums = tuple(s - low for s, _, _ in merged)
        sets = tuple((p, q) if p and q else p or q for _, p, q in merged)  # trees, flattened once
        heapq.heappush(heap, (-sums[0], serial, sums, sets))
        serial += 1
    return [_flat(t) for t in heap[0][3]] if heap else [[] for _ in range(k)]


def _flat(tree) -> list[int]:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, tuple):
            todo += [t[1], t[0]]
        elif t:
            out += t
    return out


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Fewest windows from the lower bound on whose largest differencing fits; sizes must not exceed the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return [w for w in found if w]
        k += 1


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 2, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of the packed documents: doc_id, start, length, ids (binary, little-endian u32), doc_tokens, sequence_id, offset.

    Each partition packs its own documents: whole windows are cut off first, the rests, in pieces of at most ``PIECE`` ids, are gathered to groups of
    ``group`` windows (a rest is cut at a group's border) and balanced. Padding is what near-equal windows leave,
    and half a window a partition on average. Null texts are empty and give their end id alone. Repeated rows and
    doc_ids are packed as they come; the order of sequences means nothing. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    room = int(group * capacity * (1 - SLACK))

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        tokens, sequence, rows = encoder(vocabulary_path, glued=False), TaskContext.get().partitionId() << 36, []
        rests, held = [], 0

        def close(pieces) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, total in pieces:
                rows.append((doc_id, start, len(ids) // 4, ids, total, sequence, offset))
                offset += len(ids) // 4
            sequence += 1

        def balance() -> None:
            nonlocal held
            for w in windows([len(r[2]) // 4 for r in rests], capacity):
                close([rests[i] for i in w])
            rests.clear()
            held = 0

        def frame_of() -> "pd.DataFrame":
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            rows.clear()
            return out

        for some, every, length in encoded(frames, tokens, end_id):
            raw, done = every.tobytes(), 0
            for doc_id, total in zip(some, length.tolist()):
                ids, at = raw[4 * done : 4 * (done + total)], 0
                done += total
                while total - at >= capacity:
                    close([(doc_id, at, ids[4 * at : 4 * (at + capacity)], total)])
                    at += capacity
                while at < total:
                    size = min(total - at, PIECE, room - held)
                    rests.append((doc_id, at, ids[4 * at : 4 * (at + size)], total))
                    at, held = at + size, held + size
                    if held >= room:
                        balance()
            if rows:
                yield frame_of()
        if rests:
            balance()
        if rows:
            yield frame_of()

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, schema)


def packed_sequences(docs: DataFrame, vocabulary_name: str = "word_bpe_49k.json") -> DataFrame:
    """Digest of the packed pieces: ids give way to their crc32."""
    pieces = pack(docs, vocabulary(vocabulary_name))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
