"""Texts of a batch as arrays of code points, without per-character Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters of text that are worked on at a time.
BATCH = 1 << 22
#: Code points that some engine takes for white space, and other invisible ones.
BLANKS = [*range(0x21), 0x7F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), *range(0x205F, 0x2065), 0x3000, 0xFEFF]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def byte_sizes(points: np.ndarray) -> np.ndarray:
    """Bytes of each code point in UTF-8."""
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def whole_texts(batches: Iterator[pa.RecordBatch], limit: int = BATCH) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with a column ``text`` and their texts (null is empty), about ``limit`` characters each."""
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        begin = held = 0
        for i, t in enumerate(texts):
            held += len(t)
            if held >= limit or i + 1 == len(texts):
                yield batch.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, held = i + 1, 0


def together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows`` (but for the last)."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for all (s, n), one after the other."""
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(int(length.sum()))]


def binaries(flat: np.ndarray, count: np.ndarray) -> pa.Array:
    """A binary column whose values are the next ``count`` numbers of ``flat`` each."""
    ends = np.concatenate([[0], np.cumsum(count)]) * flat.itemsize
    if ends[-1] >= 1 << 31:
        raise ValueError("more than 2 GiB of values in one batch")
    return pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
