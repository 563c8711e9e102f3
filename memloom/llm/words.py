"""Vectorised words and word-shingle hashes for batches of whole texts (numpy, no per-word Python).

Words are maximal runs of anything but ASCII white space (space and U+0009..U+000D).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash

U64 = np.uint64
#: Bytes from which a word is hashed by itself.
LONG = 512
#: Two independent families of hashes.
_SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEPS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of a batch: byte spans in ``buf`` and for document i the words first[i]:first[i + 1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: its length and its bytes, eight at a time, each step mixed.

        Mixing isn't linear, so no pattern of letters makes words collide as it does for sums of powers.
        """
        length = self.end - self.start
        out = mix(length.astype(U64) * U64(_STEPS[family]) + U64(_SEEDS[family]))
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        for i in np.flatnonzero(length > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(self.buf[self.start[i] : self.end[i]].tobytes(), _SEEDS[family])
        at = np.flatnonzero(length <= LONG)
        begin, left, h = self.start[at], length[at], out[at]
        while len(at):
            h = mix((h ^ (eight[begin] & _BYTES[np.minimum(left, 8)])) * U64(_STEPS[family]) + U64(_SEEDS[family]))
            out[at] = h
            more = left > 8
            at, begin, left, h = at.compress(more), begin.compress(more) + 8, left.compress(more) - 8, h.compress(more)
        return out

    def text(self, doc: int, keep: np.ndarray | None = None) -> bytes:
        """The document's words, or those of a boolean mask over them, joined by one space."""
        a, b = int(self.first[doc]), int(self.first[doc + 1])
        at = np.arange(a, b) if keep is None else np.flatnonzero(keep) + a
        return b" ".join(self.buf[s:e].tobytes() for s, e in zip(self.start[at].tolist(), self.end[at].tolist()))


def split(texts: list[bytes], lower: bool = False) -> Words:
    """Words of UTF-8 texts; ``lower`` maps A-Z to a-z first."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        buf = np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    doc_end = np.cumsum(size)
    first = np.searchsorted(start, np.concatenate([[0], doc_end]), "left")
    return Words(buf, start, end, first)


def shingles(word_hash: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hashes of the k words from each word on (the last k - 1 entries are left out); ignores document borders."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    pair = lambda x, y: mix((x ^ (y >> U64(29))) * U64(_STEPS[family]) + y)
    out, done, power, width = None, 0, word_hash, 1
    while True:  # doubling: hashes of 1, 2, 4 ... words combine to k
        if k & width:
            part = power[done : done + n]
            out = part.copy() if out is None else pair(out, part)
            done += width
        if width * 2 > k:
            return mix(out + U64(k))
        power = pair(power[:-width], power[width:])
        width *= 2


def document_shingles(words: Words, word_hash: np.ndarray, k: int, family: int = 0) -> Iterator[np.ndarray]:
    """For each document its shingle hashes in order; with fewer words than k, the whole sequence as one."""
    every = shingles(word_hash, k, family)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            yield every[a : b - k + 1]
        elif b > a:
            yield shingles(word_hash[a:b], b - a, family) ^ U64(b - a)
        else:
            yield np.empty(0, U64)


def batches(texts, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that hold about ``limit`` bytes together."""
    begin = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column) -> list[bytes]:
    """Texts of a pandas column or Arrow array; null is empty."""
    return [b"" if not isinstance(t, str) else t.encode("utf-8", "surrogatepass") for t in column]
