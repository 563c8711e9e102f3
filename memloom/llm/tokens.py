"""Exact token ids with a bounded per-worker memory of encoded chunks.

Byte-pair tokenizers cut text into pieces before merging, and every piece boundary used here (before a
single space or newline, between letters and signs) is one of the tokenizer's own, so a chunk's ids don't depend on
what surrounds it. The tokenizers library encodes each piece that is not yet known; texts whose white space is unusual
go to it whole. (The library's merges alone take words of letters only; see ``_PLAIN``.)
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks kept; then the memory starts anew.
CHUNKS = 1_000_000
#: Characters of text that are encoded at a time.
BATCH = 1 << 22
#: Marks the chunk that begins a text; texts with this character go to the library whole.
FIRST = "\x01"
#: White space other than space and newline, characters that may be white space to only one of the two sides, and runs of
#: white space (in the syntax of Arrow's expressions).
_ODD = r"[\x01\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]|  | \n|\n |\n\n|<\|"
_encoders: dict[tuple[str, bool], "Encoder"] = {}


#: Letters, and then signs but no apostrophe: two pieces (or one) in both vocabularies.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


class Encoder(dict):
    """Ids by chunk. ``glued``: a space belongs to the chunk that follows it (byte-level); else white space is dropped.

    A chunk stands for itself behind a space; ``FIRST`` before it says that nothing, and a newline that a newline, is there.
    """

    def __init__(self, path: str, glued: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.glued, self.tails = Tokenizer.from_file(path), glued, {}
        self.model = self.tokenizer.model
        self.newline = self._whole("\n")  # nothing where white space is dropped

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        """One piece of letters: straight to the library's merges."""
        if not self.glued:
            piece = piece.lower()
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        elif piece[0] == " ":
            piece = _BYTE_LETTERS[32] + piece[1:]
        return _packed([t.id for t in self.model.tokenize(piece)])

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CHUNKS:
            self.clear()
            self.tails.clear()
        mark = chunk[:1] if chunk[:1] in (FIRST, "\n") else ""
        line = chunk[len(mark) :]
        space = " " if self.glued and not mark else ""
        m = _PLAIN.fullmatch(line)
        if m is None:
            out = self._whole(space + line)
        elif not m[2]:
            out = self[FIRST + line] if mark == "\n" else self._piece(space + line)
        else:
            after = self.tails.get(m[2])
            if after is None:
                after = self.tails[m[2]] = self._whole(m[2])
            out = self[m[1] if space or not self.glued else FIRST + m[1]] + after
        out = self[chunk] = self.newline + out if mark == "\n" else out
        return out

    def ids(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.batch([text])[0].tobytes()

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text).

        Chunks are told apart by Arrow's dictionary encoding, so each distinct one is looked up once a batch.
        """
        odd = np.flatnonzero(pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD).to_numpy(zero_copy_only=False)).tolist()
        plain = list(texts)
        for i in odd:
            plain[i] = ""
        if self.glued:
            split = pa.array([FIRST + t.replace("\n", " \n") for t in plain], pa.large_string())
        else:
            split = pa.array([t.replace("\n", " ") for t in plain], pa.large_string())
        split = pc.split_pattern(split, " ")
        chunks = split.values.dictionary_encode()
        known = [self[c] for c in chunks.dictionary.to_numpy(zero_copy_only=False).tolist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = chunks.indices.to_numpy()
        length = size[at]
        ids = _gathered(np.frombuffer(b"".join(known), "<u4"), (np.cumsum(size) - size)[at], length)
        upto = np.concatenate([[0], np.cumsum(length)])[split.offsets.to_numpy()]
        if not odd:
            return ids, np.diff(upto)
        parts = [ids[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
        for i in odd:
            parts[i] = np.frombuffer(self._whole(texts[i]), "<u4")
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for all (s, n), one after the other."""
    before = np.cumsum(length) - length
    return flat[np.repeat(start - before, length) + np.arange(int(length.sum()))]


def encoded(frames: Iterator, tokens: Encoder, end_id: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids, lengths) of about ``BATCH`` characters at a time from frames (doc_id, text); each text ends with ``end_id``."""
    doc_ids, texts, held = [], [], 0

    def flush():
        ids, length = tokens.batch(texts)
        at = np.cumsum(length)
        out = doc_ids[:], np.insert(ids, at, end_id).astype("<u4"), length + 1
        doc_ids.clear()
        texts.clear()
        return out

    for frame in frames:
        for doc_id, text in zip(frame["doc_id"].astype(object), frame["text"]):
            doc_ids.append(None if doc_id is None or doc_id != doc_id else int(doc_id))
            texts.append(text if isinstance(text, str) else "")
            held += len(texts[-1])
            if held >= BATCH:
                yield flush()
                held = 0
    if texts:
        yield flush()


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


def encoder(path: str, glued: bool) -> Encoder:
    key = (path, glued)
    if key not in _encoders:
        _encoders[key] = Encoder(path, glued)
    return _encoders[key]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
