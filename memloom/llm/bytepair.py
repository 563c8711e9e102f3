"""Op 13. Byte-level BPE: pre-tokenisation as a scan of transition functions, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import binaries, byte_sizes, code_points, gathered, whole_texts
from .common import prepare
from .tokens import vocabulary

# What a character is to the automaton. Space before something else than white space goes with what follows, other white
# space there stands alone, and white space before white space or the end of the text hangs together.
BREAK, LETTER, NUMBER, SIGN, ONE, TWO, GLUE, ALONE, BLANK = range(9)
# What the piece in progress is: CLOSED takes nothing more, MORE and MOST still want one or two letters of a contraction.
CLOSED, LETTERS, NUMBERS, SIGNS, BLANKS, GLUED, MORE, MOST = range(8)
#: What may follow an apostrophe: one letter, or two. Fixed values of the vocabulary's pattern.
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Columns of the two-level scan.
WIDTH = 1024
#: Bytes from which a piece is merged through a heap, and pieces that a worker remembers.
HEAP, PIECES = 64, 1_000_000


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(the piece in progress after the character, whether a piece starts at it)."""
    if symbol == LETTER:
        if state in (MORE, MOST):
            return (MORE if state == MOST else CLOSED), False
        return LETTERS, state not in (LETTERS, GLUED)
    if symbol == NUMBER:
        return NUMBERS, state not in (NUMBERS, GLUED)
    if symbol in (SIGN, ONE, TWO):
        if state in (SIGNS, GLUED):
            return SIGNS, False
        return {SIGN: SIGNS, ONE: MORE, TWO: MOST}[symbol], True
    if symbol == BLANK:
        return BLANKS, state != BLANKS
    return (GLUED if symbol == GLUE else CLOSED), True


_STEPS = [[_step(s, c) for c in range(9)] for s in range(8)]
NEXT = np.array([[n for n, _ in row] for row in _STEPS], np.uint8)
STARTS = np.array([[b for _, b in row] for row in _STEPS], bool)

_classes: np.ndarray | None = None
_vocabularies: dict[str, "Vocabulary"] = {}


def classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK or SIGN of every code point, as the tiktoken library's own tables have it."""
    global _classes
    if _classes is None:
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, SIGN, np.uint8)
        single = {bytes([i]): i for i in range(256)}
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
            probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            table[code_points(bytes(probe.encode_ordinary(every)).decode())] = kind
        _classes = table
    return _classes


def symbols(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The automaton's symbols of code points; ``breaks`` are places that belong to no text."""
    out = classes()[points]
    out[breaks] = BREAK
    after = np.append(out[1:], np.uint8(BREAK))
    solid = (out == BLANK) & (after != BLANK) & (after != BREAK)
    at = np.flatnonzero((points == 39) & (out == SIGN))
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        out[at[np.isin(one, [ord(c) for c in SHORT])]] = ONE
        out[at[np.any([(one == ord(a)) & (two == ord(b)) for a, b in LONG], axis=0)]] = TWO
    out[solid] = np.where(points[solid] == 32, GLUE, ALONE)
    return out


def states_before(symbol: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The automaton's state before each symbol, starting CLOSED.

    Every symbol is a function from state to state and composing functions is associative: rows of ``width`` symbols are
    composed side by side, the rows' functions by doubling, and each row is then walked from its own first state.
    """
    n, (kinds, letters) = len(symbol), NEXT.shape
    rows = max(1, -(-n // width))
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, width).T).astype(np.intp)
    flat = NEXT.ravel()
    upto = np.tile(np.arange(kinds, dtype=np.uint8)[:, None], (1, rows))
    for column in grid:
        upto = flat[upto * np.intp(letters) + column]
    step = 1
    while step < rows:  # upto[:, r] becomes the composition of rows 0..r
        later = np.take_along_axis(upto[:, step:], upto[:, :-step].astype(np.intp), axis=0)
        upto = np.concatenate([upto[:, :step], later], axis=1)
        step *= 2
    state = np.concatenate([[CLOSED], upto[CLOSED, :-1]]).astype(np.uint8)
    before = np.empty((width, rows), np.uint8)
    for i, column in enumerate(grid):
        before[i] = state
        state = flat[state * np.intp(letters) + column]
    return before.T.ravel()[:n]


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, each followed by a byte that isn't its own; starts of pieces; which pieces are texts' own)."""
    joined = "".join(t + "\0" for t in texts)
    points = code_points(joined)
    breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
    symbol = symbols(points, breaks)
    first = np.flatnonzero(STARTS[states_before(symbol), symbol])
    size = byte_sizes(points)
    return joined.encode("utf-8", "surrogatepass"), (np.cumsum(size) - size)[first], symbol[first] != BREAK


class Vocabulary(dict):
    """Ids (packed, little-endian) by piece; filled by merging pairs of lowest rank, leftmost first."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) > PIECES:
            self.clear()
        known = self.ranks.get(piece)
        ids = [known] if known is not None else self.merged(piece) if len(piece) < HEAP else self.merged_by_heap(piece)
        out = self[piece] = np.array(ids, "<u4").tobytes()
        return out

    def merged(self, piece: bytes) -> list[int]:
        none, rank = len(self.size), self.ranks.get
        cut = list(range(len(piece) + 1))
        pair = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pair:
            low = min(pair)
            if low == none:
                break
            i = pair.index(low)
            del cut[i + 1], pair[i]
            if i < len(pair):
                pair[i] = rank(piece[cut[i] : cut[i + 2]], none)
            if i:
                pair[i - 1] = rank(piece[cut[i - 1] : cut[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(cut, cut[1:])]

    def merged_by_heap(self, piece: bytes) -> list[int]:
        """The same in n log n; an entry counts only while both of its parts still stand."""
        n, rank = len(piece), self.ranks.get
        after, before = list(range(1, n + 1)) + [n], list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = after[i]
            if not alive[i] or middle >= n or after[middle] != end:
                continue
            alive[middle], after[i] = 0, end
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            p = before[i]
            if p >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if not texts:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        raw, start, own = slices(texts)
        ends = np.append(start, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        known = [self[p] for p in pieces.dictionary.to_pylist()]
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        at = pieces.indices.to_numpy()
        length = np.where(own, size[at], 0)
        ids = gathered(np.frombuffer(b"".join(known), "<u4"), (np.cumsum(size) - size)[at], length)
        return ids, np.diff(np.concatenate([[0], np.cumsum(length)[~own]]))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids."""
        return gathered(self.flat, self.start[ids], self.size[ids])


def known_vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _ends(size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where each token ends in its own text."""
    upto = np.cumsum(size)
    before = np.concatenate([[0], upto])[np.cumsum(count) - count]
    return upto - np.repeat(before, count)


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids and ends per row of ``docs``: whole texts as token ids, with the byte at which each token ends.

    ids and ends are little-endian unsigned 32-bit integers. Ids are the tiktoken library's for this vocabulary and
    pattern, without special tokens: their strings are plain text. Texts of a batch are one array of code points, which
    an automaton cuts (``states_before``); distinct pieces are merged once and remembered by the worker. Null text
    counts as empty and gives no tokens; a null doc_id stays null; repeated rows and ids are encoded one by one; other columns are
    ignored; an empty table gives an empty one. A text may have up to 2 GiB of ids.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_vocabulary(vocabulary_path)
        for rows, texts in whole_texts(batches):
            ids, count = words.encode(texts)
            ends = _ends(words.size[ids], count).astype("<u4")
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(count), binaries(ids, count), binaries(ends, count)], names=["doc_id", "n_tokens", "ids", "ends"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ends binary")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """``encoded`` (rows of ``encode``) with the column decoded: the bytes its ids stand for.

    Every token's bytes must end where the encoder saw it end, else the ids aren't this vocabulary's: ValueError. Null
    ids or ends give null.
    """
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_vocabulary(vocabulary_path)
        for batch in batches:
            ids, ends = (batch.column(c).to_pylist() for c in ("ids", "ends"))
            out = []
            for some, at in zip(ids, ends):
                if some is None or at is None:
                    out.append(None)
                    continue
                some, at = np.frombuffer(some, "<u4"), np.frombuffer(at, "<u4")
                if len(some) != len(at) or (len(some) and some.max() >= len(words.size)) or not np.array_equal(np.cumsum(words.size[some]), at):
                    raise ValueError("token ids and offsets disagree")
                out.append(words.decode(some).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ends binary, decoded binary")


def round_trips(docs: DataFrame, vocabulary_name: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Digest of encoding and decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary(vocabulary_name)
    return decode(encode(docs, path), path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
