"""Exact sequence ratios (difflib's) of cleaned texts, block against block: pairs are told apart inside tasks and never become rows.

In a text of 200 letters or more difflib starts matches only at its rare letters (those up to its hundredth part and one) and then
lengthens them, or at the start of both texts. So there are at most as many matches as rare letters and one, and of a match of n letters all
n - q + 1 runs of q letters are in both texts: the letters matched are at most the runs shared and q - 1 a match. Runs are counted through
posting lists, without the most frequent ones of a memory, which count as shared; pairs that are left are bounded by all their runs. For shorter memories, and such as have too many rare letters, the letters and their longest common subsequence bound the ratio.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import lru_cache
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from .alike import _blocks, _spread

#: What cleaned texts are made of.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789'\\ "
#: Lengths of runs that are tried, the longest first, and the share of a memory's letters that runs must be left to account for.
RUNS, LEFT = (11, 8, 5), 0.15
#: Bits of a run's hash at most (runs of one hash count as shared, so bounds hold); factors of the hash.
BITS, MIX = 24, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
#: Share of the runs a pair must have in common that may be left out as frequent, and grades of frequency, four to a doubling.
SPARE, GRADES = 0.75, 96
#: Letters and rows of a block; letters and rows of memories, letters of facts, shared runs and pairs that are held at once.
BLOCK, BLOCK_ROWS, HELD, HELD_ROWS, ASKED, HITS, PAIRS = 24_000_000, 16_384, 12_000_000, 8192, 4_000_000, 4_000_000, 1_000_000
#: From this length difflib leaves frequent letters out.
LONG = 200
#: Room for rounding.
TIE = 1e-9


def best_by_ratio(facts: DataFrame, memories: DataFrame, least: float) -> DataFrame:
    """(user_id, new, pos, score): of each of ``facts(user_id, new, fact, floor)`` the memory (user_id, pos, text) of the largest ratio, from
    ``floor`` (at least ``least``) on; of equal ones, the first. Tiles of one user are not merged yet. Facts of floor 1 are not asked."""
    n_new, n_old = (_blocks(rows, text, BLOCK, BLOCK_ROWS) for rows, text in ((facts, "fact"), (memories, "text")))
    own, other = (lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    new = facts.where(F.col("floor") < 1).select("user_id", "new", "fact", "floor", own("fact", n_new).alias("i"), other(n_old).alias("j"))
    old = memories.select(F.col("user_id").alias("u"), "pos", "text", own("text", n_old).alias("q"), other(n_new).alias("p"))

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        i, j, score = [], [], []
        if left.num_rows and right.num_rows:
            i, j, score = tile(left.column("fact"), left.column("floor").to_numpy(), right.column("text"), np.asarray(right.column("pos").to_numpy()), least)
        out = left.select(["user_id", "new"]).take(pa.array(i, pa.int64()))
        return out.append_column("pos", right.column("pos").take(pa.array(j, pa.int64()))).append_column("score", pa.array(score, pa.float64()))

    user = dict(facts.dtypes)["user_id"]
    return new.groupBy("user_id", "i", "j").cogroup(old.groupBy("u", "p", "q")).applyInArrow(run, f"user_id {user}, new string, pos long, score double")


class _Texts:
    """Texts as numbers of letters (from 1), where each begins, and how often each has which letter."""

    def __init__(self, column):
        import numpy as np
        import pyarrow as pa

        chunk = pa.chunked_array(column).cast(pa.large_string()).combine_chunks()
        chunk = pa.concat_arrays(chunk.chunks) if isinstance(chunk, pa.ChunkedArray) else chunk
        offsets = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        number = np.zeros(256, np.uint8)
        number[list(LETTERS.encode())] = np.arange(1, len(LETTERS) + 1)
        self.column, self.at, self.letters = chunk, offsets - offsets[0], number[data]
        self.size = np.diff(self.at)
        self.counts = np.zeros((len(self.size), len(LETTERS) + 1), np.int32)
        for a in range(0, len(self.size), HELD_ROWS):
            place, owner = _spread(self.at, np.arange(a, min(a + HELD_ROWS, len(self.size))))
            n = len(self.size[a : a + HELD_ROWS])
            self.counts[a : a + n] = np.bincount(owner * (len(LETTERS) + 1) + self.letters[place], minlength=n * (len(LETTERS) + 1)).reshape(n, -1)

    def text(self, i: int) -> str:
        return self.column[int(self.row[i])].as_py()

    def put(self, by):
        """The texts in another order; ``row`` tells where they were."""
        import numpy as np

        self.letters, self.size, self.counts, self.row = self.letters[_spread(self.at, by)[0]], self.size[by], self.counts[by], by
        self.at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size)])

    def runs(self, a: int, b: int, q: int, bits: int):
        """Of the runs of q letters of texts a to b the number of each (so many bits of a hash) and which text it is of, from 0."""
        import numpy as np

        h, have = self.letters[self.at[a] : self.at[b]].astype(np.uint32), 1
        n = len(h) - q + 1
        if n <= 0:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        while 2 * have <= q:
            h = h[:-have] * MIX[0] + (h[have:] ^ (h[have:] >> np.uint32(15))) * MIX[1]
            have *= 2
        h = (h[:n] * MIX[2] + (h[q - have :][:n] ^ (h[q - have :][:n] >> np.uint32(13)))) * MIX[3]
        run = ((h ^ (h >> np.uint32(16))) * MIX[1] >> np.uint32(32 - bits)).astype(np.int32)
        owner = np.repeat(np.arange(b - a, dtype=np.int32), self.size[a:b])
        inside = owner[:n] == owner[q - 1 :]
        return run[inside], owner[:n][inside]


def _counted(run, owner, n: int):
    """(run, owner, how often), by run and then by owner below n."""
    import numpy as np

    key = np.sort(run.astype(np.int64) * n + owner)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] // n, key[first] % n, np.diff(np.append(first, len(key)))


def _slices(sizes, most: int, rows: int):
    """Ranges of neighbours that hold at most so many letters and rows, one row at least."""
    import numpy as np

    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        before = ends[a - 1] if a else 0
        b = min(max(int(np.searchsorted(ends, before + most, "right")), a + 1), a + rows)
        yield a, b
        a = b


def _index(o: _Texts, a: int, b: int, q: int, bits: int, often, spare):
    """Postings of the runs of memories a to b: (where each run's begin, memory, how often), and how many runs of each memory are left out.

    ``often`` counts the facts' runs. The most frequent of a memory's runs cost most and tell least; they are left out, up to ``spare``.
    """
    import numpy as np

    run, owner = o.runs(a, b, q, bits)
    seen = often[run]
    run, owner, seen = run[seen > 0], owner[seen > 0], seen[seen > 0]
    grade = np.minimum((np.log2(seen.astype(np.float32)) * 4).astype(np.int32), GRADES - 1)
    from_top = np.cumsum(np.bincount(owner * GRADES + grade, minlength=(b - a) * GRADES).reshape(b - a, GRADES)[:, ::-1], 1)
    cut = (from_top <= spare[:, None]).sum(1)
    left_out = np.where(cut > 0, from_top[np.arange(b - a), cut - 1], 0)
    kept = grade < (GRADES - cut)[owner]
    run, owner, times = _counted(run[kept], owner[kept], b - a)
    first = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount(run, minlength=1 << bits), out=first[1:])
    return first, owner, times, left_out


def _shared(x, y) -> int:
    """How many runs two texts share, each as often as in both."""
    import numpy as np

    (x, n), (y, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.minimum(n, m[at])[y[at] == x].sum())


def tile(new, floor, old, pos, least: float):
    """Places of facts and memories, and ratios, of the best memory of each fact that reaches its floor; of equal ratios, that of the smallest pos."""
    import numpy as np

    f, o = _Texts(new), _Texts(old)
    reach = least / (2 - least)
    rare = np.where(o.counts <= (o.size // 100 + 1)[:, None], o.counts, 0)
    kind = np.zeros(len(o.size), np.int64)
    for q in reversed(RUNS):
        kind[(o.size >= LONG) & (o.size * reach - (q - 1) * (rare.sum(1) + 1) >= o.size * LEFT)] = q
    order = np.lexsort((o.size, -kind))
    o.put(order[o.size[order] > 0])
    order = np.argsort(f.size, kind="stable")
    f.put(order[f.size[order] > 0])
    kind, rare, pos, best, found = kind[o.row], rare[o.row], np.asarray(pos)[o.row], np.maximum(floor, least)[f.row], {}
    if not len(f.size) or not len(o.size):
        return [], [], []
    matches = rare.sum(1) + 1
    bits = int(np.clip(np.ceil(np.log2(4 * max(len(f.letters), len(o.letters)))), 10, BITS))

    def compare(i, js, bounds, q):
        """Take the memories ``js`` of fact ``i``, those of the highest bounds first, until none can be as good as the best."""
        a, runs = f.text(i), f.runs(i, i + 1, q, BITS)[0] if q else None
        for k in np.argsort(-bounds, kind="stable"):
            if bounds[k] < best[i] - TIE:
                break
            j = js[k]
            b = o.text(j)
            need = math.ceil(best[i] * (len(a) + len(b)) / 2 - TIE)
            if q:
                most = (q - 1) * (int(np.minimum(f.counts[i], rare[j])[rare[j] > 0].sum()) + 1)
                if most < need and most + _shared(runs, o.runs(j, j + 1, q, BITS)[0]) < need:
                    continue
            elif udfs.common_letters(a, b, need) < need:
                continue
            score = ratio_from(a, b, need)
            if score >= best[i] and (score, -pos[j]) > found.get(i, (0.0, 0, 0))[:2]:
                best[i], found[i] = score, (score, -pos[j], j)

    for q in sorted(set(kind.tolist()), reverse=True):
        mine = np.flatnonzero(kind == q)
        for a, b in _slices(o.size[mine], HELD, HELD_ROWS):
            a, b = a + mine[0], b + mine[0]
            low, high = np.searchsorted(f.size, reach * o.size[a] - TIE), np.searchsorted(f.size, o.size[b - 1] / reach + TIE, "right")
            asked = [(x + low, y + low) for x, y in _slices(f.size[low:high], ASKED, HELD_ROWS)]
            if not q:
                for i in range(low, high):
                    fits = np.minimum(f.counts[i], o.counts[a:b]).sum(1) * 2 / (f.size[i] + o.size[a:b])
                    at = np.flatnonzero(fits >= best[i] - TIE)
                    if len(at):
                        compare(i, a + at, fits[at], q)
                continue
            often = np.zeros(1 << bits, np.int32)
            for x, y in _slices(f.size[low:high], HELD, HELD_ROWS):
                often += np.bincount(f.runs(x + low, y + low, q, bits)[0], minlength=1 << bits).astype(np.int32)
            first, owner, times, left_out = _index(o, a, b, q, bits, often, (o.size[a:b] * reach - (q - 1) * matches[a:b]) * SPARE)
            free = left_out + (q - 1) * matches[a:b]
            lowest = o.size[a:b] * reach - free - TIE
            for x, y in asked:
                run, who = f.runs(x, y, q, bits)
                known = first[run + 1] > first[run]
                who, run, many = _counted(who[known], run[known], 1 << bits)
                begin = np.searchsorted(who, np.arange(y - x + 1))
                work = np.concatenate([[0], np.cumsum(first[run + 1] - first[run], dtype=np.int64)])[begin]
                for u, v in _slices(np.diff(work), HITS, max(PAIRS // (b - a), 1)):
                    part = slice(begin[u], begin[v])
                    at, which = _spread(first, run[part])
                    cell = (who[part][which] - u) * (b - a) + owner[at]
                    shared = np.bincount(cell, np.minimum(many[part][which], times[at]), (v - u) * (b - a)).reshape(v - u, b - a)
                    r, j = np.nonzero(shared >= lowest)
                    i = x + u + r
                    both = f.size[i] + o.size[a + j]
                    most = np.minimum(shared[r, j] + free[j], np.minimum(f.counts[i], o.counts[a + j]).sum(1)) * 2 / both
                    good = np.flatnonzero(most >= best[i] - TIE)
                    i, j, most = i[good], j[good], most[good]
                    ends = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
                    for s, e in zip(ends[:-1], ends[1:]):
                        compare(i[s], a + j[s:e], most[s:e], q)
    return [f.row[i] for i in found], [o.row[j] for _, _, j in found.values()], [s for s, _, _ in found.values()]


@lru_cache(256)
def _rare_places(text: str):
    """Places of each letter that difflib may begin a match at."""
    import numpy as np

    letters = np.frombuffer(text.encode("ascii"), np.uint8)
    n = np.bincount(letters, minlength=256)
    return {int(c): np.flatnonzero(letters == c) for c in np.flatnonzero((n > 0) & (n <= len(text) // 100 + 1))}


def _matches(a: str, b: str):
    """Where the longest runs of rare letters that a and b share begin in both, and their lengths; None if there are too many to hold."""
    import numpy as np

    letters = np.frombuffer(a.encode("ascii"), np.uint8)
    both = [(np.flatnonzero(letters == c), y) for c, y in _rare_places(b).items()]
    if sum(len(x) * len(y) for x, y in both) > HITS:
        return None
    at = np.sort(np.concatenate([np.zeros(0, np.int64), *[((y[None, :] - x[:, None] + len(a)) * (len(a) + 1) + x[:, None]).ravel() for x, y in both]]))
    begin = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    x = at[begin] % (len(a) + 1)
    return x, at[begin] // (len(a) + 1) - len(a) + x, np.diff(np.append(begin, len(at)))


def ratio_from(a: str, b: str, need: int = 0) -> float:
    """difflib's ratio of a against b; 0 once fewer than ``need`` letters can match."""
    import numpy as np

    if a == b:
        return 1.0
    runs = _matches(a, b) if len(b) >= LONG else None
    if runs is None:
        return SequenceMatcher(None, a, b).ratio()
    total, most = 0, min(len(a), len(b))
    ranges = [(-most, 0, len(a), 0, len(b), runs)]
    while ranges:
        n, alo, ahi, blo, bhi, (x, y, long) = heappop(ranges)
        i, j, size = alo, blo, 0
        if len(x):
            skip = np.maximum(np.maximum(alo - x, blo - y), 0)
            x, y = x + skip, y + skip
            long = np.minimum(np.minimum(long - skip, ahi - x), bhi - y)
            inside = long > 0
            x, y, long = x[inside], y[inside], long[inside]
        if len(x):
            size = int(long.max())
            first = np.flatnonzero(long == size)
            first = first[x[first] == x[first].min()]
            k = first[y[first].argmin()]
            i, j = int(x[k]), int(y[k])
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        total, most = total + size, most + n + size
        rest = ((alo, i, blo, j, (x < i) & (y < j)), (i + size, ahi, j + size, bhi, (x + long > i + size) & (y + long > j + size))) if size else ()
        for a0, a1, b0, b1, keep in rest:
            n = min(a1 - a0, b1 - b0)
            if n > 0 and (keep.any() or a[a0] == b[b0]):
                most += n
                heappush(ranges, (-n, a0, a1, b0, b1, (x[keep], y[keep], long[keep])))
        if most < need:
            return 0.0
    return 2.0 * total / (len(a) + len(b))
