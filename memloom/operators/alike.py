"""Exact Jaccard of word sets, block against block: pairs are counted inside tasks and never become rows.

A user's texts are dealt into blocks by letters; a tile is a block of facts and one of memories. A tile's texts are sorted by kind (nearest of some
middles) and size, and few memories at a time meet the facts: those that share enough words with all of them together to reach the fact's k-th best
so far. Shared words are counted by matrix products over frequent words and, where these leave it open, by posting lists over the others. The work still grows with the square of a
user's texts, but what is shuffled grows with the texts times a user's blocks, and memory stays that of a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Letters of a user's texts a block, up to so many blocks, and from there on: blocks keep tasks busy, but each is copied to all others.
LETTERS, BLOCKS, LARGE = 32_000_000, 6, 96_000_000
#: Facts and memories a product, facts times frequent words at most (256 facts at least).
ROWS, COLUMNS, CELLS = 4096, 128, 16_000_000
#: Share of a tile's pairs from which a word's products are cheaper than its postings.
FREQUENT = 0.0012
#: Kinds of texts that a tile is sorted by, memories they are taken from, frequent words they are told by.
KINDS, KIND_ROWS, WORDS = 16, 2048, 512
#: Memories of a fact and block that are taken one by one; room for rounding of counted words, and of sizes.
MANY, SLACK, TIE = 16, 0.05, 1e-6
#: Users are told apart by so many hashes when blocks are counted.
GROUPS = 4096


def _blocks(rows: DataFrame, text: str, most: int, most_rows: int = 1 << 40, few: int = 1 << 30, large: int = 1 << 40) -> Column:
    """How many blocks the row's user has, ``few`` of ``most`` letters or as many as it takes of ``large`` ones: only users of more than one block are brought back, as hashes, one entry a block at most."""
    group = F.pmod(F.xxhash64("user_id"), F.lit(GROUPS)).cast("int")
    blocks = F.ceil(F.greatest(F.least(F.sum(F.length(text)) / most, F.lit(few)), F.sum(F.length(text)) / large, F.count(F.lit(1)) / most_rows))
    many = {r.g: r.n for r in rows.groupBy(group.alias("g")).agg(blocks.alias("n")).where("n > 1").collect()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(int(x)) for kv in many.items() for x in kv]), group), F.lit(1)) if many else F.lit(1)


def nearest(facts: DataFrame, memories: DataFrame, fact: str, text: str, order: str, k: int, least: float) -> DataFrame:
    """(user_id, arrival, ``order``, score): of each of ``facts(user_id, arrival, fact)`` the k memories (user_id, ``order``, ``text``) most like
    it, from ``least`` on; of equal scores, the first by ``order``. Tiles of one user are not merged yet: each gives its own k.

    With ``least`` above 0, texts without words have no row. Words are told apart by 64 bits.
    """
    kind = dict(memories.dtypes)[order]
    hashes = lambda c: F.transform(T.token_set(F.coalesce(F.col(c), F.lit(""))), lambda w: F.xxhash64(w))
    n_new, n_old = _blocks(facts, fact, LETTERS, few=BLOCKS, large=LARGE), _blocks(memories, text, LETTERS, few=BLOCKS, large=LARGE)
    facts, memories = facts.where("user_id IS NOT NULL"), memories.where("user_id IS NOT NULL")
    new = facts.select("user_id", F.col("arrival").cast("long").alias("arrival"), hashes(fact).alias("w"), n_new.alias("n"), n_old.alias("m"))
    old = memories.select("user_id", order, hashes(text).alias("w"), n_new.alias("n"), n_old.alias("m"))
    if least > 0:
        new, old = new.where("size(w) > 0"), old.where("size(w) > 0")
    own, other = (lambda n: F.pmod(F.xxhash64("w"), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    new = new.select("user_id", "arrival", "w", own(F.col("n")).alias("i"), other(F.col("m")).alias("j"))
    old = old.select(F.col("user_id").alias("u"), order, "w", own(F.col("m")).alias("q"), other(F.col("n")).alias("p"))

    def run(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            i, j, score = [], [], []
        else:
            i, j, score = tile(left.column("w"), right.column("w"), right.column(order), k, least)
        out = left.select(["user_id", "arrival"]).take(pa.array(i, pa.int64()))
        return out.append_column(order, right.column(order).take(pa.array(j, pa.int64()))).append_column("score", pa.array(score, pa.float64()))

    user = dict(facts.dtypes)["user_id"]
    return new.groupBy("user_id", "i", "j").cogroup(old.groupBy("u", "p", "q")).applyInArrow(run, f"user_id {user}, arrival long, {order} {kind}, score double")


def _sets(column):
    """Offsets and hashes of a column of lists, and two numbers that tell its sets apart."""
    import numpy as np

    lists = [c for c in column.chunks if len(c)]
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in lists])
    h = np.concatenate([c.flatten().to_numpy() for c in lists]).astype(np.int64).view(np.uint64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    sums = []
    for x in (h, mixed ^ (mixed >> np.uint64(29))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        sums.append(total[at[1:]] - total[at[:-1]])
    return at, h, np.stack([*sums, sizes.astype(np.uint64)], 1)


def _spread(at, rows):
    """Places of the items of some lists, and which of the rows each belongs to."""
    import numpy as np

    n = at[rows + 1] - at[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(at[rows], n), owner


def tile(new, old, order, k: int, least: float):
    """Places of facts and memories, and scores, of the k best of each fact; of memories of the same words only the first for k = 1."""
    import numpy as np
    import pyarrow.compute as pc

    at_n, h_n, key_n = _sets(new)
    at_o, h_o, key_o = _sets(old)
    rank = np.empty(len(key_o), np.int64)
    rank[pc.sort_indices(order).to_numpy()] = np.arange(len(key_o))
    _, one, copy = np.unique(key_n, axis=0, return_index=True, return_inverse=True)
    copy = copy.ravel()
    some = np.argsort(rank)
    if k == 1:
        some = some[np.unique(key_o[some], axis=0, return_index=True)[1]]
    size_n, size_o = np.diff(at_n), np.diff(at_o)

    vocabulary = np.intersect1d(np.unique(h_n), np.unique(h_o), assume_unique=True)

    def known(at, h):
        """Lists of the words that both sides have, as numbers."""
        if not len(vocabulary):
            return np.zeros(len(at), np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[place] == h
        return np.concatenate([[0], np.cumsum(hit)])[at], place[hit]

    at_n, w_n = known(at_n, h_n)
    at_o, w_o = known(at_o, h_o)
    count = lambda at, w, rows: np.bincount(w[_spread(at, rows)[0]], minlength=len(vocabulary))
    share = count(at_n, w_n, one) / len(one) * (count(at_o, w_o, some) / len(some))
    frequent = np.flatnonzero(share >= FREQUENT)
    frequent = frequent[np.argsort(-share[frequent], kind="stable")]
    column = np.full(len(vocabulary), -1)
    column[frequent] = np.arange(len(frequent))

    def matrix(at, w, rows, n=len(frequent)):
        """The n most frequent words of the rows as 0 and 1."""
        place, owner = _spread(at, rows)
        c = column[w[place]]
        inside = (c >= 0) & (c < n)
        m = np.zeros((len(rows), n), np.float32)
        m[owner[inside], c[inside]] = 1
        return m

    # facts and memories by kind and size, so that small blocks of memories lack most words of facts of other kinds
    kind_n, kind_o = _kinds(lambda at, w, rows: matrix(at, w, rows, min(WORDS, len(frequent))), (at_n, w_n, one), (at_o, w_o, some))
    heads = np.lexsort((size_n[one], kind_n))
    by = np.lexsort((size_o[some], kind_o))
    some, kind_o = some[by], kind_o[by]
    blocks, present = [], np.zeros((len(vocabulary), -(-len(some) // COLUMNS)), np.uint8)
    for b in range(0, len(some), COLUMNS):
        cols = some[b : b + COLUMNS]
        cols = cols[np.argsort(rank[cols])]
        place, owner = _spread(at_o, cols)
        w = w_o[place]
        present[w, len(blocks)] = 1
        w, owner = w[column[w] < 0], owner[column[w] < 0]
        by = np.argsort(w, kind="stable")
        rare, first = np.unique(w[by], return_index=True)
        blocks.append((cols, size_o[cols].min(), size_o[cols].max(), np.median(kind_o[b : b + COLUMNS]), rare, np.append(first, len(w)), owner[by].astype(np.int32)))

    best, chosen = np.full((len(one), k), -1.0), np.zeros((len(one), k), np.int64)
    height = int(np.clip(CELLS // max(len(frequent), 1), 256, ROWS))
    place_of = np.full(len(vocabulary), -1, np.int32)
    edges = np.searchsorted(kind_n[heads], np.arange(KINDS + 1))
    for a, b in ((a, min(a + height, end)) for begin, end in zip(edges[:-1], edges[1:]) for a in range(begin, end, height)):
        block = heads[a:b]
        left, size, middle, its_kind = matrix(at_n, w_n, one[block]), size_n[one[block]], np.median(size_n[one[block]]), kind_n[block[0]]
        place, owner = _spread(at_n, one[block])
        is_rare = column[w_n[place]] < 0

        def held(words, owner):
            """How many of each row's words each block of memories has."""
            out, begin = np.zeros((len(block), len(blocks)), np.int32), np.searchsorted(owner, np.arange(len(block) + 1))
            for x in range(0, len(block), 64):
                y = min(x + 64, len(block))
                filled = np.flatnonzero(np.diff(begin[x : y + 1])) + x
                if len(filled):
                    out[filled] = np.add.reduceat(present[words[begin[x] : begin[y]]], begin[filled] - begin[x], axis=0, dtype=np.int32)
            return out, begin

        words = w_n[place[is_rare]]
        held_rare, begin_rare = held(words, owner[is_rare])
        held_all = held(w_n[place[~is_rare]], owner[~is_rare])[0] + held_rare
        for at in sorted(range(len(blocks)), key=lambda n: (blocks[n][3] != its_kind, abs(blocks[n][1] + blocks[n][2] - 2 * middle))):
            cols, least_size, most_size, _, rare, first, post_col = blocks[at]
            # rows whose words that the block has could still give a score as good as their last
            most = np.minimum(held_all[:, at], most_size)
            bar = np.maximum(best[block, k - 1], least)
            rows = np.flatnonzero(most + TIE >= bar * (size + np.maximum(least_size - most, 0)))
            if not len(rows):
                continue
            if len(rows) > 0.8 * len(block):
                rows = np.arange(len(block))
            all_rows, bar, own = len(rows) == len(block), bar[rows], size[rows]
            # a score is at least the bar where the words shared are at least this share of both sizes
            part = bar / (1 + bar)
            over = (left if all_rows else left[rows]) @ matrix(at_o, w_o, cols).T
            over += (SLACK - part * own)[:, None].astype(np.float32) - part[:, None].astype(np.float32) * size_o[cols][None, :].astype(np.float32)
            # rows whose rare words that the block has could lift a pair to the bar
            lift = np.flatnonzero(over.max(1) + held_rare[rows, at] >= 0)
            place, owner = _spread(begin_rare, rows[lift])
            place_of[rare] = np.arange(len(rare))
            w = place_of[words[place]]
            place_of[rare] = -1
            w, owner = w[w >= 0], lift[owner[w >= 0]]
            if len(w):
                n = first[w + 1] - first[w]
                cell = np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = np.repeat(owner * len(cols), n) + post_col[cell]
                over += np.bincount(cell, minlength=over.size).reshape(over.shape)
            good = over >= 0
            many = good.sum(1) > MANY
            r, c = np.nonzero(good & ~many[:, None])
            both = own[r] + size_o[cols[c]]
            shared = np.rint(over[r, c] + part[r] * both - SLACK)
            found = [(r, c, shared / np.maximum(both - shared, 1))]
            many = np.flatnonzero(many)
            if len(many):
                both = own[many][:, None] + size_o[cols][None, :]
                shared = np.rint(over[many] + part[many][:, None] * both - SLACK)
                score = shared / np.maximum(both - shared, 1)
                each = np.arange(len(many))
                for _ in range(min(k, len(cols))):
                    top = score.argmax(1)
                    found.append((many, top, score[each, top]))
                    score[each, top] = -1
            r, c, score = (np.concatenate(x) for x in zip(*found))
            fits = score >= np.maximum(bar[r], 0)
            r, c, score = r[fits], c[fits], score[fits]
            if not len(r):
                continue
            # the k best of what was known and what was found
            touched = np.unique(r)
            known_rows = block[rows[touched]]
            r = np.concatenate([np.repeat(touched, k), r])
            memory, score = np.concatenate([chosen[known_rows].ravel(), cols[c]]), np.concatenate([best[known_rows].ravel(), score])
            by = np.lexsort((rank[memory], -score, r))
            keep = (np.searchsorted(r[by], touched)[:, None] + np.arange(k)).ravel()
            best[known_rows], chosen[known_rows] = score[by][keep].reshape(-1, k), memory[by][keep].reshape(-1, k)
    head, at = np.nonzero(best >= max(least, 0))
    memory, score = chosen[head, at], best[head, at]
    start = np.searchsorted(head, np.arange(len(one) + 1))
    which, fact = _spread(start, copy)
    return fact, memory[which], score[which]


def _kinds(matrix, *sides):
    """For the rows of each side the number of the middle that is nearest by frequent words; the middles are those of a part of the last side."""
    import numpy as np

    at, w, rows = sides[-1]
    x = matrix(at, w, rows[:: len(rows) // KIND_ROWS + 1])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    x = unit(x)
    middles = x[:: len(x) // KINDS + 1]
    for _ in range(8):
        near = (x @ middles.T).argmax(1)
        middles = unit(np.stack([x[near == m].sum(0) if (near == m).any() else middles[m] for m in range(len(middles))]))
    return [np.concatenate([(matrix(at, w, rows[a : a + ROWS]) @ middles.T).argmax(1) for a in range(0, len(rows), ROWS)]) for at, w, rows in sides]
