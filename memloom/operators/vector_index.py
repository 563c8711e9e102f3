"""Inverted-file vector index: exact nearest neighbours per user without comparing all vectors.

A user's vectors are dealt to cells around pivots from a bounded sample; each entry keeps its angle to its pivot.
By the triangle inequality for angles, a question at angle t to a pivot can't come nearer than |t - a| to an entry at angle a, so once k
neighbours are known, cells beyond the k-th are left out and the result still equals brute force. Users are dealt to tiles, many
small ones to one and a large one to several; vectors meet there as matrix products, and only the k nearest of a tile become rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpointed, importable

#: Most pivots of a user; questions or vectors to be dealt to cells, and entries, of a tile; pairs that are held at once.
CELLS, ASKED, ENTRIES, HELD = 1024, 4096, 16384, 4_000_000
#: Users that have at most so many entries are compared with all of them.
FEW = 64
#: Most groups that users are dealt to by hashes, and vectors that a group is to have.
GROUPS, GROUP = 4096, 2048
#: Room for rounding: of angles, and of cosines that count as equal.
ANGLE, TIE = 1e-7, 2e-9
SPACE = ["user_id", "dim"]


def _meet(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner", also: Column | None = None) -> DataFrame:
    """``a`` joined with ``b`` on equal columns, where null equals null: null users are one user."""
    b = b.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in b.columns if c not in on])
    match = F.lit(True) if also is None else also
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return a.join(b, match, how).drop(*[f"_{c}" for c in on])


def unit_vectors(rows: DataFrame, key: str) -> DataFrame:
    """user_id, dim, ``key`` and the unit vector of rows that have one: null, empty, zero or non-finite embeddings have none."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = rows.select("user_id", key, e.alias("e")).where(F.col("e").isNotNull() & ~bad)
    # scaled first, so that squares neither overflow nor vanish
    most = F.array_max(F.transform("e", F.abs))
    rows = rows.withColumn("most", most).where("most > 0").withColumn("e", F.transform("e", lambda x: x / F.col("most")))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("norm", norm).select("user_id", F.size("e").alias("dim"), key, F.transform("e", lambda x: x / F.col("norm")).alias("v"))


def _tiles(left: DataFrame, right: DataFrame, by: tuple[str, str], run, schema: str, split: bool = True) -> DataFrame:
    """``run`` of tiles: rows of some users on the left and on the right, of a user of many rows a block of each (the right whole unless ``split``). ``by`` deals rows to blocks."""
    groups = max(1, min(GROUPS, -(-max(left.count(), right.count()) // GROUP)))
    group = F.pmod(F.xxhash64(*SPACE), F.lit(groups)).cast("int")

    def blocks(rows: DataFrame, most: int) -> Column:
        # one number for each group of more than one block is brought back
        n = rows.groupBy(group.alias("g")).agg(F.ceil(F.count(F.lit(1)) / most).alias("n")).where("n > 1")
        many = [F.lit(int(x)) for r in n.collect() for x in (r.g, r.n)]
        return F.coalesce(F.try_element_at(F.create_map(*many), group), F.lit(1)) if many else F.lit(1)

    n_left, n_right = blocks(left, ASKED), blocks(right, ENTRIES) if split else F.lit(1)
    own, other = (lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    new = left.select("*", group.alias("g"), own(by[0], n_left).alias("i"), other(n_right).alias("j"))
    old = right.select("*", group.alias("h"), own(by[1], n_right).alias("q"), other(n_left).alias("p"))
    return new.groupBy("g", "i", "j").cogroup(old.groupBy("h", "p", "q")).applyInArrow(run, schema)


def _users(left, right):
    """Both tables sorted by user and dim, and for those that are in both: dim and their ranges in the one and the other."""
    import numpy as np
    import pyarrow as pa

    names = pa.chunked_array([*left.column("user_id").chunks, *right.column("user_id").chunks], left.schema.field("user_id").type)
    number = names.combine_chunks().dictionary_encode(null_encoding="encode")
    number = np.concatenate([c.indices.to_numpy() for c in (number.chunks if isinstance(number, pa.ChunkedArray) else [number])]).astype(np.int64)
    dim = np.concatenate([left.column("dim").to_numpy(), right.column("dim").to_numpy()]).astype(np.int64)
    code = number * (dim.max() + 1) + dim
    sides = []
    for rows, c in ((left, code[: left.num_rows]), (right, code[left.num_rows :])):
        order = np.argsort(c, kind="stable")
        sides.append((rows.take(pa.array(order)), *np.unique(c[order], return_index=True), len(c)))
    (left, a, first_a, n_a), (right, b, first_b, n_b) = sides
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    first_a, first_b = np.append(first_a, n_a), np.append(first_b, n_b)
    dims = left.column("dim").to_numpy()
    return left, right, [(int(dims[first_a[x]]), first_a[x], first_a[x + 1], first_b[y], first_b[y + 1]) for x, y in zip(at_a, at_b)]


def _matrix(rows, column: str):
    """The vectors of a column one behind the other, and where each begins."""
    import numpy as np

    chunks = [c for c in rows.column(column).chunks if len(c)]
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks])
    return np.concatenate([c.flatten().to_numpy() for c in chunks]), np.concatenate([[0], np.cumsum(sizes)])


def _cells(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """user_id, dim, key, v, and the nearest pivot's cell and angle. Users without pivots are left out."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        at, cells, angles = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            left, right, users = _users(left, right)
            (x, at_x), (p, at_p), cell = _matrix(left, "v"), _matrix(right, "v"), right.column("cell").to_numpy()
            for dim, a, b, c, d in users:
                order = c + np.argsort(cell[c:d])
                angle = np.arccos(np.clip(x[at_x[a] : at_x[b]].reshape(-1, dim) @ p[at_p[c] : at_p[d]].reshape(-1, dim)[order - c].T, -1, 1))
                best = angle.argmin(1)
                at.append(np.arange(a, b))
                cells.append(cell[order[best]])
                angles.append(angle[np.arange(b - a), best])
        own = left.select([*SPACE, "key", "v"]).take(pa.array(np.concatenate(at)))
        return own.append_column("cell", pa.array(np.concatenate(cells), pa.int32())).append_column("angle", pa.array(np.concatenate(angles)))

    kind = dict(rows.dtypes)
    return _tiles(rows.select(*SPACE, "key", "v"), pivots.select(*SPACE, "cell", "v"), ("key", "cell"), run, f"user_id {kind['user_id']}, dim int, key {kind['key']}, v array<double>, cell int, angle double", split=False)


@dataclass
class VectorIndex:
    """pivots(user_id, dim, cell, v), entries(user_id, dim, key, v, cell, angle)."""

    pivots: DataFrame
    entries: DataFrame

    @classmethod
    def build(cls, memories: DataFrame, cells: int = CELLS) -> "VectorIndex":
        """Index ``memories(user_id, key, embedding)``; a user gets about as many cells as each then has entries, ``cells`` at most."""
        importable(memories.sparkSession)
        units = checkpointed(unit_vectors(memories, "key"))
        order = Window.partitionBy(*SPACE).orderBy(F.xxhash64("key"), "key")
        some = units.withColumn("cell", F.row_number().over(order)).where(F.col("cell") <= cells)
        wanted = units.groupBy(*SPACE).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("wanted"))
        pivots = _meet(some, wanted, SPACE).where("cell <= wanted").select(*SPACE, "cell", "v")
        pivots = checkpointed(pivots)
        return cls(pivots, checkpointed(_cells(units, pivots)))

    def save(self, path: str) -> "VectorIndex":
        """Write the index, entries sorted by cell, so that a reader's filters on user and cell skip files and row groups."""
        self.pivots.write.mode("overwrite").parquet(f"{path}/pivots")
        self.entries.repartition(*SPACE, "cell").sortWithinPartitions(*SPACE, "cell", "angle").write.mode("overwrite").parquet(f"{path}/entries")
        return self.load(self.pivots.sparkSession, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "VectorIndex":
        return cls(spark.read.parquet(f"{path}/pivots"), spark.read.parquet(f"{path}/entries"))

    def append(self, memories: DataFrame, path: str) -> "VectorIndex":
        """Add memories to the index saved at ``path``: users it knows keep their pivots, others get their own. Nothing is rewritten."""
        importable(memories.sparkSession)
        units = checkpointed(unit_vectors(memories, "key"))
        old = _cells(units, self.pivots)
        others = _meet(units, self.pivots.select(*SPACE).distinct(), SPACE, "left_anti").select("user_id", "key", F.col("v").alias("embedding"))
        new = VectorIndex.build(others)
        old.unionByName(new.entries).repartition(*SPACE, "cell").sortWithinPartitions(*SPACE, "cell", "angle").write.mode("append").parquet(f"{path}/entries")
        new.pivots.write.mode("append").parquet(f"{path}/pivots")
        return self.load(memories.sparkSession, path)

    def candidates(self, questions: DataFrame, k: int) -> DataFrame:
        """user_id, qid, key, cosine of a question's k nearest entries of each tile; those that can't be nearer than k others of the tile are not compared."""

        def run(left, right):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            at, to, cosine = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            if left.num_rows and right.num_rows:
                left, right, users = _users(left, right)
                (x, at_x), (v, at_v) = _matrix(left, "v"), _matrix(right, "v")
                cell, angle = right.column("cell").to_numpy(), right.column("angle").to_numpy()
                rank = np.empty(right.num_rows, np.int64)
                rank[pc.sort_indices(right.column("key").combine_chunks()).to_numpy()] = np.arange(right.num_rows)
                for dim, a, b, c, d in users:
                    own, asked = v[at_v[c] : at_v[d]].reshape(-1, dim), x[at_x[a] : at_x[b]].reshape(-1, dim)
                    for n in range(0, b - a, max(1, HELD // (d - c))):
                        i, j, score = _nearest(asked[n : n + max(1, HELD // (d - c))], own, cell[c:d], angle[c:d], rank[c:d], k)
                        at.append(a + n + i)
                        to.append(c + j)
                        cosine.append(score)
            out = left.select(["user_id", "qid"]).take(pa.array(np.concatenate(at)))
            key = right.column("key").take(pa.array(np.concatenate(to)))
            return out.append_column("key", key).append_column("cosine", pa.array(np.concatenate(cosine)))

        asked = checkpointed(unit_vectors(questions, "qid"))
        entries = self.entries.select(*SPACE, "key", "cell", "angle", "v")
        kind, new = dict(entries.dtypes), dict(asked.dtypes)
        return _tiles(asked, entries, ("qid", "key"), run, f"user_id {kind['user_id']}, qid {new['qid']}, key {kind['key']}, cosine double")

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """(user_id, qid, key, cosine, rank): the k nearest entries of each question's user, exactly; ties by key."""
        from .retrieval import top_k

        if k <= 0:
            return self.entries.where("false").select("user_id", F.lit(None).cast(dict(questions.dtypes)["qid"]).alias("qid"), "key", F.lit(0.0).alias("cosine"), F.lit(0).cast("long").alias("rank"))
        return top_k(self.candidates(questions, k), ["user_id", "qid"], [F.round("cosine", 9).desc(), F.col("key")], k)


def _nearest(x, v, cell, angle, rank, k: int):
    """Places of questions ``x`` and of their k nearest of a user's entries ``v``, and cosines; entries of equal cosines by rank.

    Of each cell the entry nearest to the pivot stands for it. Cells are compared from the nearest on until they hold k entries, then
    those that may hold one as near as the k-th.
    """
    import numpy as np

    n, some = len(v), min(k, len(v))
    if n <= max(FEW, k):
        cosine = x @ v.T
    else:
        order = np.lexsort((angle, cell))
        _, first, size = np.unique(cell[order], return_index=True, return_counts=True)
        middle = v[order[first]]
        own = np.arccos(np.clip((v[order] * np.repeat(middle, size, axis=0)).sum(1), -1, 1))
        near = np.arccos(np.clip(x @ middle.T, -1, 1))
        gap = np.maximum(near - np.maximum.reduceat(own, first), 0)
        by = np.argsort(near, axis=1, kind="stable")
        before = np.cumsum(size[by], axis=1) - size[by]
        begin = np.empty(near.shape, bool)
        np.put_along_axis(begin, by, before < k, axis=1)
        cosine = np.full((len(x), n), -2.0)

        def compare(which):
            for c in np.flatnonzero(which.any(0)):
                rows, cols = np.flatnonzero(which[:, c]), order[first[c] : first[c] + size[c]]
                cosine[rows[:, None], cols[None, :]] = x[rows] @ v[cols].T

        compare(begin)
        kth = np.partition(cosine, n - some, axis=1)[:, n - some]
        compare(~begin & (np.cos(np.maximum(gap - ANGLE, 0)) >= kth[:, None] - TIE))
    # as search orders them: by the cosine's first nine places, then by key
    place = np.empty(n, np.int64)
    place[np.argsort(rank)] = np.arange(n)
    worth = np.floor(cosine * 1e9 + 0.5).astype(np.int64) * n - place
    j = np.argpartition(worth, n - some, axis=1)[:, n - some :]
    i = np.repeat(np.arange(len(x)), some)
    return i, j.ravel(), cosine[i, j.ravel()]
