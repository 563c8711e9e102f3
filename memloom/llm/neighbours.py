"""Op 2. Embedding near-dedup by NN-descent, with enlarged lists, a recall audit and exact threshold edges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, parallelism, prepare
from .components import components

LINK = 0.9
#: Neighbours of a list, and the most of one that links have saturated: such a list doubles from round to round.
K, MOST = 12, 96
#: Random orders that seed the graph, neighbours looked at in each, and what a vector takes from one.
ORDERS, REACH, TAKE = 12, 8, 4
#: Neighbours of neighbours that a vector takes from one list, and rounds at most.
GAIN, ROUNDS = 4, 10
#: Vectors of the audit sample, planted vectors, and the recall that ends the descent.
AUDIT, PLANTS, RECALL = 1024, 1024, 0.999
#: Slack for the 8-bit vectors that the descent compares.
NEAR = 0.03
TILE = 512
#: Numbers in a block of vectors that is compared with all others.
BLOCK = 1 << 20


def vectors(rows: DataFrame) -> DataFrame:
    """(id, copies, size, q, v): distinct usable vectors, of unit length in 8 bits (q) and in double precision (v).

    Vectors that are null, empty, zero or hold null or non-finite components are left out; equal vectors become one.
    """
    good = rows.where(F.col("vec_id").isNotNull() & F.coalesce(F.size("e") > 0, F.lit(False)))
    good = good.where(F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("e", lambda x: x != 0))
    one = good.groupBy("e").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            unit = []
            for e in frame.pop("e"):
                e = np.asarray(e, np.float64)
                e = e / np.abs(e).max()  # so that squares neither vanish nor overflow
                unit.append(e / math.sqrt(e @ e))
            frame["size"] = [len(u) for u in unit]
            frame["q"] = [np.rint(u * (127 / np.abs(u).max())).astype(np.int8).tobytes() for u in unit]
            frame["v"] = [u.astype("<f8").tobytes() for u in unit]
            yield frame[["id", "copies", "size", "q", "v"]]

    return one.mapInPandas(run, "id long, copies long, size int, q binary, v binary")


def _units(column) -> np.ndarray:
    width = max(map(len, column))  # zeros behind shorter vectors, which never meet longer ones
    q = np.frombuffer(b"".join(c.ljust(width, b"\0") for c in map(bytes, column)), np.int8).reshape(len(column), width).astype(np.float32)
    return q / np.sqrt((q * q).sum(1, keepdims=True))


def _seeds(nodes: DataFrame, n: int, salt: int) -> DataFrame:
    """(a, b, sim): each vector's best of those near it in random orders: by the signs of some projections, then by one more."""
    bits = max(0, math.ceil(math.log2(max(1, n / 64))))

    def order(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for size, part in frame.groupby("size"):
                x = _units(part["q"])
                for t in range(ORDERS):
                    planes = np.random.default_rng((salt, t, size)).standard_normal((size, bits + 1)).astype(np.float32)
                    p = x @ planes
                    key = ((p[:, :bits] > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                    yield pd.DataFrame({"t": t, "size": size, "key": key, "along": p[:, bits], "id": part["id"].to_numpy(), "q": part["q"].to_numpy()})

    def near(frames: Iterator) -> Iterator:
        import pandas as pd

        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            rest = frame.iloc[-REACH:]
            group = frame["t"].to_numpy(np.int64) * (1 << 32) + frame["size"].to_numpy(np.int64)
            for g in pd.unique(group):
                part = frame[group == g]
                x, ids, m = _units(part["q"]), part["id"].to_numpy(), len(part)
                sims = np.full((m, 2 * REACH), -2, np.float32)
                for s in range(1, min(REACH, m - 1) + 1):
                    d = (x[:-s] * x[s:]).sum(1)
                    sims[:-s, s - 1], sims[s:, REACH + s - 1] = d, d
                best = np.argsort(-sims, 1)[:, :TAKE]
                a = np.repeat(np.arange(m), best.shape[1])
                b = a + np.where(best < REACH, best + 1, REACH - 1 - best).ravel()
                sim = np.take_along_axis(sims, best, 1).ravel()
                ok = sim > -2
                yield pd.DataFrame({"a": ids[a[ok]], "b": ids[b[ok]], "sim": sim[ok]})

    rows = nodes.select("id", "size", "q").mapInPandas(order, "t int, size int, key long, along float, id long, q binary")
    rows = rows.repartitionByRange(parallelism(nodes.sparkSession), "t", "size", "key", "along", "id").sortWithinPartitions("t", "size", "key", "along", "id")
    return rows.mapInPandas(near, "a long, b long, sim float")


def _lists(pairs: DataFrame) -> DataFrame:
    """Neighbour lists (a, b, sim, fresh): the K best, and where those are links, links up to twice as many as before."""
    one = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("sim").desc(), "b"))
    link = F.col("sim") >= LINK - NEAR
    had = F.sum((link & ~F.col("fresh")).cast("int")).over(Window.partitionBy("a"))
    one = one.withColumns({"r": rank, "room": F.least(F.lit(MOST), F.greatest(F.lit(K), 2 * had))})
    return one.where((F.col("r") <= K) | link & (F.col("r") <= F.col("room"))).drop("r", "room")


def _descend(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, sim): pairs of neighbours of a vector, of which one is fresh, that better the list of a."""
    worst = graph.groupBy("a").agg(F.when(F.count(F.lit(1)) >= K, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    known = nodes.join(worst, nodes.id == worst.a, "left").select("id", "q", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))
    both = graph.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim", "fresh").union(graph.select("b", "a", "sim", "fresh"))
    both = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
    # a hub's list of those that name it is read up to its best: the lists of its neighbours hold the others
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.col("sim").desc(), "v"))
    both = both.withColumn("r", rank).where(F.col("r") <= MOST).select("u", "v", "fresh")
    rows = both.join(known, both.v == known.id).select("u", "v", "fresh", "q", "worst")
    rows = rows.repartition(parallelism(nodes.sparkSession), "u").sortWithinPartitions("u", "v")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        rest = None
        for frame in _ending(frames):
            if frame is not None:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if rest is None or rest.empty:
                continue
            u = rest["u"].to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(u)) + 1).tolist(), len(u)]
            if frame is not None:
                bounds.pop()  # the last list may go on in the next frame
            x, ids, fresh, worst = _units(rest["q"]), rest["v"].to_numpy(), rest["fresh"].to_numpy(bool), rest["worst"].to_numpy()
            out_a, out_b, out_s = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if hi - lo < 2 or not fresh[lo:hi].any():
                    continue
                s = x[lo:hi] @ x[lo:hi].T
                s[~(fresh[lo:hi, None] | fresh[None, lo:hi])] = -2
                np.fill_diagonal(s, -2)
                s[s <= worst[lo:hi, None]] = -2
                best = np.argpartition(-s, min(GAIN, hi - lo - 1), 1)[:, :GAIN] if hi - lo > GAIN else np.argsort(-s, 1)[:, : hi - lo - 1]
                sim = np.take_along_axis(s, best, 1)
                i, j = np.nonzero(sim > -2)
                out_a.append(ids[lo + i])
                out_b.append(ids[lo + best[i, j]])
                out_s.append(sim[i, j])
            rest = rest.iloc[bounds[-1] :] if frame is not None else None
            if out_a:
                yield pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b), "sim": np.concatenate(out_s)})

    return rows.mapInPandas(run, "a long, b long, sim float")


def _ending(frames: Iterator) -> Iterator:
    yield from frames
    yield None


def _bridges(rows: DataFrame, asked: DataFrame) -> DataFrame | None:
    """(a, b): parts that an exact link joins, from comparing ``asked`` with all ``rows(id, part, size, v)``, block by block."""
    count, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(1))).first()
    blocks, out = math.ceil(count * size / BLOCK), None
    for at in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(blocks)) == at).select("part", "size", "v").collect()
        known = {s: (np.array([r.part for r in some if r["size"] == s]), np.stack([np.frombuffer(r.v) for r in some if r["size"] == s])) for s in {r["size"] for r in some}}

        def run(frames: Iterator, known: dict = known) -> Iterator:
            import pandas as pd

            for frame in frames:
                for size, part in frame.groupby("size"):
                    if size in known:
                        theirs, x = known[size]
                        mine, y = part["part"].to_numpy(), np.stack([np.frombuffer(v) for v in part["v"]])
                        i, j = np.nonzero((y @ x.T >= LINK) & (mine[:, None] != theirs[None]))
                        yield pd.DataFrame({"a": mine[i], "b": theirs[j]}).drop_duplicates()

        found = materialize(rows.mapInPandas(run, "a long, b long").distinct(), "bridges")
        out = found if out is None else out.union(found)
    return out


def _parts(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, part) of every vector that the graph's links or the exact links of saturated lists join to another.

    A list that is full of links may have lost others, all of them to other groups if its own is large. The
    vectors of such lists are compared with every vector outside their part.
    """
    parts = materialize(components(graph.where(F.col("sim") >= LINK - NEAR)).toDF("id", "part"), "parts")
    full = graph.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")).where((F.col("n") >= MOST) & (F.col("least") >= LINK - NEAR))
    rows = materialize(nodes.join(parts, "id", "left").select("id", F.coalesce("part", "id").alias("part"), "size", "v"), "rows")
    joined = _joined(parts, _bridges(rows, rows.join(full.select(F.col("a").alias("id")), "id", "left_semi")))
    discard(rows)
    return joined


def _joined(parts: DataFrame, bridges: DataFrame | None) -> DataFrame:
    if bridges is None or bridges.isEmpty():
        return parts
    more = materialize(components(parts.toDF("a", "b").union(bridges)).toDF("id", "part"), "parts")
    discard(parts)
    discard(bridges)
    return more


def audit(nodes: DataFrame, parts: DataFrame, sample: int = AUDIT) -> float | None:
    """Recall of the parts: of the exact links that a bounded sample of vectors have with all others, the share inside one part.

    Half of the sample is drawn from all vectors, half from those in parts. Shares are means per vector, then over all
    vectors or over parts, whichever is less, so that no large group hides others. None: the sample has no links.
    """
    order = F.xxhash64("id", F.lit(5))
    some = nodes.select("id").orderBy(order, "id").limit(sample // 2).union(parts.select("id").orderBy(order, "id").limit(sample // 2)).distinct()
    asked = nodes.join(F.broadcast(some), "id").select("id", "size", "v").collect()
    known = {s: (np.array([r.id for r in asked if r.size == s]), np.stack([np.frombuffer(r.v) for r in asked if r.size == s])) for s in {r["size"] for r in asked}} if asked else {}

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for size, part in frame.groupby("size"):
                if size in known:
                    ids, x = known[size]
                    y = np.stack([np.frombuffer(v) for v in part["v"]])
                    i, j = np.nonzero((y @ x.T >= LINK) & (part["id"].to_numpy()[:, None] != ids[None]))
                    yield pd.DataFrame({"b": ids[j], "x": part["part"].to_numpy()[i]}).value_counts().reset_index(name="n")

    placed = nodes.join(parts, "id", "left").select("id", F.coalesce("part", "id").alias("part"), "size", "v")
    true = materialize(placed.mapInPandas(run, "b long, x long, n long"), "audit")
    met = true.join(parts.toDF("b", "y"), "b", "left").withColumn("y", F.coalesce("y", "b"))
    inside = F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")
    shares = met.groupBy("b", F.col("y").alias("part")).agg(inside.alias("share")).groupBy("part").agg(F.sum("share").alias("share"), F.count(F.lit(1)).alias("n"))
    row = shares.agg(F.sum("share") / F.sum("n"), F.avg(F.col("share") / F.col("n"))).first()
    discard(true)
    return None if row[0] is None else min(row)


def _planted(nodes: DataFrame, count: int = PLANTS) -> tuple[DataFrame, DataFrame]:
    """(nodes and planted vectors, pairs (origin, plant)): a bounded sample of vectors, each turned by a random angle just inside a link.

    Links may be so rare that no sample of vectors has any; the planted ones tell whether the descent would have found them.
    """
    spark = nodes.sparkSession
    low, high = nodes.agg(F.min("id"), F.max("id")).first()
    some = nodes.orderBy(F.xxhash64("id", F.lit(21)), "id").limit(count).select("id", "size", "v").collect()
    rng, plants, pairs = np.random.default_rng(21), [], []
    for i, r in enumerate(some):
        v = np.frombuffer(r.v)
        w = rng.standard_normal(len(v))
        w -= (w @ v) * v
        norm = np.linalg.norm(w)
        c = LINK + 0.01
        u = c * v + math.sqrt(1 - c * c) * w / norm if norm > 1e-9 else v
        q = np.rint(u * (127 / np.abs(u).max())).astype(np.int8).tobytes()
        new = high + 1 + i if high < 1 << 62 else low - 1 - i
        plants.append((new, r["size"], bytearray(q), bytearray(u.astype("<f8").tobytes())))
        pairs.append((r.id, new))
    every = nodes.select("id", "size", "q", "v")
    every = materialize(every.union(spark.createDataFrame(plants, every.schema)) if plants else every, "planted")
    return every, spark.createDataFrame(pairs, "a long, b long")


def neighbour_parts(nodes: DataFrame) -> DataFrame:
    """(id, part) of the vectors of ``nodes(id, size, q, v)`` that hang together with others, by NN-descent.

    Lists begin with what stands near in random orders. In a round each vector shows its neighbours (and those that
    name it) to each other, only if one of the two is fresh, and lists keep their best; lists full of links double. The
    descent ends when the audits find the links of sampled vectors, and vectors planted near others, connected; while
    they are short, new random orders are mixed in. If they still are after the last round,
    or once lists don't change, all vectors are compared with those of other parts. Planted vectors may be among the result's.
    """
    every, pairs = _planted(nodes)
    n = every.count()
    graph = materialize(_lists(_seeds(every, n, 0).withColumn("fresh", F.lit(True))), "graph")
    for turn in range(1, ROUNDS + 1):
        more = _descend(graph, every)
        if turn > 2:
            more = more.union(_seeds(every, n, turn))
        new = materialize(_lists(graph.select("a", "b", "sim", F.lit(False).alias("fresh")).union(more.withColumn("fresh", F.lit(True)))), "graph")
        discard(graph)
        graph = new
        last = turn == ROUNDS or not graph.where("fresh").head(1)
        if turn < 2 and not last:
            continue
        parts = _parts(graph, every)
        met = pairs.join(parts.toDF("a", "x"), "a", "left").join(parts.toDF("b", "y"), "b", "left")
        found = met.agg(F.avg(F.coalesce(F.col("x") == F.col("y"), F.lit(False)).cast("double"))).first()[0]
        measured = audit(nodes, parts)
        if min(1.0 if found is None else found, 1.0 if measured is None else measured) >= RECALL:
            break
        if last:
            rows = materialize(nodes.join(parts, "id", "left").select("id", F.coalesce("part", "id").alias("part"), "size", "v"), "rows")
            parts = _joined(parts, _bridges(rows, rows))
            discard(rows)
            break
        discard(parts)
    discard(graph)
    discard(every)
    return parts


def _tiles(members: DataFrame) -> DataFrame:
    """(id, linked, other): exact links of each member of ``members(part, id, copies, v)`` inside its part.

    A part is dealt out as tiles; a tile gives for each of its vectors the number of vectors linked (copies
    counted) and, for every group of linked vectors in it, edges to the group's smallest id.
    """
    sizes = members.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).where("tiles > 0")
    m = members.join(sizes, "part").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    m = m.select("part", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "copies", "v")
    m = m.repartition(parallelism(members.sparkSession), "part", "i", "j").sortWithinPartitions("part", "i", "j", "id")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        rest = None
        for frame in _ending(frames):
            if frame is not None:
                rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if rest is None or rest.empty:
                continue
            keys = rest[["part", "i", "j"]].to_numpy()
            bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(rest)]
            if frame is not None:
                bounds.pop()
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                g = rest.iloc[lo:hi]
                x, ids, copies, tile = np.stack([np.frombuffer(v) for v in g["v"]]), g["id"].to_numpy(), g["copies"].to_numpy(), g["tile"].to_numpy()
                link = x @ x.T >= LINK
                np.fill_diagonal(link, False)
                if g["i"].iloc[0] != g["j"].iloc[0]:
                    link &= tile[:, None] != tile[None]
                label = np.arange(len(ids))  # rows are in order of id
                while True:
                    low = np.minimum(label, np.where(link, label[None], len(ids)).min(1))
                    if (low == label).all():
                        break
                    label = low
                out.append(pd.DataFrame({"id": ids, "linked": link @ copies, "other": ids[label]}))
            rest = rest.iloc[bounds[-1] :] if frame is not None else None
            if out:
                yield pd.concat(out, ignore_index=True)

    return m.mapInPandas(run, "id long, linked long, other long")


def embedding_duplicates(rows: DataFrame) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept, comparing all rows of ``rows(vec_id, embedding)``.

    NN-descent finds which vectors hang together, and vectors whose lists are saturated are compared with all outside
    their part; every part is then compared exactly, in tiles, in double precision, which enlarges saturated lists as
    far as they go and drops what is below the threshold. Vectors of
    different lengths and unusable ones (null, zero, null or non-finite components) link with nothing. Equal
    vectors are compared once and count as linked copies. Rows that repeat a vec_id are counted one by one.
    """
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    nodes = materialize(vectors(rows), "vectors")
    parts = neighbour_parts(nodes)
    members = materialize(nodes.join(parts, "id").select("part", "id", "copies", "v"), "members")
    discard(parts)
    tiles = materialize(_tiles(members), "tiles")
    discard(members)
    final = components(tiles.select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = tiles.groupBy("id").agg(F.sum("linked").alias("linked"))
    found = nodes.select("id", "copies").join(counts, "id", "left").join(final.toDF("id", "c"), "id", "left")
    found = found.select("id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "id").alias("c"))
    usable = rows.groupBy("e").agg(F.min("vec_id").alias("id"))  # the representatives of vectors()
    out = rows.join(usable, "e", "left").join(found, "id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
