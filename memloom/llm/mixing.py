"""Op 5. Mixing sources to target weights by Pareto order sampling, after certain whole copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: Most copies of a document, and most of a source's size that its target may be.
MOST = 3
#: Buckets of the random order in which a source's cut is first looked for.
BUCKETS = 4096


def word_count(text: Column) -> Column:
    r"""Number of words ``[^\x20\x09-\x0D]+``; null: 0."""
    text = F.coalesce(text, F.lit(""))
    plain = F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))
    return F.when(F.length(plain) == 0, F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``: shares of the total by weight, none above ``most`` times its size.

    A source whose full share at the level of water exceeds its cap gets its cap; the level is found by one pass
    in order of cap by weight. Null sources are one source, the last. One row per source: small at any input.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).cast("double").alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    s = s.withColumns({"total": F.sum("source_size").over(every).cast("double"), "all_w": F.sum("w").over(every), "cap_upto": F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)), "w_upto": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    level = (F.col("total") - (F.col("cap_upto") - F.col("cap"))) / (F.col("all_w") - (F.col("w_upto") - F.col("w")))
    s = s.withColumn("level", level)
    # the first that its cap does not bind sets the level for all after it
    open_level = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(every)["level"]
    target = F.when(open_level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * open_level))
    return s.select("source", "source_size", target.alias("target"))


def inclusion(classes: DataFrame) -> DataFrame:
    """``classes(source, k, words, residual)`` with p, the inclusion probability of a document of class k of its source.

    k is the number of binary digits of a document's size. p is proportional to k, at most 1, and such that the expected
    words of a source, p times the words of each class in sum, are its residual: as many of the largest classes as
    would come above 1 are certain, and the others share what is left. At most 64 rows a source.
    """
    larger = Window.partitionBy("source").orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source")
    c = classes.withColumns({"certain": F.coalesce(F.sum("words").over(larger), F.lit(0)), "kw": F.col("k") * F.col("words")})
    c = c.withColumns({"kw_left": F.sum("kw").over(every) - F.coalesce(F.sum("kw").over(larger), F.lit(0))})
    level = F.when(F.col("kw_left") > 0, (F.col("residual") - F.col("certain")) / F.col("kw_left"))
    # the largest class that isn't certain at its level sets the level for all smaller ones
    c = c.withColumn("level", level).withColumn("open", F.max(F.when(F.col("level") * F.col("k") < 1, F.struct("k", "level"))).over(every))
    p = F.when(F.col("residual") <= 0, F.lit(0.0)).when(F.col("open").isNull() | (F.col("k") > F.col("open.k")), F.lit(1.0)).otherwise(F.col("open.level") * F.col("k"))
    return c.select("source", "k", p.alias("p"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A random number in (0, 1) that reruns repeat: 48 bits of an md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def _drawn(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """``mix`` with the 128-bit hash (h1, h2) of each whole row beside it."""
    u = uniform(F.col("doc_id"), seed)
    row = [F.col(f"`{c}`") for c in docs.columns]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(*row).alias("h1"), F.xxhash64(F.lit(1), *row).alias("h2"))
    d = d.withColumn("odds", u / (1 - u)).withColumn("k", F.length(F.bin("size")))
    d = materialize(d, "sizes")  # texts are read once
    classes = materialize(d.groupBy("source", "k").agg(F.sum("size").alias("words")), "mix-classes")
    plan = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.select("source", "source_size", "target", F.floor(ratio).alias("whole"))
    plan = plan.withColumn("residual", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = classes.join(plan.withColumnRenamed("source", "of"), classes.source.eqNullSafe(F.col("of"))).drop("of")
    plan = materialize(plan, "mix-plan")  # a row per source and class, of a known size: broadcast only while it is small
    odds = inclusion(plan).toDF("of", "of_k", "p")
    plan = plan.join(odds, plan.source.eqNullSafe(F.col("of")) & (F.col("k") == F.col("of_k"))).drop("of", "of_k", "words")
    ranked = d.join(plan.withColumnsRenamed({"source": "of", "k": "of_k"}), d.source.eqNullSafe(F.col("of")) & (F.col("k") == F.col("of_k"))).drop("of", "of_k", "k")
    rank = F.when(F.col("p") >= 1, F.lit(0.0)).when(F.col("p") > 0, F.col("odds") / (F.col("p") / (1 - F.col("p"))))
    ranked = ranked.withColumn("pareto_rank", rank).drop("odds")
    ranked = ranked.withColumn("bucket", F.floor(F.col("pareto_rank") / (1 + F.col("pareto_rank")) * BUCKETS))  # in the order of ranks, those near 1 in the middle
    filled = ranked.where("pareto_rank IS NOT NULL").groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("residual").alias("residual"))
    upto = Window.partitionBy("source").orderBy("bucket")
    filled = filled.select("source", "bucket", (F.sum("n").over(upto) - F.col("n")).alias("before"), "n", "residual").where("n > 0 AND before < residual AND before + n >= residual")
    cut = materialize(filled.select(F.col("source").alias("cut_source"), F.col("bucket").alias("cut_bucket"), "before"), "mix-cuts")
    joined = ranked.join(cut, ranked.source.eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    # of the documents in the cut bucket those whose middle lies before the residual
    at_cut = joined.where("bucket = cut_bucket")
    order = Window.partitionBy("source").orderBy("pareto_rank", "doc_id", "size", "h1", "h2").rowsBetween(Window.unboundedPreceding, 0)
    near = at_cut.withColumn("extra", F.col("before") + F.sum("size").over(order) - F.col("size") / 2 <= F.col("residual"))
    away = joined.where("cut_bucket IS NULL OR bucket IS NULL OR bucket <> cut_bucket").withColumn("extra", (F.col("residual") > 0) & F.coalesce(F.col("bucket") < F.col("cut_bucket"), F.lit(False)))
    copies = (F.col("whole") + F.col("extra").cast("long")).cast("long")
    return near.unionByName(away).select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "pareto_rank", "p", "h1", "h2")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, pareto_rank, p.

    With r = target / source_size, every document of a source is certain of floor(r) copies. One more copy goes to some
    documents for the residual words, target - floor(r) * source_size, with unequal inclusion
    probabilities p that favour long documents (``inclusion``); where p is 1 that copy is certain too. Pareto order sampling ranks documents by
    u / (1 - u) : p / (1 - p), certain ones first, and takes each source's in the order of these ranks up to the
    residual words: the sample's size is fixed, in words, to within half a document. The rank at which a source is cut is found from counts per bucket of ranks, then exactly inside one
    bucket, so a source of any size is never sorted in one task. Empty documents take part with size 0 and count
    nothing. Rows with the same doc_id share u and are cut in order of size and a hash of the row. An empty table gives an empty result.
    """
    return _drawn(docs, weights, most, seed).drop("h1", "h2")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as it is taken.

    Rows are told apart by all their columns, so rows that repeat a doc_id are taken each by its own draw; rows equal in
    every column are interchangeable and come as often as they are taken together.
    """
    taken = _drawn(docs, weights, most, seed).groupBy("h1", "h2").agg(F.sum("copies").alias("__mix_copies")).where("__mix_copies > 0")
    row = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(row)])
    # equal rows become one before they are shuffled
    once = docs.select(F.xxhash64(*row).alias("h1"), F.xxhash64(F.lit(1), *row).alias("h2"), whole.alias("row")).groupBy("h1", "h2").agg(F.first("row").alias("row"))
    wide = once.join(taken, ["h1", "h2"])
    again = F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))
    return wide.select("row", again.alias("__mix_copy")).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
