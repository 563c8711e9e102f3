"""Answer metrics, best-of candidates, the empty-answer rule, and hierarchical score summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpointed


def _overlap(pred: Column, ref: Column) -> Column:
    """Clipped multiset overlap of two token arrays."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    shared = F.array_intersect(pred, ref)
    return F.aggregate(shared, F.lit(0), lambda s, t: s + F.least(count(pred, t), count(ref, t)))


def token_f1(pred: Column, ref: Column) -> Column:
    """F1 of two token arrays; 0 if either is empty or nothing is shared."""
    o, p, r = _overlap(pred, ref).cast("double"), F.size(pred), F.size(ref)
    return F.when((p > 0) & (r > 0) & (o > 0), 2 * (o / p) * (o / r) / (o / p + o / r)).otherwise(F.lit(0.0))


def bleu1(pred: Column, ref: Column) -> Column:
    """Clipped unigram precision with a brevity penalty exp(1 - r / p) for short predictions."""
    o, p, r = _overlap(pred, ref).cast("double"), F.size(pred).cast("double"), F.size(ref).cast("double")
    penalty = F.when(p < r, F.exp(F.lit(1.0) - r / p)).otherwise(F.lit(1.0))
    return F.when((p > 0) & (r > 0) & (o > 0), penalty * (o / p)).otherwise(F.lit(0.0))


def answer_candidates(answer: Column, reference: Column) -> Column:
    """Distinct candidates that aren't blank, in order; an empty text if there is none."""
    both = F.array_distinct(F.filter(F.transform(F.concat(answer, reference), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("")))


def best_of(records: DataFrame, keys: list[str], prediction: str, candidates: str) -> DataFrame:
    """Best token F1 and BLEU-1 of a prediction over its candidate answers, and the first candidate with the best F1."""
    rows = records.select(*keys, T.metric_tokens(F.col(prediction)).alias("p"), F.posexplode(candidates).alias("pos", "candidate"))
    rows = rows.withColumn("c", T.metric_tokens(F.col("candidate")))
    rows = rows.select(*keys, "pos", "candidate", token_f1(F.col("p"), F.col("c")).alias("f1"), bleu1(F.col("p"), F.col("c")).alias("bleu"))
    return rows.groupBy(*keys).agg(F.max("f1").alias("f1_score"), F.max("bleu").alias("bleu_score"), F.max_by("candidate", F.struct("f1", -F.col("pos"))).alias("scoring_answer"))


def apply_empty_rule(records: DataFrame) -> DataFrame:
    """A blank answer scores 0; what the judge gave is kept once, in llm_score_judge."""
    blank = F.coalesce(F.nullif(F.trim("predicted_answer"), F.lit("")), F.nullif(F.trim("response"), F.lit(""))).isNull()
    judged = F.when(blank & F.col("llm_score_judge").isNull(), F.col("llm_score")).otherwise(F.col("llm_score_judge"))
    return records.withColumn("llm_score_judge", judged).withColumn("llm_score", F.when(blank, F.lit(0.0)).otherwise(F.col("llm_score")))


def metric_fields(columns: list[str]) -> list[str]:
    """Score columns: the three main ones first, others by name."""
    lead = ["llm_score", "f1_score", "bleu_score"]
    found = [c for c in columns if c.endswith("_score")]
    return [c for c in lead if c in found] + sorted(c for c in found if c not in lead)


def score_summary(records: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(scope, category, conversation, metric, count, missing_count, mean, min, max) in one pass over all four grains.

    A missing category is a category of its own (''); records without a conversation count overall and by category only.
    """
    metrics = metrics or metric_fields(records.columns)
    rows = records.select(F.coalesce("category", F.lit("")).alias("category"), F.col("conversation").cast("string").alias("conversation"), *metrics)
    long = rows.unpivot(["category", "conversation"], metrics, "metric", "value").withColumn("value", F.col("value").cast("double"))
    grains = long.groupingSets([[F.col("metric")], [F.col("metric"), F.col("category")], [F.col("metric"), F.col("conversation")], [F.col("metric"), F.col("category"), F.col("conversation")]], "metric", "category", "conversation")
    none = F.lit(0.0)
    out = grains.agg(
        F.grouping("category").alias("gc"), F.grouping("conversation").alias("gv"), F.count(F.lit(1)).alias("count"), (F.count(F.lit(1)) - F.count("value")).alias("missing_count"),
        F.coalesce(F.avg("value"), none).alias("mean"), F.coalesce(F.min("value"), none).alias("min"), F.coalesce(F.max("value"), none).alias("max"),
    )
    out = out.where("gv = 1 OR conversation IS NOT NULL")
    scope = F.when(F.col("gc") + F.col("gv") == 2, "overall").when(F.col("gv") == 1, "category").when(F.col("gc") == 1, "conversation").otherwise("conversation_category")
    return out.select(scope.alias("scope"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("conversation", F.lit("")).alias("conversation"), "metric", "count", "missing_count", "mean", "min", "max")


def row_numbers(rows: DataFrame, order: str) -> DataFrame:
    """Rows with a global number rn from 0 and their total, numbered range by range: no task sees all rows.

    Ranges are drawn from a sample and may be merged as they are read, so they are written once: counts and numbers must see the same ones.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() % (1 << 33))
    ranged = checkpointed(ranged)
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return ranged.join(before, "part").withColumn("rn", F.col("before") + F.col("at")).drop("part", "at", "before")


def systematic_sample(rows: DataFrame, order: str, n: int) -> DataFrame:
    """Every len // n-th row in order, at most n of them, with its number."""
    step = F.greatest(F.lit(1), F.floor(F.col("total") / n))
    return row_numbers(rows, order).where((F.col("rn") % step == 0) & (F.col("rn") / step < n)).drop("total")


#: Ranges of a histogram.
RANGES = 1024


def order_statistics(values: DataFrame, value: str, ranks: dict[str, int]) -> dict[str, object]:
    """The values at places (from 0) of the column in order, found by counting ranges.

    Each round is one pass: the range that is known to hold a rank is cut into ``RANGES`` parts, whose counts, least and greatest
    values come back, and the part with the rank is the next round's range; it ends when that holds one value. Nothing is
    sorted, and what comes back doesn't grow with the data. Values are finite numbers that a double tells apart; nulls aren't counted.
    """
    v = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    lowest, highest = v.agg(F.min("v"), F.max("v")).first()
    open_ranks = {name: (rank, lowest, highest) for name, rank in ranks.items()}
    out = {name: low for name, (_, low, high) in open_ranks.items() if float(low) == float(high)}
    while todo := {name: r for name, r in open_ranks.items() if name not in out}:
        spans = sorted({(low, high) for _, low, high in todo.values()})
        inside = [F.when(F.col("v").between(low, high), F.struct(F.lit(i).alias("span"), F.least(F.lit(RANGES - 1), F.floor((F.col("v") - F.lit(low)).cast("double") * RANGES / float(high - low))).cast("int").alias("part"))) for i, (low, high) in enumerate(spans)]
        parts = v.select("v", F.explode(F.array_compact(F.array(*inside))).alias("s")).groupBy("s.span", "s.part").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        counted = sorted(parts.collect(), key=lambda r: (r.span, r.part))
        for name, (rank, *span) in todo.items():
            for r in counted:
                if spans[r.span] != tuple(span):
                    continue
                if rank < r.n:
                    open_ranks[name] = (rank, r.low, r.high)
                    if float(r.low) == float(r.high):
                        out[name] = r.low
                    break
                rank -= r.n
    return out


def nearest_rank(values: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank round((n - 1) * p), halves to even, with min, max and the mean to one place; nulls without values."""
    kind = values.select(value).schema[0].dataType.simpleString()
    whole = values.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.sum(value) / F.nullif(F.count(value), F.lit(0)), 1).cast("double").alias("mean")).first()
    found = order_statistics(values, value, {name: round((whole.n - 1) * p) for name, p in shares.items()}) if whole.n else dict.fromkeys(shares)
    row = (whole["min"], *[found[name] for name in shares], whole["max"], whole["mean"])
    return values.sparkSession.createDataFrame([row], ", ".join(f"{c} {kind}" for c in ("min", *shares, "max")) + ", mean double")


def accuracy(records: DataFrame, score: str) -> DataFrame:
    right, n = F.count_if(F.col(score) == 1), F.count(F.lit(1))
    return records.agg(right.alias("correct"), (n - right).alias("wrong"), F.when(n > 0, F.round(right / n, 6)).otherwise(F.lit(0.0)).alias("accuracy"))


def flatten(records: DataFrame) -> DataFrame:
    """Flat export row: question, answers, scores, and the number of memories of either retrieval shape."""
    full = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.trim(t) != ""))
    memories = F.when(F.col("selected").isNotNull(), full(F.col("selected"))).otherwise(full(F.col("selected_a")) + full(F.col("selected_b")))
    return records.select("conversation", "qa_index", "question", F.col("category"), F.coalesce("predicted_answer", "response", F.lit("")).alias("prediction"), memories.cast("long").alias("memory_count"), *metric_fields(records.columns))
