"""Rubric scoring: judged scores joined from their definitions, weighted and capped means, snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S


def complete(units: DataFrame, definitions: DataFrame, raw: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Every unit with every defined rubric; rubrics that the judge left out score 0, of repeated ones the first counts.

    ``definitions(rubric)`` is a small dimension; ``raw(*keys, rubric, pos, score)`` is what judges returned.
    """
    first = raw.groupBy(*keys, "rubric").agg(F.min_by("score", "pos").alias("score"))
    grid = units.select(*keys).distinct().join(definitions.select("rubric"))
    scored = grid.join(first.withColumn("score", score), [*keys, "rubric"], "left")
    return scored.withColumn("score", F.coalesce(F.col("score"), F.lit(0).cast("double")))


def binary_scores(units: DataFrame, definitions: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of 0/1 rubrics per unit."""
    rows = complete(units, definitions, raw, keys, S.binary(F.col("score")).cast("double"))
    return rows.groupBy(*keys).agg(F.round(F.avg("score"), 4).alias("score"))


def trilevel_scores(units: DataFrame, definitions: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    rows = complete(units, definitions, raw, keys, S.trilevel(F.col("score")))
    return rows.groupBy(*keys).agg(F.round(F.avg("score"), 4).alias("score"))


def weighted_capped(units: DataFrame, definitions: DataFrame, raw: DataFrame, keys: list[str], cap: float = 0.4, gate: float = 0.3) -> DataFrame:
    """Weighted mean of clamped scores; at most ``cap`` if any gate rubric is at or below ``gate``.

    ``definitions(rubric, weight, is_gate)``.
    """
    rows = complete(units, definitions, raw, keys, S.clamp(F.col("score"))).join(definitions, "rubric")
    weighted = F.sum(F.col("weight") * F.col("score")) / F.sum("weight")
    shut = F.coalesce(F.min(F.when(F.col("is_gate"), F.col("score"))) <= F.lit(gate), F.lit(False))
    out = rows.groupBy(*keys).agg(F.round(weighted, 4).alias("mean"), shut.alias("shut"))
    return out.select(*keys, F.when(F.col("shut"), F.least("mean", F.lit(cap))).otherwise(F.col("mean")).alias("score"))


def model_means(scores: DataFrame, model: str, score: str) -> DataFrame:
    """Mean per model, and one over all units under the model '' (not the mean of means)."""
    by_model = scores.groupBy(model).agg(F.avg(score).alias("mean"), F.count(F.lit(1)).alias("units"))
    overall = scores.agg(F.lit("").alias(model), F.avg(score).alias("mean"), F.count(F.lit(1)).alias("units"))
    return by_model.unionByName(overall).withColumn("mean", F.round("mean", 4))


def count_weighted(score_a: Column, n_a: Column, score_b: Column, n_b: Column) -> Column:
    """Combined score of two buckets by their sizes; 0 if both are empty."""
    return F.when(n_a + n_b > 0, (score_a * n_a + score_b * n_b) / (n_a + n_b)).otherwise(F.lit(0.0))


def precision_recall_mean(items: DataFrame, facts: DataFrame, extras: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of precision over items (0 without any), recall over facts (1 without any) and auxiliary scores, per unit.

    Each input has rows (*keys, score); the units are those of ``extras``.
    """
    mean = lambda df, name: df.groupBy(*keys).agg(F.avg("score").alias(name))
    rows = mean(extras, "aux").join(mean(items, "precision"), keys, "left").join(mean(facts, "recall"), keys, "left")
    rows = rows.withColumns({"precision": F.coalesce("precision", F.lit(0.0)), "recall": F.coalesce("recall", F.lit(1.0))})
    return rows.withColumn("score", F.round((F.col("precision") + F.col("recall") + F.col("aux")) / 3, 4))


def strict_score(passed: Column, checks: Column, missing: Column, total: Column) -> Column:
    """Precision over an item's checks times recall (total - missing) / total, not below 0 and 1 without any fact."""
    precision = F.when(checks > 0, passed / checks).otherwise(F.lit(0.0))
    recall = F.when(total > 0, F.greatest(F.lit(0.0), (total - missing) / total)).otherwise(F.lit(1.0))
    return F.round(precision * recall, 4)


def salient_facts(facts: DataFrame) -> DataFrame:
    """Facts with defaults: id F<n>, category other, importance medium; blank texts are dropped."""
    kept = facts.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    default = lambda c, v: F.coalesce(F.nullif(F.trim(c), F.lit("")), v).alias(c)
    return kept.select("unit", "pos", default("id", F.concat(F.lit("F"), F.col("pos").cast("string"))), F.trim("text").alias("text"), default("category", F.lit("other")), default("importance", F.lit("medium")))


def snapshot_diff(snapshots: DataFrame) -> DataFrame:
    """Rows that a session added or changed: (user_id, session, id, change); all of the first session, never removals.

    ``snapshots(user_id, session, id, text, event, anchor_time)``; an id that skipped a session counts as new again.
    """
    before = Window.partitionBy("user_id", "id").orderBy("session")
    was = F.lag(F.struct("session", "text", "event", "anchor_time")).over(before)
    s = snapshots.withColumns({"was": was, "place": F.dense_rank().over(Window.partitionBy("user_id").orderBy("session"))})
    s = s.withColumn("was_place", F.lag("place").over(before))
    here = F.col("was_place") == F.col("place") - 1
    same = here & F.col("text").eqNullSafe(F.col("was.text")) & F.col("event").eqNullSafe(F.col("was.event")) & F.col("anchor_time").eqNullSafe(F.col("was.anchor_time"))
    change = F.when(here.isNull() | ~here, "new").when(~same, "changed")
    return s.withColumn("change", change).where("change IS NOT NULL").select("user_id", "session", "id", "change")


def final_snapshot(snapshots: DataFrame) -> DataFrame:
    """The rows of each user's last session."""
    last = snapshots.groupBy("user_id").agg(F.max("session").alias("session"))
    return snapshots.join(last, ["user_id", "session"])


def merge_runs(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Of several runs' rows the last run's, per key."""
    rest = [c for c in rows.columns if c not in (*keys, sequence)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("r")).select(*keys, "r.*")


def item_scores(items: DataFrame, definitions: DataFrame, raw: DataFrame) -> DataFrame:
    """Per (model, type, rubric): objects, evaluable ones, and the mean over these (null if none).

    ``items(model, type, item)``, ``definitions(type, rubric)``, ``raw(model, item, rubric, pos, evaluable, score)``;
    of repeated judgements the first counts, and a missing one is not evaluable.
    """
    first = raw.groupBy("model", "item", "rubric").agg(F.min_by(F.struct("evaluable", "score"), "pos").alias("r"))
    grid = items.join(definitions, "type").join(first, ["model", "item", "rubric"], "left")
    ok = F.coalesce(F.col("r.evaluable"), F.lit(False))
    return grid.groupBy("model", "type", "rubric").agg(F.count(F.lit(1)).alias("objects"), F.count_if(ok).alias("evaluable"), F.round(F.avg(F.when(ok, S.clamp(F.col("r.score")))), 4).alias("mean"))


def pivoted(rows: DataFrame, keys: list[str], rubric: str, score: str, names: list[str]) -> DataFrame:
    """One row per unit with a column per rubric, for flat files."""
    return rows.groupBy(*keys).pivot(rubric, names).agg(F.first(score))


def keyword_coverage(texts: DataFrame, memories: DataFrame, k: int) -> DataFrame:
    """Coverage of each group's top-k TF-IDF words by its memories. The published outputs name no formula; this one is
    tf * ln((1 + groups) / (1 + groups with the word)), and a word is covered if any memory of the group has it."""
    from ..functions.text import content_tokens

    words = texts.select("group", F.explode(content_tokens(F.col("text"))).alias("word")).groupBy("group", "word").agg(F.count(F.lit(1)).alias("tf"))
    groups = texts.select("group").distinct().agg(F.count(F.lit(1)).alias("n"))
    spread = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weight = F.round(F.col("tf") * F.log((F.col("n") + 1) / (F.col("df") + 1)), 6)
    ranked = words.join(spread, "word").join(groups).withColumn("weight", weight)
    top = ranked.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy(F.col("weight").desc(), "word"))).where(F.col("r") <= k)
    have = memories.select("group", F.explode(F.array_distinct(content_tokens(F.col("text")))).alias("word")).distinct().withColumn("hit", F.lit(1))
    return top.join(have, ["group", "word"], "left").groupBy("group").agg(F.count(F.lit(1)).alias("keywords"), F.count("hit").alias("covered"))
