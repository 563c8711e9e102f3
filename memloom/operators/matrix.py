"""Experiment matrix: run plans, pending work, timings and final scores as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PHASES = ("add", "search", "answer", "eval", "score")


def plan_runs(models: DataFrame, backends: DataFrame, add_repeats: int, search_repeats: int) -> DataFrame:
    """One add run per model and repeat, and below it a search run per backend and search repeat.

    ``models(model)`` and ``backends(backend)`` are small dimensions.
    """
    adds = models.select("model", F.explode(F.sequence(F.lit(1), F.lit(add_repeats))).alias("repeat"))
    add = adds.select("model", "repeat", F.lit("").alias("backend"), F.lit(0).alias("search_repeat"), F.lit(True).alias("is_add"), F.format_string("%s_add%02d", "model", "repeat").alias("run_id"))
    each = adds.join(backends.select("backend")).withColumn("search_repeat", F.explode(F.sequence(F.lit(1), F.lit(search_repeats))))
    search = each.select("model", "repeat", "backend", "search_repeat", F.lit(False).alias("is_add"), F.format_string("%s_add%02d_%s_s%02d", "model", "repeat", "backend", "search_repeat").alias("run_id"))
    return add.unionByName(search)


def plan_raw_runs(spark: SparkSession, backends: DataFrame) -> DataFrame:
    """One shared add run of raw sessions and one search run per backend."""
    add = spark.range(1).select(F.lit("raw_add").alias("run_id"), F.lit("").alias("backend"), F.lit(True).alias("is_add"))
    return add.unionByName(backends.select(F.concat(F.lit("raw_"), "backend").alias("run_id"), "backend", F.lit(False).alias("is_add")))


def waves(runs: DataFrame) -> DataFrame:
    """Order of execution: repeat by repeat, adds, then search and answer, then scoring."""
    phases = F.when(F.col("is_add"), F.array(F.lit("add"))).otherwise(F.array(*[F.lit(p) for p in PHASES[1:]]))
    wave = F.when(F.col("phase") == "add", 1).when(F.col("phase").isin("search", "answer"), 2).otherwise(3)
    return runs.withColumn("phase", F.explode(phases)).withColumn("wave", F.col("repeat") * 10 + wave)


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned work that nothing has completed."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def timing_summary(timings: DataFrame, phases: tuple[str, ...] = PHASES) -> DataFrame:
    """Seconds per run and phase, side by side; of repeated entries the last counts."""
    last = timings.groupBy("run_id", "phase").agg(F.max_by("elapsed_s", "finished_at").alias("elapsed_s"))
    return last.groupBy("run_id").pivot("phase", list(phases)).agg(F.first("elapsed_s"))


def final_scores(runs: DataFrame, summaries: DataFrame, timings: DataFrame) -> DataFrame:
    """Search runs with their overall mean scores and timings, where they have any."""
    overall = summaries.where("scope = 'overall'").groupBy("run_id").pivot("metric", ["llm_score", "f1_score", "bleu_score"]).agg(F.first("mean"))
    return runs.where("NOT is_add").join(overall, "run_id", "left").join(timings, "run_id", "left")


def shard(index: Column, n: int) -> Column:
    return F.pmod(index, F.lit(n))


def is_retryable(status: Column, message: Column) -> Column:
    """Errors after which a call is tried again: by HTTP status, or by words of the message."""
    hit = F.coalesce(status.isin(402, 403, 408, 409, 429, 500, 502, 503, 504), F.lit(False))
    low = F.lower(F.coalesce(message, F.lit("")))
    for word in ("timeout", "timed out", "connection", "rate limit", "overloaded"):
        hit = hit | low.contains(word)
    return hit


def has_retrieval(found: Column, found_a: Column, found_b: Column, skipped: Column) -> Column:
    """A record is searched if it has a global block, even an empty one, both speakers' blocks, or was skipped."""
    return found.isNotNull() | (found_a.isNotNull() & found_b.isNotNull()) | F.coalesce(skipped, F.lit(False))


def has_answer(predicted: Column) -> Column:
    return predicted.isNotNull()


def has_scores(*metrics: Column) -> Column:
    out = F.lit(True)
    for m in metrics:
        out = out & m.isNotNull()
    return out


def filter_runs(runs: DataFrame, only_add: bool = False, only_search: bool = False, model: str | None = None, backend: str | None = None, repeat: int | None = None) -> DataFrame:
    """Runs of the given kind; a backend filter leaves add runs in unless only searches are asked for."""
    out = runs
    if only_add:
        out = out.where("is_add")
    if only_search:
        out = out.where("NOT is_add")
    if model is not None:
        out = out.where(F.col("model") == model)
    if backend is not None:
        out = out.where(F.col("is_add") | (F.col("backend") == backend))
    if repeat is not None:
        out = out.where(F.col("repeat") == repeat)
    return out


def first_half(units: DataFrame, index: str) -> DataFrame:
    """The first max(1, n // 2) units by index, which counts from 0 without gaps."""
    n = units.agg(F.count(F.lit(1)).alias("__n"))
    return units.join(n).where(F.col(index) < F.greatest(F.lit(1), F.floor(F.col("__n") / 2))).drop("__n")


def split_keys(text: str) -> list[str]:
    """Distinct keys of a list parted by commas, semicolons or lines, in order."""
    parts = text.replace(";", "\n").replace(",", "\n").split("\n")
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))
