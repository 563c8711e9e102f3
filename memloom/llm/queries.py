"""The thirteen operators as queries over their whole tables, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, audit, bytepair, exact, html, minhash, mixing, neighbours, packing, quality, secrets, substring, wavelet
from .common import prepare, table
from .oracles import ORACLES  # noqa: F401


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents", "doc_id", "text", *columns)


def op1_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_shards(_docs(spark, sf_dir))


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return neighbours.embedding_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_classes(_docs(spark, sf_dir))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir, "source"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), least=(85, 100))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_docs(spark, sf_dir))


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_docs(spark, sf_dir), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(_docs(spark, sf_dir))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_docs(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.source_divergence(_docs(spark, sf_dir, "lang", "source"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(_docs(spark, sf_dir))


def op13_bytepair_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.round_trips(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_wavelet_shards, op2_nn_descent, op3_exact_dedup, op4_html_text, op5_source_mix, op6_minhash_dedup, op7_substring_dedup, op8_quality_scores, op9_packing, op10_secret_scan, op11_source_divergence, op12_token_alignment, op13_bytepair_round_trip)}
