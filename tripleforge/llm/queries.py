"""Queries of the text operators, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, editprint, hmm, lexical, licences, linededup, mixing, neardup, privacy, quality, sharding, toolcalls, vectorcodes
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) != 2)


def op2_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.fit_and_score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)


def op3_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.fingerprinted(table(spark, sf_dir, "documents"))


def near_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other half of op3: its fingerprints banded, and near texts verified."""
    return editprint.near_texts(table(spark, sf_dir, "documents"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_licence_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.spans(table(spark, sf_dir, "documents"))


def op7_fast_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))["documents"]


def op9_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.formatted(table(spark, sf_dir, "conversations"))


def op10_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, within lines too."""
    return linededup.shared_passages(table(spark, sf_dir, "documents"))


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain form of op10: every line that occurs more than once."""
    return linededup.occurrences(table(spark, sf_dir, "documents"))


def op11_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


def op12_window_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"near_texts": near_texts, "repeated_lines": repeated_lines}


def oracle_sql() -> dict[str, str]:
    return {"op5_licence_notices": licences.scan_sql(), "op9_tool_call_links": toolcalls.plain_sql(), "repeated_lines": linededup.occurrences_sql(), "op12_window_search": lexical.search_sql(), "op13_vector_codes": vectorcodes.encode_sql()}
