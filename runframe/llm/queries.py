"""Registered queries of this subpackage, each over its whole tables, and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from runframe.llm import (
    brown, decontaminate, licenses, line_dedup, multi_index, ngram_join, packing, ranking, resample, sampling, suffixes, tokenfile, toxicity)
from runframe.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_class_model(spark: SparkSession, folder: str) -> DataFrame:
    return brown.score_report(table(spark, folder, "documents"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeat_report(table(spark, folder, "documents"))


def op5_sampled_segmentations(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.segmentation_report(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_report(table(spark, folder, "documents"))


def op8_token_file(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfile.token_file_report(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, folder, "embeddings"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, folder, "documents"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.search_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_class_model, op2_line_dedup, op3_toxicity, op4_repeated_bytes, op5_sampled_segmentations, op6_decontamination,
        op7_license_scan, op8_token_file, op9_near_vectors, op10_ngram_join, op11_ranked_search, op12_packing, op13_resample)
}
ORACLES: dict[str, str] = {
    "op6_decontamination": decontaminate.SQL,
    "op9_near_vectors": multi_index.SQL,
    "op10_ngram_join": ngram_join.SQL,
    "op11_ranked_search": ranking.SQL,
    "op13_resample": resample.SQL,
}
