"""Queries over the given tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barline.llm import (byte_bpe, centroids, decontaminate, disclosure, fingerprints, hard_negatives, language, language_model, line_dedup,
                         near_dedup, suffix_dedup, token_files, warc)
from barline.session import prepare


def _prepared(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(prepare(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: _prepared(fn) for name, fn in {
        "op1_token_counts": token_files.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_benchmark_decontamination": decontaminate.query,
        "op4_document_fingerprints": fingerprints.query,
        "op5_line_dedup": line_dedup.query,
        "op6_language": language.query,
        "op7_warc": warc.query,
        "op8_language_model": language_model.query,
        "op9_byte_bpe": byte_bpe.query,
        "op10_near_dedup": near_dedup.query,
        "op11_centroid_clustering": centroids.query,
        "op12_hard_negatives": hard_negatives.query,
        "op13_disclosure": disclosure.query,
    }.items()}
ORACLES: dict[str, str] = {
    "op5_line_dedup": line_dedup.SQL,
    "op11_centroid_clustering": centroids.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_disclosure": disclosure.SQL,
}
