"""The registered queries of the training-data operators.

Each reads its whole table with production parameters. Oracle SQL is given
where DuckDB can express the whole result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, html_text, infill, minhash, neighbours, packing, pii, quality, secrets,
               substring, toxicity, trie, warc)
from .common import table


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.op9(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op6(table(spark, sf_dir, "documents"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1(table(spark, sf_dir, "pages"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op2(table(spark, sf_dir, "pages"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op5(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op7(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op4(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op11(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.op12(table(spark, sf_dir, "documents"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.op13(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_html": op2_html,
    "op3_packing": op3_packing,
    "op4_pii": op4_pii,
    "op5_substring": op5_substring,
    "op6_secrets": op6_secrets,
    "op7_neighbours": op7_neighbours,
    "op8_decontamination": op8_decontamination,
    "op9_minhash": op9_minhash,
    "op10_toxicity": op10_toxicity,
    "op11_quality": op11_quality,
    "op12_infill": op12_infill,
    "op13_trie": op13_trie,
}

SQL: dict[str, str] = {
    "op12_infill": infill.OP12_SQL,
    "op13_trie": trie.OP13_SQL,
}
