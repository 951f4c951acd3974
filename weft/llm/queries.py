"""Queries opN_<name>: each operator on its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import ann_partitions, bpe, jaccard_join, langid_cnn, line_spread, mixing, quality_knn, quality_rules, warc_zip, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.size("draws").cast("long").alias("n_draws"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_table(spark, sf_dir, "pages"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_ann_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_partitions.search(_table(spark, sf_dir, "embeddings"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_langid_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_cnn.identify(_table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id", "n_links")


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.digests(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_source_mix, op2_html_extract, op3_quality_knn, op4_ann_partitions, op5_byte_bpe, op6_langid_cnn, op7_jaccard_join, op8_warc_zip, op9_quality_rules, op10_line_spread)}
ORACLES = {"op1_source_mix": mixing.ORACLE, "op10_line_spread": line_spread.ORACLE}
