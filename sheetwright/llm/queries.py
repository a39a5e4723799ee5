"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.llm import avi, markov, mixing, neardup, packing, pivots, quality, secrets, suffixes, warc
from sheetwright.llm.common import documents


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.revisit_digest(warc.resolve_revisits(spark, captures))


def op2_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, documents(spark, sf_dir))


def op3_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, documents(spark, sf_dir), sf_dir)


def op4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = mixing.mix_documents(spark, docs, quality.fit_quality(spark, docs, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op5_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.score_documents(spark, documents(spark, sf_dir))


def op6_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_digest(avi.text_media(documents(spark, sf_dir)))


def op8_hamming_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, documents(spark, sf_dir))


def op9_suffix_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeat_digest(suffixes.remove_repeats(spark, documents(spark, sf_dir)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (op1_revisit_resolution, op2_minimum_bin_slack, op3_subword_quality, op4_weighted_mix, op5_hidden_markov_lm, op6_pivot_permutation, op7_avi_motion_jpeg, op8_hamming_near_dup, op9_suffix_merge_dedup, op10_secret_scan)}
ORACLES: dict[str, str] = {"op1_revisit_resolution": warc.ORACLE}
