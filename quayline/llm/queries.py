"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from quayline.llm import (
    decontamination,
    html_text,
    jaccard,
    licenses,
    merkle,
    mixing,
    prefix_trie,
    quality,
    suffixes,
    token_codes,
    topk,
    toxicity,
    warc,
)
from quayline.llm.common import shared_path, table
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.captures(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.archive(rows, shared_path(spark, "warc")).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicated(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes.encode_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_warc_revisits, op2_toxicity, op3_exact_topk, op4_license_scan, op5_decontamination, op6_quality,
    op7_suffix_dedup, op8_jaccard_join, op9_source_mixing, op10_token_codes,
    op11_prefix_trie, op12_merkle_manifest, op13_html_text)}

# The others are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op1_warc_revisits": warc.oracle_sql(),
    "op3_exact_topk": topk.oracle_sql(),
    "op4_license_scan": licenses.oracle_sql(),
    "op9_source_mixing": mixing.oracle_sql(),
    "op11_prefix_trie": prefix_trie.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
}
