"""One query per operator of this subpackage, and SQL where it can say the same."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rebaja.llm import bpe_transducer, chat_views, filter_audit, license_scan, near_vectors, packing, pii, prefix_trie, simhash, source_mix, token_files, toxicity, vector_search


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op1_pii(spark: SparkSession, path: str) -> DataFrame:
    return pii.pii_digest(_table(spark, path, "documents"))


def op2_packing(spark: SparkSession, path: str) -> DataFrame:
    return packing.packing_pieces(_table(spark, path, "documents"))


def op3_near_vectors(spark: SparkSession, path: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, path, "embeddings"))


def op4_license_scan(spark: SparkSession, path: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, path, "documents"))


def op5_token_files(spark: SparkSession, path: str) -> DataFrame:
    return token_files.token_digest(_table(spark, path, "documents"))


def op6_toxicity(spark: SparkSession, path: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, path, "documents"), _table(spark, path, "labels"))


def op7_bpe_transducer(spark: SparkSession, path: str) -> DataFrame:
    return bpe_transducer.bpe_digest(_table(spark, path, "documents"))


def op8_simhash(spark: SparkSession, path: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, path, "documents"))


def op9_chat_views(spark: SparkSession, path: str) -> DataFrame:
    return chat_views.perspectives(_table(spark, path, "conversations"))


def op10_vector_search(spark: SparkSession, path: str) -> DataFrame:
    return vector_search.nearest(_table(spark, path, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_source_mix(spark: SparkSession, path: str) -> DataFrame:
    return source_mix.mix_digest(_table(spark, path, "documents"))


def op12_filter_audit(spark: SparkSession, path: str) -> DataFrame:
    return filter_audit.audit(_table(spark, path, "documents"), _table(spark, path, "labels"))


def op13_prefix_trie(spark: SparkSession, path: str) -> DataFrame:
    return prefix_trie.trie_digest(_table(spark, path, "conversations"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_packing, op3_near_vectors, op4_license_scan, op5_token_files, op6_toxicity, op7_bpe_transducer, op8_simhash, op9_chat_views, op10_vector_search, op11_source_mix, op12_filter_audit,
                                op13_prefix_trie)}
SQL = {"op1_pii": pii.SQL, "op4_license_scan": license_scan.SQL, "op9_chat_views": chat_views.SQL, "op12_filter_audit": filter_audit.SQL, "op13_prefix_trie": prefix_trie.SQL}
