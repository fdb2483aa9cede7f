"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..sources.workers import find_package, spread
from . import ann, byte_bpe, chat, filter_audit, licenses, merkle, near_dedup, packing, pii, quality, sharding, topk, toxicity
from .storage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; Python workers on this machine find the package where it is."""
    return find_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(documents(spark, sf_dir), k=3, num=85, den=100)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=2)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(table(spark, sf_dir, "conversations"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.document_paths(documents(spark, sf_dir)), keep=["doc_id"])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = sharding.shard_table(table(spark, sf_dir, "documents"), f"{Scratch(spark, 'shards').base}/store", arrivals=16)
    return sharding.placement(store)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0", k=20, scale=64.0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(documents(spark, sf_dir))


QUERIES = (
    op1_near_dedup, op2_packing, op3_byte_bpe, op4_chat, op5_ann, op6_toxicity, op7_quality, op8_licenses, op9_pii, op10_sharding,
    op11_topk, op12_filter_audit, op13_merkle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat": chat.chat_sql(),
        "op7_quality": quality.quality_sql(),
        "op8_licenses": licenses.document_sql(),
        "op11_topk": topk.search_sql(),
        "op12_filter_audit": filter_audit.audit_sql(),
        "op13_merkle": merkle.verify_sql(levels=8),
    }
