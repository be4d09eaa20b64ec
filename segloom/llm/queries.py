"""One query for each operator, over its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, lm, media, minhash, mixing, quality, sharding, suffix, warc
from .common import read


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read(spark, sf_dir, "conversations"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There is no table of images: every vector is drawn as a JPEG first."""
    return media.media_columns(media.with_pictures(read(spark, sf_dir, "embeddings")), "vec_id")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(read(spark, sf_dir, "documents"))


def op6_shard_by_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op7_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica with known damage."""
    return warc.audit(*warc.drill(read(spark, sf_dir, "pages")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(read(spark, sf_dir, "documents"))


def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_format_chats, op3_quality_classifier, op4_media_columns, op5_repeated_passages,
        op6_shard_by_differencing, op7_warc_fixity_audit, op8_decontaminate, op9_minhash_near_dedup, op10_context_mixing,
    )
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_format_chats": chat.ORACLE,
    "op7_warc_fixity_audit": warc.ORACLE,
}
