"""The queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken

    return taken(mix(table(spark, sf_dir, "documents"))[1])


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import summary

    return summary(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract

    return extract(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op9_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pq import links

    return links(table(spark, sf_dir, "embeddings"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_mixing aims at: each source's size and target."""
    from .mixing import sized, targets

    sources = sized(table(spark, sf_dir, "documents")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return targets(sources, (5, 2, 1), 1.5, 2.0).select("source", "source_size", F.round("target", 3).alias("target"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if (k.startswith("op") or k == "mixing_targets") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.oracle_sql()
