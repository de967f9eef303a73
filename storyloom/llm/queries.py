"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import urlfilter


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_read(spark, sf_dir, "documents"), shards=24)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), shingle=3, percent=85)


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings"), least=0.95)


def op4_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .templates import main_text

    return main_text(_read(spark, sf_dir, "pages"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), size=4096, end_id=2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scores

    return scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), threshold=0.3)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import contamination, digest

    return digest(contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), window=10))


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_files

    return token_files(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=2).drop("ids")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(_read(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filtered(_read(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_minhash": op2_minhash,
    "op3_lattice": op3_lattice,
    "op4_templates": op4_templates,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_token_file": op8_token_file,
    "op9_language": op9_language,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {"op10_url_filter": urlfilter.SQL}
