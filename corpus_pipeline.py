"""The corpus pipeline: quality, language, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of documents; the last returns packed pieces.  Between stages the documents are written
as Parquet to the shared folder and read again, so a stage never repeats an earlier one's work.

Every stage decides rows, not ids: rows of a repeated or null doc_id are each decided by their own
text, and keep their columns, of whatever name.  Null and empty texts are scored like any other by
the quality stage, are no language and go at the language stage, have no near-duplicates, hold no
benchmark passage, and are packed as their end id.  Texts of any length are read whole.  Of rows
that tie or repeat one stays at the near-duplicate stage, unless they have no words.  An empty
table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from storyloom.llm import fmindex, langid, minhash, packing, quality
from storyloom.llm.cluster import staged


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the quality classifier accepts; it learns from the labelled rows not held out."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is near enough to some language's centroids; texts without letters go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the least doc_id, a null one last; texts without words stay."""
    return minhash.one_of_each(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages of the benchmark; one that was nothing else goes, one without words stays."""
    cut = fmindex.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 4096 ids; a null or empty text is its end id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=2)


STAGES = [
    ("quality", quality_filter),
    ("language", language_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Classifiers and linear programs are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
