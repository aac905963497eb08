"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to the
shared folder and reads it back, so that a lost executor costs a part of one stage. All stages but
the last return the columns of `documents`. Repeated rows, NULLs, empty texts and empty tables are
treated as the operators' docstrings say; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontaminate, ngram_join, packing, quality, repeats
from wayfare.llm.common import table, tuned, written
from wayfare.llm.queries import END_OF_DOCUMENT_ID
from wayfare.llm.tokens import vocabulary


def _recounted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a risk-controlled cutoff go."""
    tuned(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-equal documents the one with the smallest id stays."""
    tuned(spark)
    return ngram_join.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that occur twice or more are cut out; documents stay, even if little is left."""
    tuned(spark)
    found = repeats.without_repeats(docs, found="__found")
    text = F.when(F.col("__found.was_text"), repeats.as_text("__found.kept"))
    return _recounted(found.withColumn("text", text).select(*docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly benchmark go."""
    tuned(spark)
    return _recounted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its training sequence."""
    tuned(spark)
    return packing.pack(docs, vocabulary(), end_id=END_OF_DOCUMENT_ID)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pack_sequences", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
