"""From raw documents to a token mix, in stages that each read the last one's Parquet.

Quality rules and language identification drop what they reject, the n-gram join keeps one document of each group of
near copies (five words, similarity 0.8), mixing repeats documents to its sources' targets, and encoding gives the
number of tokens of every row of the mix with digests of its ids and decoded bytes.

All stages keep the columns of their input, whatever those are called, give an empty table for an empty one, and judge
whole texts of any length. Rows equal in id and text share a verdict; ids may repeat or be null.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageframe.llm import bpe, common, langid, mixing, ngram_join, quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that pass the quality rules, repeated ones each; null and empty texts go."""
    return common.keep(docs, quality.verdicts, F.col("kept"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in a learned language, repeated ones each; null texts and texts without a letter go. Without labelled rows all go."""
    return langid.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of linked texts, that of the smallest id; rows without id or without words stay."""
    return ngram_join.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, never or once or twice; null is a source of its own, texts without words go."""
    return mixing.repeated(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; null text counts as empty, other columns go."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("byte_bpe", byte_bpe),
]
#: Encoding and the fitted stages are beyond SQL. The tests follow the run with other code: SQL for the quality rules, all pairs
#: for near duplicates, words by source for the mix and the tiktoken library for encoding; languages are recounted from the weights.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written as Parquet in the shared folder and read by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
