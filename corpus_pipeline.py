"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import bpe, decontaminate, language_id, line_dedup, simhash
from siltstone.llm.common import Scratch, table
from siltstone.scratch import temporary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds a fair share of the words, go."""
    return language_id.keep_identified(docs)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go, and documents that consist of them."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked fingerprints the one with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 13 consecutive words of a benchmark item go, and those that short items fill to a twentieth."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, with their digests and those of the decoded texts."""
    return bpe.bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", cut_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode),
]

#: SQL has no byte-pair encoding; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows. What a stage wrote for itself goes once its rows are stored."""
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            after = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            scratch.drop(last)
        docs = last = after
    return STAGES[-1][1](spark, docs, sf_dir)
