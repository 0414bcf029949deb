"""The registered queries opN_<name>: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import ann, bpe, decontaminate, language_id, license_scan, line_dedup, simhash, token_store, transcripts, warc
from siltstone.llm.common import Scratch, table
from siltstone.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.detect_languages(docs, language_id.fit(docs))


def op2_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))[1]


def op9_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = Scratch(spark, "transcripts").save(transcripts.write_transcripts(table(spark, sf_dir, "conversations")), "written")
    return transcripts.parse_transcripts(written, transcripts.fit(written))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_mixture": op1_language_mixture,
    "op2_simhash_components": op2_simhash_components,
    "op3_bpe_roundtrip": op3_bpe_roundtrip,
    "op4_nearest_vectors": op4_nearest_vectors,
    "op5_license_scan": op5_license_scan,
    "op6_line_runs": op6_line_runs,
    "op7_token_store": op7_token_store,
    "op8_warc_archive": op8_warc_archive,
    "op9_transcript_roles": op9_transcript_roles,
    "op10_decontamination": op10_decontamination,
}
