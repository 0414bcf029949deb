"""Helpers shared by the training-data operators: tables, document keys, scratch tables and Arrow row blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.scratch import Scratch, clear_scratch, shared_dir

__all__ = ["BLOCK_CHARS", "KEY", "Scratch", "clear_scratch", "document_key", "row_blocks", "shared_dir", "table", "text_blocks"]

#: Characters of text that a worker turns into arrays at a time.
BLOCK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEY = ["rid", "text_key", "text_key2"]


def document_key(id_col: str, text_col: str) -> list[Column]:
    """A row's key: its id (the largest bigint where it is null) and 128 bits of its text. Equal rows share it."""
    text = F.col(f"`{text_col}`")
    return [F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit((1 << 63) - 1)).alias("rid"), F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(1), text).alias("text_key2")]


def row_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches whose texts hold about ``limit`` bytes."""
    for batch in batches:
        start = size = 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            size += n or 0
            if size >= limit:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """``row_blocks`` with the texts as Python strings."""
    for part in row_blocks(batches, column, limit):
        yield part, part.column(column).to_pylist()
