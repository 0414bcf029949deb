"""Manifest logs (pos, rtype, level, file_id, sequence, tx_id, remove_files, add_files): replay and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.mvcc import MAX_SEQ

ADD, REMOVE, FLUSHED, TX_START, TX_END = "ADD_SSTABLE", "REMOVE_SSTABLE", "SET_FLUSHED_SEQ", "COMPACTION_START", "COMPACTION_END"


def live_files(manifest: DataFrame) -> DataFrame:
    """(level, file_id) whose last record adds them."""
    acts = manifest.filter(F.col("rtype").isin(ADD, REMOVE))
    last = acts.groupBy("level", "file_id").agg(F.max_by(F.col("rtype") == ADD, "pos").alias("there"))
    return last.filter("there").select("level", "file_id")


def roll_back(manifest: DataFrame) -> DataFrame:
    """The manifest with the inverse of every compaction that started and did not end, behind all records."""
    starts = manifest.filter(F.col("rtype") == TX_START)
    open_ = starts.join(manifest.filter(F.col("rtype") == TX_END).select("tx_id"), "tx_id", "left_anti")
    undo = lambda files, rtype: open_.select(F.explode(files).alias("f")).select(F.lit(MAX_SEQ).alias("pos"), F.lit(rtype).alias("rtype"), F.col("f.level").alias("level"), F.col("f.file_id").alias("file_id"))
    return manifest.unionByName(undo("add_files", REMOVE), allowMissingColumns=True).unionByName(undo("remove_files", ADD), allowMissingColumns=True)


def flushed_sequence(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("rtype") == FLUSHED).agg(F.coalesce(F.max("sequence"), F.lit(0)).cast("bigint").alias("flushed_seq"))


def missing_files(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Files that the manifest names and the listing lacks."""
    return files.select("file_id").join(listing.select("file_id"), "file_id", "left_anti")


def oldest_snapshot(pins: DataFrame) -> DataFrame:
    """(oldest, active) of pins (seq, n): the smallest pinned sequence number, the largest bigint if none, and the pins."""
    return pins.filter("n > 0").agg(F.coalesce(F.min("seq"), F.lit(MAX_SEQ)).alias("oldest"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("active"))
