"""Levelled compaction: scores, job choice, inputs, and the garbage collection of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.mvcc import DELETE, MAX_SEQ, newest, skip_tombstones


def level_rollup(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))


def level_target(level, l1_bytes: int, multiplier: int):
    """Bytes a level may hold: l1_bytes for levels 0 and 1, then times ``multiplier`` per level."""
    return F.lit(float(l1_bytes)) * F.pow(F.lit(float(multiplier)), F.greatest(level, F.lit(1)) - 1)


def scores(files: DataFrame, l1_bytes: int, multiplier: int, l0_files: int = 4) -> DataFrame:
    """(level, score): files over l0_files for level 0, bytes over the target for others; due from 1 on."""
    level = F.col("level")
    score = F.when(level == 0, F.col("files") / float(l0_files)).otherwise(F.col("bytes") / level_target(level, l1_bytes, multiplier))
    return level_rollup(files).select("level", score.alias("score"))


def pick(scored: DataFrame, max_levels: int) -> DataFrame:
    """(level, target_level, score) of the most urgent level, the deepest of equal ones; the last level never."""
    due = scored.filter((F.col("score") >= 1) & (F.col("level") < max_levels - 1))
    return due.orderBy(F.desc("score"), F.desc("level")).limit(1).select("level", (F.col("level") + 1).alias("target_level"), "score")


def job_inputs(files: DataFrame, job: DataFrame) -> DataFrame:
    """(role, file_id): all files of level 0 or the file with the smallest key of another level, and what they overlap below.

    The job is one row and the key hull another, so both joins broadcast a single row.
    """
    job = F.broadcast(job.select(F.col("level").alias("from_level"), "target_level"))
    at_source = files.join(job, F.col("level") == F.col("from_level"))
    first = at_source.withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy("min_key", "file_id")))
    source = first.filter((F.col("level") == 0) | (F.col("rank") == 1))
    hull = source.agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"), F.first("target_level").alias("target"))
    below = files.join(F.broadcast(hull), (F.col("level") == F.col("target")) & (F.col("max_key") >= F.col("low")) & (F.col("min_key") <= F.col("high")))
    return source.select(F.lit("source").alias("role"), "file_id").unionByName(below.select(F.lit("target").alias("role"), "file_id"))


def may_drop_tombstones(files: DataFrame, inputs: DataFrame, target_level: int) -> bool:
    """Whether no file below the target overlaps the job's keys, so that its tombstones hide nothing."""
    hull = files.join(inputs.select("file_id"), "file_id", "left_semi").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    deeper = files.filter(F.col("level") > target_level).join(F.broadcast(hull), (F.col("max_key") >= F.col("low")) & (F.col("min_key") <= F.col("high")))
    return not deeper.take(1)


def collect_garbage(log: DataFrame, floor: int | None = None, drop_tombstones: bool = False) -> DataFrame:
    """The versions that some snapshot at or after ``floor`` can still see.

    All versions above the floor stay, and of each key the newest at or below it; if that one is
    a tombstone and ``drop_tombstones`` holds, it goes too. Without a floor (no snapshot is pinned)
    only the newest version of a key stays. Versions above the floor are not shuffled; of the others
    one row per key and task is.
    """
    if floor is None or floor >= MAX_SEQ:
        return collect_all_garbage(log, drop_tombstones)
    return log.filter(F.col("seq") > floor).unionByName(collect_all_garbage(log.filter(F.col("seq") <= floor), drop_tombstones))


def collect_all_garbage(log: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """``collect_garbage`` with no snapshot pinned: one row per key and task crosses the shuffle."""
    kept = newest(log).select(*log.columns)
    return skip_tombstones(kept) if drop_tombstones else kept


def statistics(before: DataFrame, after: DataFrame, size: str = "est_bytes") -> DataFrame:
    """(rows_in, rows_out, bytes_in, bytes_out) of a compaction; both sides are single rows."""
    total = lambda df, end: df.agg(F.count("*").alias(f"rows_{end}"), F.coalesce(F.sum(size), F.lit(0)).alias(f"bytes_{end}"))
    return total(before, "in").crossJoin(total(after, "out")).select("rows_in", "rows_out", "bytes_in", "bytes_out")
