"""Sorted runs: assignment, statistics, blocks, sparse indexes and bloom filters."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.keys import bloom_fpr, bloom_positions, entry_size
from siltstone.scratch import Scratch


def assign_runs(log: DataFrame, rows_per_run: int) -> DataFrame:
    """Adds run_id, level 0 and file_id: runs of equal numbers of sequence numbers."""
    run = F.floor((F.col("seq") - 1) / rows_per_run).cast("bigint")
    return log.withColumn("run_id", run).withColumn("level", F.lit(0)).withColumn("file_id", F.concat(F.lit("L0-"), F.col("run_id").cast("string")))


def rotate_by_bytes(sized: DataFrame, memtable_bytes: int) -> DataFrame:
    """Adds run_id: a run ends with the entry by which the bytes of all entries so far (est_bytes, in the order
    of seq) pass a multiple of ``memtable_bytes``.

    Running sums over ranges of seq, offset by the sums of earlier ranges; only those reach the driver.
    A store that starts counting anew at each rotation makes runs longer by the last entry's overshoot.
    """
    scratch = Scratch(sized.sparkSession, "rotation")
    dealt = scratch.save(sized.repartitionByRange("seq").withColumn("__part", F.spark_partition_id()), "dealt")
    totals = sorted(tuple(r) for r in dealt.groupBy("__part").agg(F.sum("est_bytes")).collect())
    before = [(part, end - n) for (part, n), end in zip(totals, accumulate(n for _, n in totals), strict=True)]
    offsets = sized.sparkSession.createDataFrame(before, "__part int, __before bigint")
    so_far = Window.partitionBy("__part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("__before") + F.coalesce(F.sum("est_bytes").over(so_far), F.lit(0))
    return dealt.join(F.broadcast(offsets), "__part").withColumn("run_id", F.floor(earlier / memtable_bytes).cast("bigint")).drop("__part", "__before")


def sorted_runs(runs: DataFrame) -> DataFrame:
    """Adds the position (from 1) of each row in its run, by key and falling seq. A run is one task's rows."""
    return runs.withColumn("pos", F.row_number().over(Window.partitionBy("file_id").orderBy("key", F.desc("seq"))).cast("bigint"))


def with_sizes(log: DataFrame, key_bytes: int | None = None, value_bytes: int | None = None) -> DataFrame:
    """Adds est_bytes. Fixed widths may be given; else byte lengths are measured."""
    key = key_bytes if key_bytes is not None else F.octet_length("key")
    value = F.when(F.col("value").isNotNull(), F.lit(value_bytes)) if value_bytes is not None else F.octet_length("value")
    return log.withColumn("est_bytes", entry_size(key, value))


def run_statistics(runs: DataFrame) -> DataFrame:
    """(file_id, level, min_key, max_key, entry_count, min_seq, max_seq) per run."""
    return runs.groupBy("file_id", "level").agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entry_count"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")
    )


def with_blocks(runs: DataFrame, keys_per_block: int) -> DataFrame:
    """Adds the block of each row: so many distinct keys per block, versions of a key together."""
    rank = F.dense_rank().over(Window.partitionBy("file_id").orderBy("key"))
    return runs.withColumn("block", F.floor((rank - 1) / keys_per_block).cast("bigint"))


def block_layout(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("file_id", "block").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("versions"))


def sparse_index(blocks: DataFrame) -> DataFrame:
    """(file_id, block, first_key, n): the first key of each block and its number of keys."""
    return blocks.groupBy("file_id", "block").agg(F.min("key").alias("first_key"), F.countDistinct("key").alias("n"))


def floor_blocks(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(file_id, key, block) for keys of (file_id, key): the last block whose first key is not larger; block 0
    for smaller keys.

    An as-of lookup: keys and first keys form one ordered sequence per file, in which each key
    takes the last block seen. No key is compared with every block.
    """
    marks = index.select("file_id", F.col("first_key").alias("key"), "block")
    both = marks.withColumn("asks", F.lit(False)).unionByName(keys.select("file_id", "key", F.lit(None).cast("bigint").alias("block"), F.lit(True).alias("asks")))
    seen = Window.partitionBy("file_id").orderBy("key", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("block", F.coalesce(F.last("block", ignorenulls=True).over(seen), F.lit(0))).filter("asks").select("file_id", "key", "block")


def bloom_words(runs: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(file_id, word, bits): a bloom filter per file as 64-bit words."""
    spots = runs.select("file_id", "key").distinct().select("file_id", F.explode(bloom_positions(F.col("key"), bits, hashes)).alias("at"))
    return spots.groupBy("file_id", F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("bits"))


def bloom_probe(keys: DataFrame, words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(file_id, key, maybe) for keys of (file_id, key): whether all bits of the key are set."""
    spots = keys.select("file_id", "key", F.explode(bloom_positions(F.col("key"), bits, hashes)).alias("at"))
    spots = spots.select("file_id", "key", F.expr("at div 64").alias("word"), F.expr("CAST(at % 64 AS INT)").alias("bit"))
    hit = F.coalesce(F.expr("getbit(bits, bit)") == 1, F.lit(False))
    return spots.join(words, ["file_id", "word"], "left").groupBy("file_id", "key").agg(F.bool_and(hit).alias("maybe"))


def bloom_rates(runs: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(file_id, n, fpr): distinct keys and the expected false-positive rate."""
    counted = runs.groupBy("file_id").agg(F.countDistinct("key").alias("n"))
    return counted.withColumn("fpr", F.round(bloom_fpr(F.col("n"), bits, hashes), 9))


def files_for_key(files: DataFrame, key) -> DataFrame:
    return files.filter((F.col("min_key") <= F.lit(key)) & (F.col("max_key") >= F.lit(key)))


def overlapping(files: DataFrame, low, high) -> DataFrame:
    """Files whose closed key range meets [low, high]."""
    return files.filter((F.col("max_key") >= F.lit(low)) & (F.col("min_key") <= F.lit(high)))
