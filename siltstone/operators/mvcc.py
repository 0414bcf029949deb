"""Version resolution on mutation logs (key, seq, op, value, ...).

The bound on seq goes before resolution and the tombstone test after it, always.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.functions.keys import after_prefix, in_range

PUT, DELETE = "PUT", "DELETE"
#: The snapshot bound that no snapshot sets.
MAX_SEQ = (1 << 63) - 1

_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)


def as_of(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The log as a snapshot at ``seq`` sees it."""
    return log if seq is None else log.filter(F.col("seq") <= seq)


def newest(log: DataFrame) -> DataFrame:
    """The row with the largest seq of each key, tombstones included.

    With fixed-width values this is a hash aggregate; else a ranked window whose limit already
    applies before the shuffle. Either way a key with very many versions sends one row per task.
    """
    kinds = {f.name: f.dataType for f in log.schema}
    if set(kinds) == {"key", "seq", "op", "value"} and isinstance(kinds["value"], _FIXED):
        return log.groupBy("key").agg(
            F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.max_by(F.col("op") == PUT, "seq").alias("put")
        ).select("key", "seq", F.when(F.col("put"), PUT).otherwise(DELETE).alias("op"), "value")
    ranked = log.withColumn("__rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq"))))
    return ranked.filter(F.col("__rank") == 1).drop("__rank")


def skip_tombstones(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("op") == PUT)


def visible(log: DataFrame, seq: int | None = None) -> DataFrame:
    """The live state: the newest put of each key that no later delete hides."""
    return skip_tombstones(newest(as_of(log, seq)))


def get(log: DataFrame, key, seq: int | None = None) -> DataFrame:
    """(key, value) of one key, or nothing. The key reaches the scan as a filter."""
    found = as_of(log.filter(F.col("key") == F.lit(key)), seq).orderBy(F.desc("seq")).limit(1)
    return skip_tombstones(found).select("key", "value")


def multi_get(log: DataFrame, keys: DataFrame, seq: int | None = None) -> DataFrame:
    """(key, value) of the keys in ``keys`` that are live: a semi join below resolution."""
    return visible(as_of(log, seq).join(keys.select("key"), "key", "left_semi")).select("key", "value")


def scan(log: DataFrame, start=None, end=None, seq: int | None = None) -> DataFrame:
    """(key, value, seq) of live keys with start <= key < end; None leaves a side open.

    An inverted range is empty. Add ``orderBy("key")`` for an ordered cursor.
    """
    return visible(as_of(log.filter(in_range(F.col("key"), start, end)), seq)).select("key", "value", "seq")


def scan_prefix(log: DataFrame, prefix: str | bytes, seq: int | None = None) -> DataFrame:
    """Live keys that start with ``prefix``, as a half-open range that the scan can skip by."""
    return scan(log, prefix, after_prefix(prefix), seq)


def versions(log: DataFrame, start=None, end=None, seq: int | None = None) -> DataFrame:
    """All versions in a key range up to ``seq``, unresolved."""
    return as_of(log.filter(in_range(F.col("key"), start, end)), seq)


def merge(*runs: DataFrame) -> DataFrame:
    """Rows of all runs; equal (key, seq) from an overlapping flush or replay count once."""
    return reduce(lambda a, b: a.unionByName(b), runs).dropDuplicates(["key", "seq"])


def version_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count("*").alias("n"))


def tombstone_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("key").agg(F.count_if(F.col("op") == DELETE).alias("n"))


def overwrites(log: DataFrame) -> DataFrame:
    """(key, versions, value): keys with two puts or more, and their last value (null if deleted since)."""
    return log.groupBy("key").agg(F.count_if(F.col("op") == PUT).alias("versions"), F.max_by("value", "seq").alias("value")).filter("versions >= 2")
