"""Global positions without a global sort in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.scratch import Scratch

#: Rows of one range that a row number has bits for.
_ROW_BITS = 33


def numbered(dealt: DataFrame, scratch: Scratch, name: str, base: int = 0) -> DataFrame:
    """Adds ``name`` = base + 1, base + 2, ... along partitions that hold ascending ranges, each in order.

    The rows are written once with a number within their partition, so a source that gives other rows
    when it is read again does no harm. Only the partitions' sizes reach the driver.
    """
    mark = scratch.save(dealt.withColumn("__at", F.monotonically_increasing_id()), "dealt")
    part = F.shiftright("__at", _ROW_BITS)
    sizes = sorted(tuple(r) for r in mark.groupBy(part.alias("part")).agg(F.count("*")).collect())
    if len(sizes) <= 1:
        return mark.withColumn(name, F.col("__at") - ((sizes[0][0] if sizes else 0) << _ROW_BITS) + (base + 1)).drop("__at")
    before = [(number, base + end - n) for (number, n), end in zip(sizes, accumulate(n for _, n in sizes), strict=True)]
    offsets = dealt.sparkSession.createDataFrame(before, "__part bigint, __before bigint")
    placed = mark.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1).drop("__part", "__before", "__at")


def with_position(df: DataFrame, by: str, *ties: Column, name: str = "pos", base: int = 0, parts: int | None = None) -> DataFrame:
    """Adds the position (1-based, plus ``base``) in the order of ``by`` (nulls first), then ``ties``.

    Rows are shuffled once, to ranges of all order columns, so a frequent value of ``by`` spreads over
    ranges of the ties; each range is sorted and numbered on its own. ``parts``: ranges, by default
    spark.sql.shuffle.partitions. The rows are written to the shared folder.
    """
    order = [F.col(by).asc_nulls_first(), *ties]
    ranges = df.coalesce(1) if parts == 1 else df.repartitionByRange(*([parts] if parts else []), *order)
    return numbered(ranges.sortWithinPartitions(*order), Scratch(df.sparkSession, "order"), name, base)


def next_sequences(rows: DataFrame, base: int, by: str, *ties: Column, parts: int | None = None) -> DataFrame:
    """Adds seq = base + position for a batch of mutations in the order of ``by``."""
    return with_position(rows, by, *ties, name="seq", base=base, parts=parts)
