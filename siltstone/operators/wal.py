"""Write-ahead logs as tables (segment, pos, rtype, key, value, seq, bad): batches, replay, retention.

Positions grow from segment to segment; a segment is one file of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.errors import CorruptionError

START, END = "BATCH_START", "BATCH_END"


def resolve_batches(wal: DataFrame) -> DataFrame:
    """Puts and deletes outside batches and in batches that end; a stray end does no harm.

    A record is lost if the last marker before it is a start and the next one behind it is not an
    end. Both are looked up among the frames of its own segment; where that has none on a side, the
    nearest marker of other segments counts, which comes from a row per segment. So a task holds one
    segment's frames, and a batch may span any number of segments.
    """
    mark = F.when(F.col("rtype").isin(START, END), F.col("rtype"))
    marks = F.when(mark.isNotNull(), F.col("pos"))
    ends = wal.groupBy("segment").agg(F.min("pos").alias("low"), F.min_by("rtype", marks).alias("first_mark"), F.max_by("rtype", marks).alias("last_mark"))
    # what comes is what came before in descending order: a frame up to the end would be read anew for every row
    nearest = lambda c, of, order: F.last(c, ignorenulls=True).over(of.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    a_row_per_segment, own = Window.partitionBy(F.lit(0)), Window.partitionBy("segment")
    around = ends.select("segment", nearest("last_mark", a_row_per_segment, F.asc("low")).alias("carried"), nearest("first_mark", a_row_per_segment, F.desc("low")).alias("coming"))
    frames = wal.withColumn("__before", nearest(mark, own, F.asc("pos"))).withColumn("__after", nearest(mark, own, F.desc("pos")))
    frames = frames.filter(F.col("rtype").isin("PUT", "DELETE")).join(around, "segment", "left")
    before, after = F.coalesce("__before", "carried"), F.coalesce("__after", "coming")
    return frames.filter(before.isNull() | (before == END) | F.coalesce(after == END, F.lit(False))).drop("__before", "__after", "carried", "coming")


def readable(wal: DataFrame) -> DataFrame:
    """Frames before the first bad one in any segment: what a lenient reader sees."""
    first = wal.filter("bad").agg(F.min("pos").alias("first_bad"))
    return wal.crossJoin(F.broadcast(first)).filter("first_bad IS NULL OR pos < first_bad").drop("first_bad")


def replay(wal: DataFrame, flushed: int = 0, policy: str = "LENIENT") -> DataFrame:
    """(key, seq, op, value) of the mutations that recovery applies.

    Frames up to ``flushed`` are skipped before batches are resolved, markers too: members of a
    batch whose start was flushed count as unbatched. STRICT raises on a bad frame, LENIENT stops
    at the first one.
    """
    if policy == "STRICT":
        if bad := bad_frames(wal).first()["bad_frames"]:
            raise CorruptionError(f"{bad} bad frames in the write-ahead log")
    else:
        wal = readable(wal)
    return resolve_batches(wal.filter(F.col("seq") > flushed)).select("key", "seq", F.col("rtype").alias("op"), "value")


def bad_frames(wal: DataFrame) -> DataFrame:
    return wal.agg(F.count_if("bad").alias("bad_frames"))


def bad_frames_by_segment(wal: DataFrame) -> DataFrame:
    """(segment, bad, good) per segment."""
    return wal.groupBy("segment").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good"))


def segments(wal: DataFrame) -> DataFrame:
    """(segment, min_seq, max_seq, records) per segment."""
    return wal.groupBy("segment").agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("seq").alias("records"))


def unflushed_segments(wal: DataFrame, flushed: int) -> DataFrame:
    return segments(wal).filter(F.col("max_seq") > flushed).select("segment")


def removable_segments(wal: DataFrame, flushed: int) -> DataFrame:
    """Segments that hold nothing unflushed, without the active (last) one."""
    seen = segments(wal)
    last = seen.agg(F.max("segment").alias("active"))
    return seen.crossJoin(F.broadcast(last)).filter((F.col("segment") < F.col("active")) & (F.col("max_seq") <= flushed)).select("segment")


def recovered_sequence(wal: DataFrame, flushed: int, policy: str = "LENIENT") -> DataFrame:
    """(recovered_seq): the largest applied sequence number, ``flushed`` at least."""
    return replay(wal, flushed, policy).agg(F.greatest(F.lit(flushed), F.coalesce(F.max("seq"), F.lit(0))).cast("bigint").alias("recovered_seq"))
