"""Write-ahead log segments as a Spark data source: ``spark.read.format("siltstone_wal").load(folder)``.

A segment is a header and frames. A frame is CRC-32 and length of its payload (big-endian unsigned
32-bit each) and the payload: type (1 byte), seq (8), lengths of key and value (4 each; all ones for
null), key, value. A reader gives a row per frame with its place; behind a bad frame, whose row has
``bad`` set, a segment is not read on. Which bad frames end a replay is for operators.wal to say.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from siltstone.config import MIB, EngineConfig
from siltstone.errors import CorruptionError
from siltstone.operators.wal import removable_segments, replay
from siltstone.scratch import Scratch

HEADER = b"SLTWAL\x00\x01"
TYPES = ["PUT", "DELETE", "BATCH_START", "BATCH_END"]
SCHEMA = "segment string, pos bigint, frame bigint, rtype string, key binary, value binary, seq bigint, bad boolean"
#: Positions of one segment; its place in the order of segments counts beyond them.
SEGMENT_SPAN = 1 << 40
#: Bytes that are read at a time, and bytes of keys and values in one batch of rows.
BLOCK, BATCH_BYTES = 4 * MIB, 4 * MIB

_FRAME, _PAYLOAD, _NULL = struct.Struct(">II"), struct.Struct(">BqII"), 0xFFFFFFFF
_ARROW = pa.schema([("segment", pa.string()), ("pos", pa.int64()), ("frame", pa.int64()), ("rtype", pa.string()), ("key", pa.binary()), ("value", pa.binary()), ("seq", pa.int64()), ("bad", pa.bool_())])


def encode_frame(rtype: str, seq: int, key: bytes | None = None, value: bytes | None = None) -> bytes:
    """A frame. Puts and deletes need a key; only puts carry a value, which may be empty."""
    if rtype in TYPES[:2]:
        if not key:
            raise ValueError("a record needs a key that is not empty")
        if (value is None) == (rtype == "PUT"):
            raise ValueError("a put has a value and a delete has none")
    elif key is not None or value is not None:
        raise ValueError("a batch marker has neither key nor value")
    size = lambda x: _NULL if x is None else len(x)
    payload = _PAYLOAD.pack(TYPES.index(rtype), seq, size(key), size(value)) + (key or b"") + (value or b"")
    return _FRAME.pack(zlib.crc32(payload), len(payload)) + payload


def decode_frames(blocks: Iterator[bytes]) -> Iterator[tuple]:
    """(offset, rtype, key, value, seq, bad) per frame of a segment; the first bad one is the last.

    Holds a block and the frame that it breaks off in. A frame whose length runs past the file's end
    is bad, so a damaged length makes the rest of the segment be read, but not kept as frames.
    """
    held, at, more = b"", 0, True

    def fill(size: int) -> bool:
        nonlocal held, more
        parts, n = [held], len(held)
        while n < size and more:
            block = next(blocks, b"")
            more = bool(block)
            parts.append(block)
            n += len(block)
        held = b"".join(parts)
        return n >= size

    if not fill(len(HEADER)) or held[: len(HEADER)] != HEADER:
        raise CorruptionError("not a write-ahead log segment of this version")
    place = at = len(HEADER)
    while True:
        if len(held) - at < _FRAME.size:
            held, at = held[at:], 0
            if not fill(_FRAME.size):
                if held:
                    yield place, None, None, None, None, True
                return
        crc, size = _FRAME.unpack_from(held, at)
        end = at + _FRAME.size + size
        if len(held) < end:
            held, at, end = held[at:], 0, end - at
            fill(end)
        payload = held[at + _FRAME.size : end]
        row = _frame(place, payload) if len(payload) == size >= _PAYLOAD.size and zlib.crc32(payload) == crc else None
        if row is None:
            yield place, None, None, None, None, True
            return
        yield row
        at, place = end, place + _FRAME.size + size


def _frame(place: int, payload: bytes) -> tuple | None:
    kind, seq, k, v = _PAYLOAD.unpack_from(payload)
    end = _PAYLOAD.size + (0 if k == _NULL else k)
    key = None if k == _NULL else payload[_PAYLOAD.size : end]
    value = None if v == _NULL else payload[end : end + v]
    if kind >= len(TYPES) or end + len(value or b"") != len(payload):
        return None
    return place, TYPES[kind], key, value, seq, False


@dataclass
class Segment(InputPartition):
    path: str
    order: int


@dataclass
class Written(WriterCommitMessage):
    """Temporary names of a task's segments with their first sequence numbers and their order in the task."""

    names: list[tuple[str, int, int]]


class WalReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Segment]:
        return [Segment(name, i) for i, name in enumerate(segment_files(self.folder))] or [Segment("", 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.folder)
        name, rows, size = partition.path.rpartition("/")[2], [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.record_batch([pa.array(v, f.type) for v, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        with system.open_input_stream(partition.path, compression=None) as f:
            for frame, (at, rtype, key, value, seq, bad) in enumerate(decode_frames(iter(lambda: f.read(BLOCK), b""))):
                rows.append((name, partition.order * SEGMENT_SPAN + at, frame, rtype, key, value, seq, bad))
                size += 64 + len(key or b"") + len(value or b"")
                if size >= BATCH_BYTES:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class WalWriter(DataSourceArrowWriter):
    """Segments of bounded size, visible once the whole job has succeeded.

    A new one starts where the column ``segment`` changes and before a frame that would pass
    ``segment_bytes`` (a larger frame has a segment of its own).
    """

    def __init__(self, folder: str, segment_bytes: int):
        self.folder, self.segment_bytes = folder, segment_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = fs.FileSystem.from_uri(self.folder)
        names, out, size, group = [], None, 0, None
        for batch in iterator:
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("segment", "rtype", "seq", "key", "value"))
            for segment, rtype, seq, key, value in zip(*columns, strict=True):
                frame = encode_frame(rtype, seq, key, value)
                if out is not None and (segment != group or size + len(frame) > self.segment_bytes):
                    out.close()
                    out = None
                if out is None:
                    system.create_dir(folder, recursive=True)
                    names.append((f"{folder}/{uuid.uuid4().hex}.tmp", seq, len(names)))
                    out, size, group = system.open_output_stream(names[-1][0], compression=None), len(HEADER), segment
                    out.write(HEADER)
                out.write(frame)
                size += len(frame)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for name, first, number in m.names if m else ():
                system.move(name, f"{folder}/{first:020d}-{number:06d}-{uuid.uuid4().hex[:8]}.wal")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for name, _, _ in m.names if m else ():
                system.delete_file(name)


class WalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "siltstone_wal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WalReader:
        return WalReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> WalWriter:
        return WalWriter(self.options["path"], int(self.options.get("segmentBytes", EngineConfig().wal_segment_bytes)))


def segment_files(folder: str) -> list[str]:
    """Paths of the visible segments in their order."""
    system, path = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(".wal"))


def read_wal(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(WalSource)
    return spark.read.format("siltstone_wal").load(folder)


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """``read_wal`` written once to the shared folder, for what goes through the frames several times."""
    return Scratch(spark, "wal-frames").save(read_wal(spark, folder), "frames")


def recover(spark: SparkSession, folder: str, flushed: int = 0, policy: str = "LENIENT") -> DataFrame:
    """(key, seq, op, value) of the mutations in a log's segments that recovery applies (see operators.wal.replay)."""
    return replay(decoded(spark, folder), flushed, policy)


def write_wal(records: DataFrame, folder: str, segment: Column | None = None, segment_bytes: int = EngineConfig().wal_segment_bytes) -> None:
    """Append segments with records (rtype, seq, key, value), in the order of seq, each a range of it.

    Segments end at ``segment_bytes`` and, if ``segment`` is given, where it changes; it has to grow with seq.
    """
    records.sparkSession.dataSource.register(WalSource)
    rank = F.when(F.col("rtype") == "BATCH_START", 0).when(F.col("rtype") == "BATCH_END", 2).otherwise(1)
    group = (F.lit(None) if segment is None else segment).cast("string")
    ranged = records.select(group.alias("segment"), "rtype", "key", "value", "seq", rank.alias("__rank"), (F.lit(0) if segment is None else segment).alias("__group"))
    ranged = ranged.repartitionByRange("seq", "__rank") if segment is None else ranged.repartitionByRange("__group")
    ordered = ranged.sortWithinPartitions("__group", "seq", "__rank")
    none = "CAST(NULL AS BIGINT) AS"
    rows = ordered.selectExpr("segment", f"{none} pos", f"{none} frame", "rtype", "key", "value", "seq", "CAST(NULL AS BOOLEAN) AS bad")
    rows.write.format("siltstone_wal").option("segmentBytes", str(segment_bytes)).mode("append").save(folder)


def trim_wal(spark: SparkSession, folder: str, flushed: int) -> list[str]:
    """Delete the segments that hold nothing above ``flushed``, but never the last one; the names of those deleted."""
    system, path = fs.FileSystem.from_uri(folder)
    gone = sorted(r["segment"] for r in removable_segments(read_wal(spark, folder), flushed).collect())
    for name in gone:
        system.delete_file(f"{path}/{name}")
    return gone
