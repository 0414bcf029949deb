"""A versioned table on disk: Parquet runs and one manifest file per commit.

Readers need no lock: a commit is one new file ``_manifest/<version>.json`` that names what it adds and
removes. Data files are written first and count only from the commit on; ``vacuum`` removes others.
Every CHECKPOINT_EVERY commits the whole state is written beside them, so opening reads few files.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from collections import Counter
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.config import EngineConfig
from siltstone.errors import ClosedError, ConflictError, LockError, RecoveryError
from siltstone.functions.keys import RECORD_OVERHEAD, after_prefix
from siltstone.operators import compaction, mvcc
from siltstone.operators.cache import RunCache
from siltstone.operators.metrics import Metrics
from siltstone.operators.order import next_sequences
from siltstone.scratch import Scratch

CHECKPOINT_EVERY = 32
TRIES = 8


def log_schema(key: T.DataType, value: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("key", key, False), T.StructField("value", value), T.StructField("seq", T.LongType(), False), T.StructField("op", T.StringType(), False)])


@dataclass
class State:
    """What the commits up to ``version`` add up to."""

    version: int = 0
    last_seq: int = 0
    files: dict[str, dict] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Snapshot:
    """A pinned sequence number; closing it twice does no harm, reading through it afterwards fails."""

    def __init__(self, table: Table, seq: int):
        self._table, self._seq, self.closed = table, seq, False

    @property
    def seq(self) -> int:
        if self.closed:
            raise ClosedError("the snapshot is closed")
        return self._seq

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self._table._unpin(self._seq)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Table:
    """put, delete, apply_batch, get, scan, snapshot, compact and vacuum on one keyspace.

    Any number of writers may commit; ``exclusive`` refuses to open a table that another opener holds
    exclusively (LockError) and holds it until ``close``.
    """

    def __init__(self, spark: SparkSession, path: str, key: T.DataType | None = None, value: T.DataType | None = None, config: EngineConfig | None = None, exclusive: bool = False):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or EngineConfig()
        self.schema = log_schema(key or T.StringType(), value or T.StringType())
        self.metrics = Metrics()
        self._pins: Counter[int] = Counter()
        self._open = True
        jvm = spark._jvm
        self._paths = jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._paths(f"{self.path}/_manifest"))
        self._lock = self._paths(f"{self.path}/_lock") if exclusive else None
        if exclusive and not self._put_if_absent(self._lock, json.dumps({"pid": os.getpid(), "time": int(time.time())}).encode()):
            self._lock = None
            raise LockError(f"{self.path} is held by another opener; remove _lock if that one is gone")
        self.cache = RunCache(spark, self.config.cache_bytes, self.config.cache_shards)
        self._known = self._newest_checkpoint()
        self._written = 0
        self.state()
        gauges = {
            "memtable.bytes": lambda: self._written,
            "sstables.l0": self.l0_files,
            "snapshots.active": lambda: sum(self._pins.values()),
            "cache.bytes": lambda: self.cache.bytes,
            "cache.hit_ratio": lambda: self.cache.ratio,
            "cache.hits": lambda: self.cache.hits,
            "cache.misses": lambda: self.cache.misses,
        } | {name: lambda name=name: self.metrics.counters.get(name, 0) for name in ("compactions.completed", "compaction.bytes.read", "compaction.bytes.written")}
        for name, read in gauges.items():
            self.metrics.gauge(name, read)

    # -- manifest ---------------------------------------------------------------------------------

    def _commit_path(self, version: int):
        return self._paths(f"{self.path}/_manifest/{version:020d}.json")

    def _read(self, place) -> dict:
        stream = self._fs.open(place)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _newest_checkpoint(self) -> State:
        """The state of the newest checkpoint, or of no commit."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._paths(f"{self.path}/_manifest"))]
        found = max((n for n in names if n.endswith(".checkpoint")), default=None)
        return State(**self._read(self._paths(f"{self.path}/_manifest/{found}"))) if found else State()

    def state(self) -> State:
        """The newest state: commits that appeared since the last look are added."""
        if not self._open:
            raise ClosedError("the table is closed")
        known = self._known
        if self._fs.exists(self._commit_path(known.version + 1)):
            known = State(known.version, known.last_seq, dict(known.files), dict(known.batches))
            while self._fs.exists(place := self._commit_path(known.version + 1)):
                commit = self._read(place)
                for path in commit["remove"]:
                    known.files.pop(path, None)
                known.files.update((f["path"], f) for f in commit["add"])
                if commit.get("app"):
                    known.batches[commit["app"]] = commit["batch"]
                known.version, known.last_seq = commit["version"], max(known.last_seq, commit["last_seq"])
            self._known = known
        return known

    def l0_files(self) -> int:
        return sum(f["level"] == 0 for f in self._known.files.values())

    def _put_if_absent(self, place, body: bytes) -> bool:
        """Make a file of which no part is ever seen and that replaces none; False if there is one.

        A local file is linked into place and HDFS renames, both of which refuse an existing name; S3A
        creates conditionally. Other stores must refuse such a rename too to be safe for several writers.
        """
        scheme = self._fs.getUri().getScheme()
        if scheme == "s3a":
            try:
                out = self._fs.createFile(place).overwrite(False).must("fs.option.create.conditional.overwrite", "true").build()
                out.write(bytearray(body))
                out.close()
            except Py4JJavaError as e:
                if self._fs.exists(place):
                    return False
                raise e
            return True
        temporary = self._paths(f"{place.getParent()}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temporary, False)
        out.write(bytearray(body))
        out.close()
        try:
            if scheme == "file":
                try:
                    os.link(temporary.toUri().getPath(), place.toUri().getPath())
                    return True
                except FileExistsError:
                    return False
            return not self._fs.exists(place) and self._fs.rename(temporary, place)
        finally:
            self._fs.delete(temporary, False)

    def _commit(self, version: int, **what) -> bool:
        """Put commit ``version`` in place; False if another writer was first."""
        if not self._put_if_absent(self._commit_path(version), json.dumps({"version": version, "time": int(time.time() * 1000)} | what).encode()):
            return False
        state = self.state()
        if version % CHECKPOINT_EVERY == 0 and state.version == version:
            body = json.dumps({"version": version, "last_seq": state.last_seq, "files": state.files, "batches": state.batches}).encode()
            self._put_if_absent(self._paths(f"{self.path}/_manifest/{version:020d}.checkpoint"), body)
        return True

    # -- writes -----------------------------------------------------------------------------------

    def _parts(self, size: int) -> int:
        return max(1, math.ceil(size / self.config.target_file_bytes))

    def _write_run(self, rows: DataFrame, level: int, parts: int) -> list[dict]:
        """Write sorted Parquet files by ranges of key and seq; a manifest entry for each, from the files' statistics.

        Files have about target_file_bytes; the versions of a frequent key spread over several. One
        part needs no shuffle.
        """
        folder, order = f"{self.path}/data/{uuid.uuid4().hex}", [F.col("key"), F.desc("seq")]
        rows = rows.select("key", "value", "seq", "op")
        ordered = (rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, *order)).sortWithinPartitions(*order)
        ordered.write.options(**self.config.spark_write_options()).parquet(folder)
        seen = self.spark.read.schema(self.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        stats = seen.agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.count("*").alias("rows"), F.count_if(F.col("op") == mvcc.DELETE).alias("deletes"))
        out = []
        for r in stats.collect():
            entry = r.asDict() | {"level": level}
            for side in ("min_key", "max_key"):
                entry[side] = {"hex": bytes(r[side]).hex()} if isinstance(r[side], bytes | bytearray) else r[side]
            out.append(entry)
        return out

    def apply_batch(self, mutations: DataFrame, order: str | None = None, app: str | None = None, batch: int | None = None, sync: bool = True) -> int:
        """Commit mutations (key, op, value) as one; the new last sequence number.

        Rows get sequence numbers in the order of the column ``order`` (of ``key`` without one), ties
        by op with deletes last, then by value. Null and empty keys, puts without and deletes with a value are
        refused before a number is taken. With ``app`` and ``batch`` a batch that is already in
        is skipped, so a repeated stream batch changes nothing. ``sync`` is accepted for compatibility:
        every commit is durable before this returns.
        """
        key = F.col("key")
        empty = (F.octet_length(key) == 0) if isinstance(self.schema["key"].dataType, T.StringType | T.BinaryType) else F.lit(False)
        wrong = key.isNull() | empty | ~F.coalesce(F.col("op").isin(mvcc.PUT, mvcc.DELETE), F.lit(False)) | (F.col("value").isNull() == (F.col("op") == mvcc.PUT))
        checked = mutations.filter(F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.lit("a mutation needs a key, an operation, and a value exactly if it is a put")).isNull()).otherwise(F.lit(True)))
        kind = {c: self.schema[c].dataType for c in ("key", "value")}
        # written once: a source that gives other rows when it is read again is read once
        scratch = Scratch(self.spark, "batch")
        staged = scratch.save(checked.select(F.col("key").cast(kind["key"]).alias("key"), F.col("value").cast(kind["value"]).alias("value"), "op", F.col(order or "key").alias("__order")), "mutations")
        self._written = self._fs.getContentSummary(self._paths(staged.scratch_path)).getLength()
        parts = self._parts(self._written)
        try:
            for _ in range(TRIES):
                state = self.state()
                if app is not None and state.batches.get(app, -1) >= batch:
                    return state.last_seq
                rows = next_sequences(staged, state.last_seq, "__order", F.desc("op"), F.col("value"), parts=parts)
                added = self._write_run(rows, 0, parts)
                last = max([state.last_seq, *(f["max_seq"] for f in added)])
                if self._commit(state.version + 1, add=added, remove=[], last_seq=last, app=app, batch=batch):
                    self.metrics.count("writes.total", sum(f["rows"] for f in added))
                    self.metrics.count("deletes.total", sum(f["deletes"] for f in added))
                    return self.state().last_seq
        finally:
            self._written = 0
            scratch.clear()
        raise ConflictError(f"{TRIES} other commits came first")

    def put(self, rows: DataFrame, order: str | None = None, sync: bool = True) -> int:
        """Commit puts (key, value)."""
        return self.apply_batch(rows.withColumn("op", F.lit(mvcc.PUT)), order, sync=sync)

    def delete(self, keys: DataFrame) -> int:
        """Commit tombstones for keys, whether they exist or not."""
        return self.apply_batch(keys.select("key", F.lit(mvcc.DELETE).alias("op"), F.lit(None).cast(self.schema["value"].dataType).alias("value")))

    def put_rows(self, *pairs: tuple) -> int:
        """Commit a few literal puts, later ones over earlier ones."""
        rows = [(i, k, v) for i, (k, v) in enumerate(pairs)]
        schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("key", self.schema["key"].dataType), T.StructField("value", self.schema["value"].dataType)])
        return self.put(self.spark.createDataFrame(rows, schema), order="i")

    def delete_keys(self, *keys) -> int:
        return self.delete(self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("key", self.schema["key"].dataType)])))

    # -- reads ------------------------------------------------------------------------------------

    @staticmethod
    def _plain(side):
        return bytes.fromhex(side["hex"]) if isinstance(side, dict) else side

    def _files(self, state: State, low=None, high=None, seq: int | None = None) -> list[str]:
        """Files that can hold keys in [low, high] at ``seq``."""
        fits = lambda f: (low is None or self._plain(f["max_key"]) >= low) and (high is None or self._plain(f["min_key"]) <= high) and (seq is None or f["min_seq"] <= seq)
        return [p for p, f in state.files.items() if fits(f)]

    def log(self, low=None, high=None, seq: int | None = None) -> DataFrame:
        """The mutation log, from the files that a key range and a snapshot need."""
        files = self._files(self.state(), low, high, seq)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.cache.read(files, self._read_files)

    def _read_files(self, files: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).options(**self.config.spark_read_options()).parquet(*files)

    def keep_in_memory(self, low=None, high=None) -> int:
        """Cache the files that hold keys in [low, high], as far as ``cache_bytes`` goes; the number cached."""
        state = self.state()
        return self.cache.fill({p: state.files[p]["bytes"] for p in self._files(state, low, high)}, self._read_files)

    def _at(self, snapshot: Snapshot | int | None) -> int | None:
        return snapshot.seq if isinstance(snapshot, Snapshot) else snapshot

    def get(self, key, snapshot: Snapshot | int | None = None) -> DataFrame:
        self.metrics.count("reads.total")
        seq = self._at(snapshot)
        return mvcc.get(self.log(key, key, seq), key, seq)

    def multi_get(self, keys: DataFrame, snapshot: Snapshot | int | None = None) -> DataFrame:
        seq = self._at(snapshot)
        return mvcc.multi_get(self.log(seq=seq), keys, seq)

    def scan(self, start=None, end=None, snapshot: Snapshot | int | None = None) -> DataFrame:
        """Live (key, value, seq) with start <= key < end, in order of the key."""
        seq = self._at(snapshot)
        return mvcc.scan(self.log(start, end, seq), start, end, seq).orderBy("key")

    def scan_prefix(self, prefix, snapshot: Snapshot | int | None = None) -> DataFrame:
        return self.scan(prefix, after_prefix(prefix), snapshot)

    def snapshot(self) -> Snapshot:
        seq = self.state().last_seq
        self._pins[seq] += 1
        return Snapshot(self, seq)

    def _unpin(self, seq: int) -> None:
        self._pins[seq] -= 1
        if not self._pins[seq]:
            del self._pins[seq]

    def oldest_snapshot(self) -> int:
        return min(self._pins, default=mvcc.MAX_SEQ)

    # -- maintenance ------------------------------------------------------------------------------

    def files(self) -> DataFrame:
        """Manifest rows (file_id, level, file_size, min_key, max_key, entry_count, min_seq, max_seq)."""
        rows = [(p, f["level"], f["bytes"], self._plain(f["min_key"]), self._plain(f["max_key"]), f["rows"], f["min_seq"], f["max_seq"]) for p, f in self.state().files.items()]
        key = self.schema["key"].dataType.simpleString()
        return self.spark.createDataFrame(rows, f"file_id string, level int, file_size bigint, min_key {key}, max_key {key}, entry_count bigint, min_seq bigint, max_seq bigint")

    def compact(self, full: bool = False) -> bool:
        """Run one compaction, of the level that needs it most or (``full``) of all files; whether one was due.

        Versions that no pinned snapshot sees go. The output has files of about target_file_bytes,
        split by key and seq. Commits that come in between are no conflict unless they remove an
        input (ConflictError); what was written is then left for vacuum.
        """
        state, files = self.state(), self.files()
        config = self.config
        if full:
            if not state.files:
                return False
            target, inputs = max(1, *(f["level"] for f in state.files.values())), set(state.files)
        else:
            job = compaction.pick(compaction.scores(files, config.l1_max_bytes, config.level_multiplier, config.l0_files), config.max_levels)
            chosen = job.first()
            if chosen is None:
                return False
            target = chosen["target_level"]
            inputs = {r["file_id"] for r in compaction.job_inputs(files, job).collect()}
        only = self.spark.createDataFrame([(p,) for p in inputs], "file_id string")
        drop = compaction.may_drop_tombstones(files, only, target) and not self._covered_elsewhere(state, inputs)
        rows = self._read_files(sorted(inputs))
        oldest, parts = self.oldest_snapshot(), self._parts(sum(state.files[p]["bytes"] for p in inputs))
        kept = compaction.collect_garbage(rows, oldest, drop)
        added = self._write_run(kept.repartition(1) if parts == 1 else kept, target, parts)
        for _ in range(TRIES):
            # commits that only added files above the inputs take nothing from this one
            now = self.state()
            if not inputs <= now.files.keys():
                raise ConflictError("another compaction came first; compact again")
            if self._commit(now.version + 1, add=added, remove=sorted(inputs), last_seq=now.last_seq):
                break
        else:
            raise ConflictError(f"{TRIES} other commits came first")
        self.cache.evict(*inputs)
        self.metrics.count("compactions.completed")
        self.metrics.count("compaction.bytes.read", sum(state.files[p]["bytes"] for p in inputs))
        self.metrics.count("compaction.bytes.written", sum(f["bytes"] for f in added))
        return True

    def relieve(self) -> None:
        """Compact while level 0 holds max_immutable times l0_files files or more."""
        while self.l0_files() >= self.config.max_immutable * self.config.l0_files and self.compact():
            pass

    def _covered_elsewhere(self, state: State, inputs: set[str]) -> bool:
        """Whether files at or above the target that are not inputs overlap them with older rows."""
        low = min(self._plain(state.files[p]["min_key"]) for p in inputs)
        high = max(self._plain(state.files[p]["max_key"]) for p in inputs)
        newest = max(state.files[p]["max_seq"] for p in inputs)
        return any(f["min_seq"] < newest for p, f in state.files.items() if p not in inputs and self._plain(f["max_key"]) >= low and self._plain(f["min_key"]) <= high)

    def check(self) -> None:
        """Raise RecoveryError if a file of the manifest is missing."""
        if gone := [p for p in self.state().files if not self._fs.exists(self._paths(p))]:
            raise RecoveryError(f"{len(gone)} files are missing, such as {gone[0]}")

    def vacuum(self, older_than_s: float = 3600) -> int:
        """Remove temporary files and data files that no commit names; the number removed.

        Only files older than ``older_than_s`` go: younger ones may belong to a running commit or reader.
        """
        live, before, gone = {self._paths(p).getName() for p in self.state().files}, (time.time() - older_than_s) * 1000, 0
        for folder, wanted in ((f"{self.path}/data", lambda n: n.endswith(".parquet") and n not in live), (f"{self.path}/_manifest", lambda n: n.endswith(".tmp"))):
            if not self._fs.exists(self._paths(folder)):
                continue
            listing = self._fs.listFiles(self._paths(folder), True)
            while listing.hasNext():
                one = listing.next()
                if wanted(one.getPath().getName()) and one.getModificationTime() <= before:
                    gone += bool(self._fs.delete(one.getPath(), False))
        return gone

    def close(self) -> None:
        if self._open and self._lock is not None:
            self._fs.delete(self._lock, False)
        self._open = False
        self.cache.clear()


class Writer:
    """Puts and deletes one at a time: they are held until they weigh memtable_bytes, then committed together.

    Later ones win. Where level 0 has max_immutable times l0_files files, a flush compacts first.
    """

    def __init__(self, table: Table):
        self.table, self.bytes = table, 0
        self._held: list[tuple] = []

    def put(self, key, value) -> None:
        if value is None:
            raise ValueError("a put needs a value")
        self._add(key, mvcc.PUT, value)

    def delete(self, key) -> None:
        self._add(key, mvcc.DELETE, None)

    def _add(self, key, op: str, value) -> None:
        if key is None or key in ("", b""):
            raise ValueError("a mutation needs a key that is not empty")
        self._held.append((len(self._held), key, op, value))
        self.bytes += RECORD_OVERHEAD + sum(len(x) if isinstance(x, str | bytes) else 8 for x in (key, value) if x is not None)
        if self.bytes >= self.table.config.memtable_bytes:
            self.flush()

    def flush(self) -> int:
        """Commit what is held; the last sequence number."""
        if not self._held:
            return self.table.state().last_seq
        self.table.relieve()
        schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("key", self.table.schema["key"].dataType), T.StructField("op", T.StringType()), T.StructField("value", self.table.schema["value"].dataType)])
        last = self.table.apply_batch(self.table.spark.createDataFrame(self._held, schema), order="i")
        self._held, self.bytes = [], 0
        return last

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()
