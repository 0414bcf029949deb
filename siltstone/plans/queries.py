"""One query per operator, over the tables of a folder, with the parameters its SQL equivalent uses."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.keys import decode_bytes, decode_value, encode_bytes, encode_value
from siltstone.operators import cache, compaction, manifest, metrics, mvcc, runs, wal
from siltstone.operators.order import next_sequences, with_position
from siltstone.scratch import Scratch
from siltstone.sources import views
from siltstone.sources.wal_files import SEGMENT_SPAN, decoded, segment_files, write_wal

KEY, LIVE_KEY, SNAPSHOT = 8, 9, 5000
LOW, HIGH, FROM, UNTIL = 20, 60, 100, 30
PREFIX = "user:0000001"
RUN_ROWS, KEYS_PER_BLOCK = 1000, 16
BLOOM_BITS, BLOOM_HASHES = 1024, 7
KEY_BYTES = VALUE_BYTES = 8
L1_BYTES, MULTIPLIER, MAX_LEVELS = 32 << 10, 10, 4
FLUSHED, BAD_SEQ = 4050, 9000
MEMTABLE_BYTES = 30_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    return views.event_log(spark, folder)


def runs_of(spark: SparkSession, folder: str) -> DataFrame:
    return runs.assign_runs(log_of(spark, folder), RUN_ROWS)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """Run statistics with sizes, dealt over levels 0 to 2 by run number."""
    sized = runs.with_sizes(runs_of(spark, folder), KEY_BYTES, VALUE_BYTES)
    return sized.groupBy("run_id", "file_id").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.sum("est_bytes").alias("file_size")).withColumn("level", F.pmod("run_id", F.lit(3)).cast("int"))


def wal_files(spark: SparkSession, folder: str) -> str:
    """Segments on disk: a record per mutation and markers around the first hundred of every two hundred; one
    batch in seven stays open. A segment holds 2,000 sequence numbers. The folder's place."""
    log, seq = log_of(spark, folder), F.col("seq")
    as_bytes = lambda c: F.col(c).cast("string").cast("binary").alias(c)
    records = log.select(F.col("op").alias("rtype"), as_bytes("key"), as_bytes("value"), "seq")
    marks = lambda which, kind: log.filter(which).select(F.lit(kind).alias("rtype"), "seq")
    start, end = marks(seq % 200 == 1, wal.START), marks((seq % 200 == 100) & (seq % 700 != 0), wal.END)
    place = Scratch(spark, "wal").path("segments")
    write_wal(records.unionByName(start, allowMissingColumns=True).unionByName(end, allowMissingColumns=True), place, F.floor((seq - 1) / 2000))
    return place


def wal_of(spark: SparkSession, folder: str, place: str | None = None) -> DataFrame:
    """The segments of ``wal_files`` as the data source reads them, numbered in their order and decoded once."""
    from_bytes = lambda c, kind: F.col(c).cast("string").cast(kind).alias(c)
    segment = F.floor(F.col("pos") / SEGMENT_SPAN).alias("segment")
    frames = decoded(spark, place or wal_files(spark, folder))
    return frames.select(segment, "pos", "frame", "rtype", from_bytes("key", "bigint"), from_bytes("value", "double"), "seq", "bad")


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """An addition and a flush mark per run, a finished compaction of runs 0-3 and an unfinished one of runs 4 and 5."""
    found = runs_of(spark, folder).groupBy("run_id", "file_id").agg(F.max("seq").alias("sequence"))
    adds = found.select((2 * F.col("run_id")).alias("pos"), F.lit(manifest.ADD).alias("rtype"), F.lit(0).alias("level"), "file_id")
    marks = found.select((2 * F.col("run_id") + 1).alias("pos"), F.lit(manifest.FLUSHED).alias("rtype"), "sequence")
    schema = "pos bigint, rtype string, level int, file_id string, sequence bigint, tx_id bigint, remove_files array<struct<level:int,file_id:string>>, add_files array<struct<level:int,file_id:string>>"
    rows = []
    for tx, at, sources, done in ((1, 10**9, range(4), True), (2, 2 * 10**9, (4, 5), False)):
        removed, added = [(0, f"L0-{i}") for i in sources], (1, f"L1-{tx}")
        rows.append((at, manifest.TX_START, None, None, None, tx, removed, [added]))
        rows += [(at + 1 + i, manifest.REMOVE, *f, None, tx, None, None) for i, f in enumerate(removed)]
        rows.append((at + 100, manifest.ADD, *added, None, tx, None, None))
        rows += [(at + 101, manifest.TX_END, None, None, None, tx, None, None)] if done else []
    return spark.createDataFrame(rows, schema).unionByName(adds, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True)


# -- reads ----------------------------------------------------------------------------------------


@query
def kv_latest_state(spark, folder):
    return mvcc.scan(log_of(spark, folder))


@query
def kv_get_latest(spark, folder):
    return mvcc.get(log_of(spark, folder), KEY)


@query
def kv_get_live(spark, folder):
    return mvcc.get(log_of(spark, folder), LIVE_KEY)


@query
def kv_get_snapshot(spark, folder):
    return mvcc.get(log_of(spark, folder), KEY, SNAPSHOT)


@query
def kv_multi_get(spark, folder):
    """All keys that some error deleted at some time, and as many absent ones."""
    log = log_of(spark, folder)
    keys = log.filter(F.col("op") == mvcc.DELETE).select("key").distinct()
    return mvcc.multi_get(log, keys.unionByName(keys.select((-F.col("key") - 1).alias("key"))))


@query
def kv_scan_range(spark, folder):
    return with_position(mvcc.scan(log_of(spark, folder), LOW, HIGH), "key").select("pos", "key", "value", "seq")


@query
def kv_scan_snapshot(spark, folder):
    return mvcc.scan(log_of(spark, folder), LOW, HIGH, SNAPSHOT)


@query
def kv_scan_from(spark, folder):
    return mvcc.scan(log_of(spark, folder), start=FROM)


@query
def kv_scan_until(spark, folder):
    return mvcc.scan(log_of(spark, folder), end=UNTIL)


@query
def kv_scan_inverted(spark, folder):
    return mvcc.scan(log_of(spark, folder), HIGH, LOW)


@query
def kv_scan_prefix(spark, folder):
    return mvcc.scan_prefix(log_of(spark, folder).withColumn("key", views.text_key(F.col("key"))), PREFIX)


@query
def kv_versions_range(spark, folder):
    return mvcc.versions(log_of(spark, folder), LOW, HIGH, SNAPSHOT).select("key", "seq", "op", "value")


@query
def kv_snapshot_bounded(spark, folder):
    return mvcc.as_of(log_of(spark, folder), SNAPSHOT).select("key", "seq", "op")


@query
def kv_skip_tombstones(spark, folder):
    return mvcc.skip_tombstones(mvcc.newest(log_of(spark, folder))).select("key", "seq", "value")


@query
def kv_binary_order(spark, folder):
    keys = ["", "61", "6162", "7F", "80", "FF", "00", "6100", "FFFF"]
    rows = spark.createDataFrame([(bytearray.fromhex(k),) for k in keys], "key binary")
    return with_position(rows, "key").select("pos", F.hex("key").alias("key_hex"))


@query
def kv_dedup_newest(spark, folder):
    return mvcc.newest(log_of(spark, folder)).select("key", "seq", "op")


@query
def kv_idempotent_replay(spark, folder):
    log = log_of(spark, folder)
    return mvcc.scan(mvcc.merge(log, log))


@query
def kv_version_count(spark, folder):
    return mvcc.version_counts(log_of(spark, folder))


@query
def kv_tombstone_count(spark, folder):
    return mvcc.tombstone_counts(log_of(spark, folder))


@query
def kv_orders_latest(spark, folder):
    return mvcc.scan(views.order_log(spark, folder))


@query
def kv_documents_latest(spark, folder):
    return mvcc.scan(views.document_log(spark, folder)).select("key", F.char_length("value").cast("bigint").alias("chars"), "seq")


@query
def kv_turns_latest(spark, folder):
    return mvcc.scan(views.turn_log(spark, folder))


# -- writes and runs ------------------------------------------------------------------------------


def _appended(spark, folder, rows):
    log = log_of(spark, folder)
    base = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return mvcc.scan(log.unionByName(next_sequences(rows, base, "key")))


@query
def kv_apply_puts(spark, folder):
    rows = spark.range(0, 400, 4).select(F.col("id").alias("key"), F.lit(mvcc.PUT).alias("op"), (F.col("id") * 1.5).alias("value"))
    return _appended(spark, folder, rows)


@query
def kv_apply_deletes(spark, folder):
    rows = spark.range(0, 100, 2).select(F.col("id").alias("key"), F.lit(mvcc.DELETE).alias("op"), F.lit(None).cast("double").alias("value"))
    return _appended(spark, folder, rows)


@query
def kv_overwrites(spark, folder):
    return mvcc.overwrites(log_of(spark, folder))


@query
def kv_entry_size(spark, folder):
    return runs.with_sizes(log_of(spark, folder), KEY_BYTES, VALUE_BYTES).select("key", "seq", "est_bytes")


@query
def kv_flush_runs(spark, folder):
    sized = runs.with_sizes(runs_of(spark, folder), KEY_BYTES, VALUE_BYTES)
    return sized.groupBy("run_id").agg(F.count("*").alias("entries"), F.sum("est_bytes").alias("bytes"))


@query
def kv_flush_l0_metadata(spark, folder):
    return runs.run_statistics(runs_of(spark, folder))


@query
def kv_memtable_rotation(spark, folder):
    """Runs that end where the bytes written pass multiples of a memtable's size."""
    sized = runs.with_sizes(log_of(spark, folder), KEY_BYTES, VALUE_BYTES)
    return runs.rotate_by_bytes(sized, MEMTABLE_BYTES).groupBy("run_id").agg(F.count("*").alias("entries"), F.sum("est_bytes").alias("bytes"), F.max("seq").alias("max_seq"))


@query
def kv_flush_sorted_run(spark, folder):
    return runs.sorted_runs(runs_of(spark, folder)).select("file_id", "pos", "key", "seq", "op")


@query
def kv_merge_runs(spark, folder):
    found = runs_of(spark, folder)
    even, odd = found.filter("run_id % 2 = 0"), found.filter("run_id % 2 = 1")
    return with_position(mvcc.merge(even, odd), "key", F.desc("seq")).select("pos", "key", "seq", "op")


@query
def kv_pruned_lookup(spark, folder):
    found = runs_of(spark, folder)
    files = runs.files_for_key(runs.run_statistics(found), KEY).select("file_id")
    own = found.filter(F.col("key") == KEY).join(files, "file_id", "left_semi")
    return own.groupBy("file_id").agg(F.max_by("key", "seq").alias("key"), F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


@query
def kv_files_for_key(spark, folder):
    return runs.files_for_key(files_of(spark, folder), KEY).select("file_id")


@query
def kv_overlapping_files(spark, folder):
    return runs.overlapping(files_of(spark, folder), LOW, HIGH).select("file_id", "min_key", "max_key")


@query
def kv_bloom_build(spark, folder):
    return runs.bloom_words(runs_of(spark, folder), BLOOM_BITS, BLOOM_HASHES)


def _probes(spark, folder):
    """(file_id, key): each run is asked for its own keys, for those of the run before it, and for absent ones."""
    found = runs_of(spark, folder).select("run_id", "key").distinct()
    later = found.select((F.col("run_id") + 1).alias("run_id"), "key").join(found.select("run_id").distinct(), "run_id", "left_semi")
    absent = found.select("run_id", (-F.col("key") - 1).alias("key"))
    asked = found.unionByName(later).unionByName(absent).distinct()
    return asked.select(F.concat(F.lit("L0-"), F.col("run_id").cast("string")).alias("file_id"), "key")


@query
def kv_bloom_probe(spark, folder):
    found = runs_of(spark, folder)
    maybe = runs.bloom_probe(_probes(spark, folder), runs.bloom_words(found, BLOOM_BITS, BLOOM_HASHES), BLOOM_BITS, BLOOM_HASHES)
    there = found.select("file_id", "key").distinct().withColumn("present", F.lit(True))
    return maybe.join(there, ["file_id", "key"], "left").select("file_id", "key", "maybe", F.coalesce("present", F.lit(False)).alias("present"))


@query
def kv_bloom_fpr(spark, folder):
    return runs.bloom_rates(runs_of(spark, folder), BLOOM_BITS, BLOOM_HASHES)


@query
def kv_sparse_index(spark, folder):
    return runs.sparse_index(runs.with_blocks(runs_of(spark, folder), KEYS_PER_BLOCK))


@query
def kv_sparse_index_lookup(spark, folder):
    index = runs.sparse_index(runs.with_blocks(runs_of(spark, folder), KEYS_PER_BLOCK))
    return runs.floor_blocks(_probes(spark, folder), index).select("file_id", "key", "block")


@query
def kv_block_layout(spark, folder):
    return runs.block_layout(runs.with_blocks(runs_of(spark, folder), KEYS_PER_BLOCK))


@query
def kv_level_counts(spark, folder):
    return compaction.level_rollup(files_of(spark, folder))


# -- compaction -----------------------------------------------------------------------------------


def _scores(spark, folder):
    return compaction.scores(files_of(spark, folder), L1_BYTES, MULTIPLIER)


@query
def kv_compaction_scores(spark, folder):
    return _scores(spark, folder)


@query
def kv_compaction_pick(spark, folder):
    return compaction.pick(_scores(spark, folder), MAX_LEVELS)


@query
def kv_compaction_inputs(spark, folder):
    return compaction.job_inputs(files_of(spark, folder), compaction.pick(_scores(spark, folder), MAX_LEVELS))


def _versions(df):
    return df.select("key", "seq", "op", "value")


@query
def kv_compact_no_snapshot(spark, folder):
    return _versions(compaction.collect_all_garbage(log_of(spark, folder)))


@query
def kv_compact_with_snapshot(spark, folder):
    return _versions(compaction.collect_garbage(log_of(spark, folder), SNAPSHOT))


@query
def kv_compact_drop_tombstones(spark, folder):
    return _versions(compaction.collect_garbage(log_of(spark, folder), SNAPSHOT, drop_tombstones=True))


@query
def kv_compact_keep_tombstones(spark, folder):
    return _versions(compaction.collect_garbage(log_of(spark, folder), drop_tombstones=False))


@query
def kv_compaction_stats(spark, folder):
    sized = lambda df: runs.with_sizes(df, KEY_BYTES, VALUE_BYTES)
    log = log_of(spark, folder)
    return compaction.statistics(sized(log), sized(compaction.collect_all_garbage(log)))


# -- write-ahead log, manifest, recovery ----------------------------------------------------------


@query
def kv_wal_read(spark, folder):
    return wal_of(spark, folder).select("segment", "frame", "rtype", "key", "seq")


@query
def kv_wal_segments(spark, folder):
    return wal.segments(wal_of(spark, folder))


@query
def kv_wal_unflushed_segments(spark, folder):
    return wal.unflushed_segments(wal_of(spark, folder), FLUSHED)


@query
def kv_wal_trim(spark, folder):
    return wal.removable_segments(wal_of(spark, folder), FLUSHED)


@query
def kv_wal_replay(spark, folder):
    return wal.replay(wal_of(spark, folder), FLUSHED)


@query
def kv_wal_batches(spark, folder):
    return wal.replay(wal_of(spark, folder)).select("key", "seq")


def _damaged(spark, folder):
    return wal_of(spark, folder).withColumn("bad", (F.col("seq") == BAD_SEQ) & F.col("rtype").isin(mvcc.PUT, mvcc.DELETE))


@query
def kv_wal_lenient(spark, folder):
    return wal.replay(_damaged(spark, folder)).select("key", "seq")


@query
def kv_wal_strict(spark, folder):
    return wal.bad_frames(_damaged(spark, folder))


@query
def kv_recover_sequence(spark, folder):
    return wal.recovered_sequence(wal_of(spark, folder), FLUSHED)


@query
def kv_manifest_rebuild(spark, folder):
    return manifest.live_files(manifest_of(spark, folder))


@query
def kv_manifest_rollback(spark, folder):
    return manifest.live_files(manifest.roll_back(manifest_of(spark, folder)))


@query
def kv_flushed_sequence(spark, folder):
    return manifest.flushed_sequence(manifest_of(spark, folder))


@query
def kv_missing_files(spark, folder):
    found = runs_of(spark, folder).select("run_id", "file_id").distinct()
    return manifest.missing_files(found, found.filter("run_id % 4 <> 3"))


@query
def kv_oldest_snapshot(spark, folder):
    acts = spark.createDataFrame([(3000, 1), (5000, 1), (5000, 1), (9000, 1), (3000, -1)], "seq bigint, n int")
    return manifest.oldest_snapshot(acts.groupBy("seq").agg(F.sum("n").alias("n")))


# -- integrity, cache, metrics --------------------------------------------------------------------


@query
def kv_checksum_validate(spark, folder):
    """Frames that fail their stored checksum in log segments of which every fourth had its last byte changed on disk."""
    place = wal_files(spark, folder)
    system, _ = fs.FileSystem.from_uri(place)
    for path in segment_files(place)[::4]:
        with system.open_input_stream(path, compression=None) as f:
            data = f.read()
        with system.open_output_stream(path, compression=None) as f:
            f.write(data[:-1] + bytes([data[-1] ^ 1]))
    return wal.bad_frames_by_segment(wal_of(spark, folder, place))


@query
def kv_codec_roundtrip(spark, folder):
    """Stored bytes of keys and values of the turns, every fifth of them deleted, and what they decode to."""
    op = F.when(F.col("seq") % 5 == 0, mvcc.DELETE).otherwise(mvcc.PUT)
    log = views.turn_log(spark, folder).withColumn("op", op).withColumn("value", F.when(op == mvcc.PUT, F.col("value")))
    packed = log.select("key", "seq", encode_bytes(F.col("key").cast("string")).alias("k"), encode_value(F.col("op"), F.col("value")).alias("v"))
    back = packed.withColumn("entry", decode_value(F.col("v")))
    return back.select(F.hex("k").alias("key_hex"), F.md5("v").alias("value_md5"), F.octet_length("v").alias("value_bytes"), decode_bytes(F.col("k")).cast("string").alias("key_back"), F.col("entry.op").alias("op_back"), F.col("entry.value").cast("string").alias("value_back"))


@query
def kv_hit_ratio(spark, folder):
    return log_of(spark, folder).agg(cache.hit_ratio(F.count_if(F.col("op") == mvcc.PUT), F.count("*")).alias("ratio"))


@query
def kv_lru_sim(spark, folder):
    accesses = log_of(spark, folder).select("key", F.col("seq").alias("at"), F.lit(4096).alias("bytes"))
    found = cache.simulate_lru(accesses, capacity=4 * 4096, shard=F.pmod("key", F.lit(16)))
    return found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "misses", "evictions")])


@query
def kv_op_counters(spark, folder):
    return metrics.op_counters(log_of(spark, folder))


@query
def kv_value_percentiles(spark, folder):
    return metrics.value_percentiles(log_of(spark, folder))
