"""Write-ahead logs, manifests, runs, and the table on disk."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.config import PRESETS, EngineConfig
from siltstone.errors import ClosedError, ConflictError, CorruptionError, LockError, RecoveryError
from siltstone.functions.keys import bloom_size
from siltstone.operators import cache, compaction, manifest, metrics, runs, wal
from siltstone.operators.order import with_position
from siltstone.sources import table as table_module
from siltstone.sources.table import Table, Writer
from siltstone.sources.wal_files import HEADER, decode_frames, encode_frame, read_wal, recover, segment_files, trim_wal, write_wal
from siltstone.streaming.ingest import CompactionScheduler, stream_into

WAL = "segment bigint, pos bigint, rtype string, key string, value string, seq bigint, bad boolean"


def wal_of(spark, *steps, bad=()):
    """Steps: "S" and "E" are markers, other letters puts of that key."""
    kind = {"S": "BATCH_START", "E": "BATCH_END"}
    rows = [(0, i, kind.get(s, "PUT"), None if s in kind else s, None if s in kind else "v", i, i in bad) for i, s in enumerate(steps, 1)]
    return spark.createDataFrame(rows, WAL)


def keys(df):
    return sorted(r.key for r in df.collect())


def test_batches(spark):
    assert keys(wal.replay(wal_of(spark, "a", "S", "b", "E", "S", "c", "S", "d", "E", "e", "S", "f"))) == ["a", "b", "d", "e"]
    whole = wal_of(spark, "S", "pear", "plum", "quince", "E")
    assert keys(wal.replay(whole)) == ["pear", "plum", "quince"] and wal.recovered_sequence(whole, 0).first()[0] == 4
    half = wal_of(spark, "S", "pear", "plum")
    assert keys(wal.replay(half)) == [] and wal.recovered_sequence(half, 0).first()[0] == 0
    assert keys(wal.replay(wal_of(spark, "S", "a", "b"), flushed=1)) == ["a", "b"]


def test_bad_frames(spark):
    log = wal_of(spark, "fig", "kiwi", "lime", "mango", bad=(3,))
    assert keys(wal.replay(log)) == ["fig", "kiwi"]
    with pytest.raises(CorruptionError):
        wal.replay(log, policy="STRICT")


def test_wal_files(spark, tmp_path):
    folder = f"file://{tmp_path}/wal"
    rows = [("BATCH_START", 1, None, None), ("PUT", 2, b"k", b""), ("DELETE", 3, b"k", None), ("BATCH_END", 4, None, None)]
    write_wal(spark.createDataFrame(rows, "rtype string, seq bigint, key binary, value binary").coalesce(1), folder)
    back = read_wal(spark, folder).orderBy("pos").collect()
    assert [(r.rtype, r.seq, r.key and bytes(r.key), None if r.value is None else bytes(r.value), r.bad) for r in back] == [(t, s, k, v, False) for t, s, k, v in rows]
    name = sorted(os.listdir(tmp_path / "wal"))[-1]
    with open(tmp_path / "wal" / name, "ab") as f:
        f.write(encode_frame("PUT", 9, b"x", b"y")[:-1])
    assert [r.bad for r in read_wal(spark, folder).orderBy("pos").collect()][-1]
    (tmp_path / "wal" / "zz.wal").write_bytes(b"nonsense")
    with pytest.raises(Exception, match="segment"):
        read_wal(spark, folder).collect()
    with pytest.raises(ValueError):
        encode_frame("PUT", 1, b"", b"v")
    assert HEADER


def test_batches_over_segments_of_real_files(spark, tmp_path):
    folder = f"file://{tmp_path}/wal"
    steps = ["a", "S", "b", "c", "d", "E", "S", "e", "f", "g", "S", "h", "E", "i", "S", "j", "k"]
    kind = {"S": "BATCH_START", "E": "BATCH_END"}
    rows = [(kind.get(x, "PUT"), i, None if x in kind else x.encode(), None if x in kind else b"v" * 40) for i, x in enumerate(steps, 1)]
    # a few frames a segment: batches, lost ones too, go over segments, and some segments hold no marker
    write_wal(spark.createDataFrame(rows, "rtype string, seq bigint, key binary, value binary").coalesce(1), folder, segment_bytes=150)
    assert len(segment_files(folder)) > 5
    log = read_wal(spark, folder).withColumn("key", F.col("key").cast("string"))
    assert keys(wal.replay(log)) == ["a", "b", "c", "d", "h", "i"]
    assert {bytes(r.key) for r in recover(spark, folder).collect()} == set(b"abcdhi"[i : i + 1] for i in range(6))
    assert wal.replay(log).count() == 6 and wal.recovered_sequence(log, 0).first()[0] == 14
    before = segment_files(folder)
    gone = trim_wal(spark, folder, 9)
    assert gone and [p.rpartition("/")[2] for p in before[: len(gone)]] == gone and len(segment_files(folder)) == len(before) - len(gone)
    assert keys(wal.replay(read_wal(spark, folder).withColumn("key", F.col("key").cast("string")), 9)) == ["g", "h", "i"]
    trim_wal(spark, folder, 1000)
    assert segment_files(folder) == before[-1:]


def test_frames_over_read_blocks():
    data = HEADER + b"".join(encode_frame("PUT", i, b"k%d" % i, b"x" * (i % 7)) for i in range(200))
    blocks = lambda d, n: iter([d[i : i + n] for i in range(0, len(d), n)])
    whole = list(decode_frames(blocks(data, 1 << 20)))
    assert [r[4] for r in whole] == list(range(200)) and not any(r[5] for r in whole)
    assert all(list(decode_frames(blocks(data, n))) == whole for n in (1, 3, 64, 1000))
    for cut in (1, 9, 30):
        broken = list(decode_frames(blocks(data[:-cut], 50)))
        assert broken[-1][5] and broken[:-1] == whole[: len(broken) - 1]
    flipped = bytearray(data)
    flipped[-1] ^= 1
    assert [r[5] for r in decode_frames(blocks(bytes(flipped), 77))] == [False] * 199 + [True]


def test_positions(spark):
    rows = [(i % 3 if i % 5 else None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, i int")
    want = {i: at for at, (_, _, i) in enumerate(sorted((k is not None, k or 0, i) for k, i in rows), 11)}
    for parts in (None, 1, 7):
        assert {r.i: r.pos for r in with_position(df, "k", F.col("i"), base=10, parts=parts).collect()} == want
    assert with_position(df.limit(0), "k").count() == 0


def test_garbage_collection_around_a_floor(spark):
    rows = [(k, s, "DELETE" if (k + s) % 3 == 0 else "PUT", None if (k + s) % 3 == 0 else f"v{s}") for s, k in enumerate([1, 2, 1, 1, 2, 3, 1, 2, 1, 3, 4] * 3, 1)]
    log = spark.createDataFrame(rows, "key int, seq bigint, op string, value string")
    for floor in (None, 0, 9, 20, 99):
        for drop in (False, True):
            newest = {}
            for k, s, op, _ in rows:
                if floor is None or s <= floor:
                    newest[k] = (s, op)
            want = {s for k, s, op, _ in rows if floor is not None and s > floor} | {s for s, op in newest.values() if not (drop and op == "DELETE")}
            assert {r.seq for r in compaction.collect_garbage(log, floor, drop).collect()} == want


def test_manifest(spark):
    schema = "pos bigint, rtype string, level int, file_id string, sequence bigint, tx_id bigint, remove_files array<struct<level:int,file_id:string>>, add_files array<struct<level:int,file_id:string>>"
    rows = [
        (1, manifest.ADD, 0, "L0-a", None, None, None, None), (2, manifest.FLUSHED, None, None, 99, None, None, None),
        (3, manifest.TX_START, None, None, None, 7, [(0, "L0-a")], [(1, "L1-b")]), (4, manifest.REMOVE, 0, "L0-a", None, 7, None, None), (5, manifest.ADD, 1, "L1-b", None, 7, None, None),
    ]
    log = spark.createDataFrame(rows, schema)
    assert [r.file_id for r in manifest.live_files(log).collect()] == ["L1-b"]
    assert [r.file_id for r in manifest.live_files(manifest.roll_back(log)).collect()] == ["L0-a"]
    assert manifest.flushed_sequence(log).first()[0] == 99
    pins = spark.createDataFrame([(10, 1), (20, 1)], "seq bigint, n int")
    assert tuple(manifest.oldest_snapshot(pins).first()) == (10, 2)
    assert tuple(manifest.oldest_snapshot(pins.limit(0)).first()) == ((1 << 63) - 1, 0)


def test_sparse_index_and_bloom(spark):
    index = spark.createDataFrame([("f", 0, "cedar"), ("f", 1, "larch"), ("f", 2, "rowan"), ("g", 0, "m")], "file_id string, block bigint, first_key string")
    asked = spark.createDataFrame([("f", k) for k in ("maple", "rowan", "birch", "willow")] + [("g", "a"), ("g", "z")], "file_id string, key string")
    assert {(r.file_id, r.key): r.block for r in runs.floor_blocks(asked, index).collect()} == {("f", "maple"): 1, ("f", "rowan"): 2, ("f", "birch"): 0, ("f", "willow"): 2, ("g", "a"): 0, ("g", "z"): 0}
    held = spark.createDataFrame([("f", "oak"), ("f", "ash"), ("f", "elm")], "file_id string, key string")
    bits, hashes = bloom_size(300, 0.01)
    probe = spark.createDataFrame([("f", k) for k in ("oak", "ash", "elm", "palm")], "file_id string, key string")
    assert {r.key: r.maybe for r in runs.bloom_probe(probe, runs.bloom_words(held, bits, hashes), bits, hashes).collect()} == {"oak": True, "ash": True, "elm": True, "palm": False}


def test_cache_and_metrics(spark):
    accesses = spark.createDataFrame([(k, i, 1) for i, k in enumerate("aabac")], "key string, at bigint, bytes int")
    row = cache.simulate_lru(accesses, capacity=2, shards=1).first()
    assert (row.hits, row.misses, row.evictions) == (2, 3, 1)
    seen = metrics.Metrics()
    seen.count("writes.total", 2)
    seen.record("latency", -5)
    assert seen.snapshot()["histograms"]["latency"]["max"] == 0 and seen.snapshot()["histograms"] == {}
    got = []
    metrics.Reporter(seen, got.append).publish()
    metrics.Reporter(seen, lambda _: 1 / 0).publish()
    assert got[0]["counters"] == {"writes.total": 2}


def test_config():
    assert PRESETS["default"] == EngineConfig() and PRESETS["dev"].max_levels == 4
    for wrong in ({"bloom_fpp": 1.0}, {"memtable_bytes": 0}, {"sync_writes": True}, {"wal_sync": "MAYBE"}):
        with pytest.raises(ValueError):
            EngineConfig(**wrong)


def value(df):
    return [r.value for r in df.collect()]


def test_table(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    table.put_rows(("a", "old"), ("b", ""), ("a", "v1"))
    pinned = table.snapshot()
    table.put_rows(("a", "v2"), ("c", "x"))
    table.delete_keys("c")
    assert value(table.get("a")) == ["v2"] and value(table.get("a", pinned)) == ["v1"] and value(table.get("b")) == [""]
    assert [r.key for r in table.scan("a", "c").collect()] == ["a", "b"] and value(table.get("c")) == []
    assert table.compact(full=True) and value(table.get("a", pinned)) == ["v1"]
    assert table.log().filter("key = 'a'").count() == 2
    pinned.close()
    pinned.close()
    with pytest.raises(ClosedError):
        table.get("a", pinned)
    table.put_rows(("a", "v4"))
    assert table.compact(full=True)
    assert table.log().count() == 2 and table.log().filter("op = 'DELETE'").count() == 0
    other = Table(spark, f"file://{tmp_path}/t")
    assert value(other.get("a")) == ["v4"] and other.state().last_seq == table.state().last_seq
    assert table.vacuum(older_than_s=-1) > 0 and value(table.get("a")) == ["v4"]
    with pytest.raises(Exception, match="mutation"):
        table.put_rows(("", "x"))
    os.remove(next(iter(table.state().files)).removeprefix("file://").removeprefix("file:"))
    with pytest.raises(RecoveryError):
        table.check()
    table.close()
    with pytest.raises(ClosedError):
        table.state()


SMALL = EngineConfig(target_file_bytes=2000, memtable_bytes=200, max_immutable=1, l0_files=2, l1_max_bytes=3000, compaction_interval_ms=50, cache_shards=1)


def test_files_have_the_target_size(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", T.LongType(), T.LongType(), SMALL)
    table.put(spark.range(5000).select((F.col("id") % 2).alias("key"), F.xxhash64("id").alias("value"), "id"), order="id")
    files = table.files().collect()
    assert len(files) > 10  # two keys only: ranges of key and seq
    assert sorted(r.seq for r in table.log().collect()) == list(range(1, 5001))
    assert {(r.key, r.value, r.seq) for r in table.scan().collect()} == {(r[0], r[1], r[2]) for r in spark.range(4998, 5000).selectExpr("id % 2", "xxhash64(id)", "id + 1").collect()}


def test_a_batch_is_read_once(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", T.LongType(), T.DoubleType(), SMALL)
    table.put(spark.range(3000).select("id", F.rand().alias("r")).select((F.col("r") * 1e9).cast("bigint").alias("key"), F.col("r").alias("value")))
    log = table.log()
    assert log.count() == 3000 and log.filter("key <> CAST(value * 1e9 AS BIGINT)").count() == 0
    assert log.select("seq").distinct().count() == 3000 and log.agg(F.max("seq")).first()[0] == 3000


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tables = [Table(spark, path) for _ in range(2)]
    errors = []

    def work(table, name):
        try:
            for i in range(4):
                table.put_rows((f"{name}{i}", name), ("both", name))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=x) for x in zip(tables, "ab", strict=True)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    seen = Table(spark, path)
    assert seen.state().version == 8 and seen.state().last_seq == 16 and seen.log().select("seq").distinct().count() == 16
    assert [r.key for r in seen.scan().collect()] == [*(f"a{i}" for i in range(4)), *(f"b{i}" for i in range(4)), "both"]
    assert not [f for f in os.listdir(tmp_path / "t" / "_manifest") if f.endswith(".tmp")]


def test_conflicts(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    one, other = Table(spark, path), Table(spark, path)
    one.put_rows(("a", "1"))
    write = one._write_run

    def meanwhile(act):
        def run(*args):
            out = write(*args)
            act()
            return out

        monkeypatch.setattr(one, "_write_run", run)

    meanwhile(lambda: other.put_rows(("b", "2")))
    assert one.compact(full=True) and [r.value for r in one.scan().collect()] == ["1", "2"]  # an append takes nothing away
    meanwhile(lambda: other.compact(full=True))
    with pytest.raises(ConflictError, match="another compaction"):
        one.compact(full=True)
    assert value(one.scan()) == ["1", "2"]
    monkeypatch.setattr(one, "_write_run", write)
    monkeypatch.setattr(one, "_put_if_absent", lambda *_: False)
    with pytest.raises(ConflictError):
        one.put_rows(("c", "3"))
    assert value(other.get("c")) == []


def test_exclusive_opening(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    held = Table(spark, path, exclusive=True)
    with pytest.raises(LockError):
        Table(spark, path, exclusive=True)
    held.close()
    Table(spark, path, exclusive=True).close()


def test_checkpoints_of_the_manifest(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    monkeypatch.setattr(table_module, "CHECKPOINT_EVERY", 2)
    table = Table(spark, path)
    for i in range(5):
        table.put_rows((f"k{i}", "v"))
    os.remove(tmp_path / "t" / "_manifest" / f"{1:020d}.json")  # not needed any more
    again = Table(spark, path)
    assert again.state() == table.state() and again.scan().count() == 5


def test_checksums_on_read(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", T.LongType(), T.LongType())
    table.put(spark.range(20000).select(F.col("id").alias("key"), F.xxhash64("id").alias("value")))
    name = next(iter(table.state().files)).removeprefix("file://").removeprefix("file:")
    data = bytearray(open(name, "rb").read())
    data[len(data) // 2] ^= 255
    open(name, "wb").write(data)
    crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(Exception, match="(?i)crc|checksum"):
        table.log().agg(F.max("value"), F.max("key"), F.max("seq")).collect()


def test_files_in_memory(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    table.put_rows(("a", "1"))
    table.put_rows(("b", "2"))
    assert table.keep_in_memory("b", "c") == 1 and value(table.scan()) == ["1", "2"]
    gauges = table.metrics.snapshot()["gauges"]
    assert (gauges["cache.hits"], gauges["cache.misses"], gauges["cache.hit_ratio"]) == (1, 1, 50) and gauges["cache.bytes"] > 0 and gauges["sstables.l0"] == 2
    table.compact(full=True)
    assert table.cache.bytes == 0 and table.keep_in_memory() == 1 and value(table.scan()) == ["1", "2"]
    small = cache.RunCache(spark, 10, shards=1)
    read = lambda files: spark.createDataFrame([(f,) for f in files], "f string")
    assert small.fill({"x": 6, "y": 6, "z": 60}, read) == 1 and small.evictions == 1 and small.bytes == 6
    assert sorted(r.f for r in small.read(["x", "y"], read).collect()) == ["x", "y"] and (small.hits, small.misses) == (1, 1)
    assert small.evict("y", "x") == 1 and small.bytes == 0


def test_buffered_writer_and_scheduler(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t", config=SMALL)
    with Writer(table) as writer:
        for i in range(30):
            writer.put(f"k{i % 4}", f"v{i}" + "x" * 20)
            if i % 10 == 9:
                writer.delete(f"k{i % 4}")
        with pytest.raises(ValueError):
            writer.put("", "x")
    assert table.state().version > 5 and table.l0_files() <= SMALL.l0_files
    assert {r.key: r.value[:3] for r in table.scan().collect()} == {"k0": "v28", "k2": "v26", "k3": "v27"}
    for i in range(3):
        table.put_rows((f"z{i}", "v"))
    scheduler = CompactionScheduler(table).start()
    for _ in range(200):
        if table.l0_files() < SMALL.l0_files:
            break
        time.sleep(0.1)
    scheduler.stop()
    assert table.l0_files() < SMALL.l0_files and table.scan().count() == 6


def test_streaming(spark, tmp_path):
    table = Table(spark, f"file://{tmp_path}/t")
    rows = spark.createDataFrame([("a", "PUT", "1", 1), ("b", "PUT", "2", 2), ("a", "DELETE", None, 3)], "key string, op string, value string, i bigint")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    stream_into(table, stream, f"{tmp_path}/cp", order="i").awaitTermination()
    assert [r.key for r in table.scan().collect()] == ["b"]
    before = table.state().last_seq
    assert table.apply_batch(rows, "i", app="stream", batch=0) == before
    assert table.files().filter(F.col("level") == 0).count() >= 1
