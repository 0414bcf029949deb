"""Version resolution against small literal logs and a dictionary model."""

import random

import pytest

from siltstone.functions.keys import after_prefix
from siltstone.operators import compaction, mvcc
from siltstone.operators.order import next_sequences, with_position

SCHEMA = "key string, seq bigint, op string, value string"


def log_of(spark, *steps):
    """Steps are (key, value) puts or (key,) deletes, numbered from 1."""
    rows = [(s[0], i, "PUT" if len(s) > 1 else "DELETE", s[1] if len(s) > 1 else None) for i, s in enumerate(steps, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return [(r.key, r.value) for r in df.collect()]


def test_put_get_delete_scan(spark):
    log = log_of(spark, ("alpha", "one"), ("beta", "two"), ("gamma", "three"), ("beta",))
    assert pairs(mvcc.scan(log, "alpha", "omega").orderBy("key")) == [("alpha", "one"), ("gamma", "three")]
    assert pairs(mvcc.get(log, "alpha")) == [("alpha", "one")]
    assert pairs(mvcc.get(log, "beta")) == []
    assert pairs(mvcc.get(log, "")) == []


def test_snapshot_reads(spark):
    log = log_of(spark, ("alpha", "1"), ("gamma", "3"), ("beta", "2"), ("delta", "4"), ("gamma",))
    assert pairs(mvcc.scan(log, seq=2).orderBy("key")) == [("alpha", "1"), ("gamma", "3")]
    assert [k for k, _ in pairs(mvcc.scan(log).orderBy("key"))] == ["alpha", "beta", "delta"]


def test_inverted_and_open_ranges(spark):
    log = log_of(spark, ("a", "1"), ("b", "2"), ("c", "3"))
    assert pairs(mvcc.scan(log, "c", "a")) == []
    assert [k for k, _ in pairs(mvcc.scan(log, start="b").orderBy("key"))] == ["b", "c"]
    assert [k for k, _ in pairs(mvcc.scan(log, end="b"))] == ["a"]


def test_prefix(spark):
    log = log_of(spark, ("project:001:name", "x"), ("project:001:owner", "y"), ("project:002:name", "z"))
    assert [k for k, _ in pairs(mvcc.scan_prefix(log, "project:001").orderBy("key"))] == ["project:001:name", "project:001:owner"]
    assert after_prefix(b"a\xff") == b"b" and after_prefix(b"\xff") is None and after_prefix("az") == "a{"


def test_empty_value_is_not_absent(spark):
    assert pairs(mvcc.get(log_of(spark, ("k", "")), "k")) == [("k", "")]


def test_binary_keys_order_unsigned(spark):
    rows = [(bytearray(k), i, "PUT", "v") for i, k in enumerate([b"\xff", b"\x80", b"\x7f", b"a", b"ab", b""], 1)]
    log = spark.createDataFrame(rows, "key binary, seq bigint, op string, value string")
    assert [bytes(r.key) for r in mvcc.scan(log).orderBy("key").collect()] == [b"", b"a", b"ab", b"\x7f", b"\x80", b"\xff"]


def test_positions_match_a_global_sort(spark):
    rows = [(random.Random(i).randint(0, 40), i) for i in range(500)]
    df = spark.createDataFrame(rows, "key bigint, seq bigint")
    found = {(r.key, r.seq): r.pos for r in with_position(df, "key", df.seq.desc()).collect()}
    assert found == {x: i for i, x in enumerate(sorted(rows, key=lambda r: (r[0], -r[1])), 1)}
    assert with_position(df.limit(0), "key").count() == 0
    assert sorted(r.seq for r in next_sequences(df.select("key"), 100, "key").collect()) == list(range(101, 601))


def model(rows, seq):
    state = {}
    for key, s, op, value in sorted(rows, key=lambda r: r[1]):
        if s <= seq:
            state[key] = value if op == "PUT" else None
    return {k: v for k, v in state.items() if v is not None}


@pytest.mark.parametrize("seed", range(3))
def test_compaction_keeps_what_snapshots_see(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{rng.randint(0, 6)}", i, op, f"v{i}" if op == "PUT" else None) for i in range(1, 60) for op in [rng.choice(["PUT", "PUT", "DELETE"])]]
    log, floor = spark.createDataFrame(rows, SCHEMA), rng.randint(1, 59)
    for drop in (False, True):
        kept = [tuple(r) for r in compaction.collect_garbage(log, floor, drop).select("key", "seq", "op", "value").collect()]
        assert len(kept) < len(rows)
        for seq in range(floor, 60):
            assert model(kept, seq) == model(rows, seq)
    last = compaction.collect_all_garbage(log, drop_tombstones=True)
    assert {r.key: r.value for r in last.collect()} == model(rows, 60)
    assert {r.key: r.value for r in mvcc.visible(log, floor).collect()} == model(rows, floor)
