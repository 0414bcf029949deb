"""Every registered key-value query against its SQL equivalent."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import oracle, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER)
    want = duck.execute(oracle.ORACLE_SQL[name])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), [d[0] for d in want.description])


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value", "seq"]
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(queries.kv_lru_sim(spark, FOLDER).first()[:2]) == 1000
