"""Every registered query against its DuckDB oracle on the smallest inputs
(the driver repeats this at sf0.01).  Queries without an oracle must run."""

import datetime as dt
import math

import duckdb
import pytest

from conftest import SMALL

import __spark_entry__ as E
from roomledger.plans import catalog

BASES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
         "labels conversations").split()
QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for b in BASES:
        c.execute(f"CREATE VIEW {b} AS SELECT * FROM read_parquet('{SMALL}/{b}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "utilization_rate" in df.columns


def test_every_query_has_an_oracle_or_is_listed():
    assert sorted(set(QUERIES) - set(ORACLES)) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = df.columns
    assert len({c.lower() for c in cols}) == len(cols)  # else the result can't be written
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    ocols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    i1 = sorted(range(len(cols)), key=lambda i: cols[i])
    i2 = sorted(range(len(ocols)), key=lambda i: ocols[i])
    a = sorted(tuple(_norm(r[i]) for i in i1) for r in got)
    b = sorted(tuple(_norm(r[i]) for i in i2) for r in want)
    assert a == b
