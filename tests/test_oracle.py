"""Every registered query against its DuckDB twin (as the driver does), on sf0.001."""

import hashlib
import json
import math

import duckdb
import pytest
from conftest import SF_SMALL

from __spark_entry__ import entry, oracle_sql, queries
from ticketsift.plans import catalog, catalog_more
from ticketsift.sources.tables import TABLES

# the library's own queries; those of the optional subpackage have tests of their own
OWN = {**catalog.QUERIES, **catalog_more.QUERIES}
QUERIES = {k: v for k, v in queries().items() if k in OWN}
SQL = {k: v for k, v in oracle_sql().items() if k in OWN}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    return v


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted(json.dumps([_norm(r[i]) for i in order], default=str) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(SQL[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


def test_entry_smoke(spark):
    out = entry(spark).collect()
    assert len(out) > 0 and sum(r.n for r in out) == 200
