"""Registered queries against their DuckDB oracle on the smoke tables (sf0.001)."""

import math

import duckdb
import pytest

import __spark_entry__ as se
from tests.conftest import SMOKE

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()



def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=lambda t: [(x is None, str(x)) for x in t])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(se.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = se.queries()[name](spark, SMOKE)
    srecs = [tuple(r) for r in df.collect()]
    rel = con.sql(se.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, srecs) == _rows(rel.columns, rel.fetchall())


def test_every_query_has_a_callable():
    qs, oracle = se.queries(), se.oracle_sql()
    assert set(oracle) <= set(qs)
    assert len(qs) >= 80


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.count() >= 0 and "patient_id" in df.columns
