"""Every query with SQL gives the rows DuckDB gives; every other query runs."""

import math
import os
from collections import Counter

import pytest

from tidemark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return tuple(map(value, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        return
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(value(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
