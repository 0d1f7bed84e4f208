"""Every registered query runs; those with an oracle agree with it."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from corpusq import registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        return "nan" if v != v else round(float(v), 8) + 0.0
    return [_value(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(_value(r[i])) for i in order) for r in rows))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, duck):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    result = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(result.columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_oracle(name, spark):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
