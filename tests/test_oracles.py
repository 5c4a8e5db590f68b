"""Every query with SQL gives what DuckDB gives on the same tables; the others run."""

import datetime
import decimal
import importlib.util
import math
import os

import duckdb
import pytest

from cartulario.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(value):
    if isinstance(value, float):
        return round(value, 9) if math.isfinite(value) else str(value)
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value) if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    if name in registry.SQL:
        got = duck.execute(registry.SQL[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == columns
        assert sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in got.fetchall()) == rows


def test_entry_lists_every_query():
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(__file__), "..", "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(registry.QUERIES) <= set(module.queries()) and set(module.oracle_sql()) <= set(module.queries())
