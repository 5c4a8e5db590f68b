"""Every query on empty tables gives what DuckDB gives, and none fails on nulls, repeated rows and clashing columns."""

import os

import duckdb
import pytest

from cartulario.plans import registry
from tests import edge_tables

pytestmark = pytest.mark.skipif(not os.path.isdir(edge_tables.DATA), reason="no tables here")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return {kind: edge_tables.write(str(tmp_path_factory.mktemp(kind)), kind) for kind in ("empty", "dirty")}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty(spark, folders, name):
    rows = registry.QUERIES[name](spark, folders["empty"]).collect()
    if name in registry.SQL:
        con = duckdb.connect()
        for f in os.listdir(folders["empty"]):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{folders['empty']}/{f}'")
        assert len(con.execute(registry.SQL[name]).fetchall()) == len(rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_dirty(spark, folders, name):
    registry.QUERIES[name](spark, folders["dirty"]).collect()
