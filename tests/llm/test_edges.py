"""Every query of the subpackage runs on empty tables and on nulls, repeated rows and clashing columns."""

import os

import pytest

from cartulario.llm import queries
from tests import edge_tables

pytestmark = pytest.mark.skipif(not os.path.isdir(edge_tables.DATA), reason="no tables here")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    return {kind: edge_tables.write(str(tmp_path_factory.mktemp(kind)), kind) for kind in ("empty", "dirty")}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, folders, name):
    rows = queries.QUERIES[name](spark, folders["empty"]).collect()
    assert rows == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_dirty(spark, folders, name):
    queries.QUERIES[name](spark, folders["dirty"]).collect()
