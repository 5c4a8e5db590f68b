"""All queries of the library outside the optional subpackage, with their SQL."""

from __future__ import annotations

from cartulario.plans import core_problems, fields, graph, incremental, lookup, names, records, relational, reports, scalar, search, views

MODULES = (core_problems, scalar, fields, relational, search, graph, incremental, records, lookup, names, views, reports)

QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
