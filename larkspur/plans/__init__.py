"""Queries over the test tables, one or more for each operator, and the DuckDB SQL they are held against."""

from . import builders, catalogue, scalars, scalars_more, tables_and_udfs

QUERIES, ORACLE_SQL = catalogue.register()
for _module in (builders, scalars, scalars_more, tables_and_udfs):
    if _twice := set(QUERIES) & set(_module.QUERIES):
        raise ValueError(f"two queries named {_twice}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
