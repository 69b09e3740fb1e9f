"""Registered queries and their SQL: name -> callable, name -> DuckDB SQL."""

from __future__ import annotations

from tessera.plans import extras, graphs, legal, ranking, tables, texts

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (texts, tables, ranking, graphs, extras, legal):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
