"""Queries over the given tables: each operator on real rows, dirtied where a fault is needed."""

from __future__ import annotations

import importlib

from obsload.samples.registry import QUERIES, SQL, Query

_MODULES = ["values", "keys", "mappings", "spatial", "tables", "files"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"obsload.samples.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
