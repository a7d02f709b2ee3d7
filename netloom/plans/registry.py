"""Registered queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

#: name -> (query, SQL or None)
_FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(fn):
        _FOUND[name or fn.__name__] = (fn, sql)
        return fn

    return add


def _load() -> None:
    from netloom.plans import estimation, games, graphs, report, scalars  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return {k: fn for k, (fn, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: sql for k, (_, sql) in _FOUND.items() if sql}
