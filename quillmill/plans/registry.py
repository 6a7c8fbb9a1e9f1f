"""Queries over the driver's tables, each with the SQL that its result must equal."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def picked(number: str, options: list[str]) -> str:
    """SQL for the option that number modulo their count selects."""
    return f"[{', '.join(map(quoted, options))}][({number}) % {len(options)} + 1]"
