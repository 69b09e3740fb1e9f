"""How the query modules register what they define."""

from __future__ import annotations

from collections.abc import Callable

STOP = "'và','là','của','cho','với','the','is','are','of','to','a','an'"


def sql_tokens(c: str, least: int = 2, stop: bool = True) -> str:
    """DuckDB's form of tessera.functions.text.tokens."""
    out = f"[t for t in regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+') if length(t) >= {least}"
    return out + (f" and t not in ({STOP})]" if stop else "]")


def registrar(queries: dict, oracle: dict) -> Callable:
    def register(sql: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql is not None:
                oracle[f.__name__] = sql
            return f

        return add

    return register
