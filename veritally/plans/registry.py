"""Collects the queries of one module with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    queries: dict[str, Callable] = {}
    oracles: dict[str, str] = {}

    def query(name: str, oracle: str | None = None):
        def wrap(fn):
            queries[name] = fn
            if oracle is not None:
                oracles[name] = oracle
            return fn

        return wrap

    return queries, oracles, query
