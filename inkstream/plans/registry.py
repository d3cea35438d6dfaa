"""All registered queries and their SQL, gathered from the plan modules of the core."""

from __future__ import annotations

import importlib

MODULES = ["inkstream.plans.articles", "inkstream.plans.operations", "inkstream.plans.pipeline", "inkstream.plans.p7"]


def gather(modules: list[str]) -> tuple[dict, dict]:
    queries: dict = {}
    sql: dict = {}
    for name in modules:
        module = importlib.import_module(name)
        clash = queries.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"query names registered twice: {sorted(clash)}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
