"""Queries and SQL of the operators in this subpackage."""

from __future__ import annotations

from inkstream.plans.registry import gather

MODULES = [f"inkstream.llm.p{n}" for n in range(1, 11) if n != 7]
QUERIES, SQL = gather(MODULES)
