"""The registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = ("vectors", "retrieval", "text", "chunks", "context", "catalog", "traces", "streams")


def load() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"corpuskit.workload.{name}")
        queries.update(module.BOOK.queries)
        oracles.update(module.BOOK.oracles)
    return queries, oracles
