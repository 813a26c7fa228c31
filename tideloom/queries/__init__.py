"""Registered queries: each operator run over whole tables, with an independent SQL statement beside it."""

from __future__ import annotations

from . import conformance, delivery, ingest, jobs, tables, temporal, writes
from .registered import Query

_MODULES = (writes, tables, ingest, delivery, temporal, jobs, conformance)


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _MODULES:
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found
