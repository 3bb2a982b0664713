"""Every registered query, in one table."""
from __future__ import annotations

from basketry.registry import feeds, models, reports, streams, warehouse
from basketry.registry.query import Query


def all_queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in (reports, feeds, warehouse, models, streams):
        for name, query in module.queries().items():
            assert name not in out, name
            out[name] = query
    return out
