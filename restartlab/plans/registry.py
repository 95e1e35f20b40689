"""All registered queries, in the order of the operator inventory."""

from __future__ import annotations

from functools import cache
from importlib import import_module

from restartlab.plans.query import Query

FAMILIES = ("storage", "scoring", "graphs", "pools", "quality", "planning", "angles", "compare", "learning", "streaming")


@cache
def registered() -> tuple[Query, ...]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        for query in import_module(f"restartlab.plans.{family}").QUERIES:
            if query.key in found:
                raise ValueError(f"query registered twice: {query.key}")
            found[query.key] = query
    return tuple(found.values())
