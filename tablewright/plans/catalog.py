"""All queries of the library's own operators, by name."""

from __future__ import annotations

from tablewright.plans import analysis_queries, clean_queries, explore_queries, inference_queries, meaning_queries, table_queries
from tablewright.plans.registry import Query

MODULES = [table_queries, clean_queries, explore_queries, analysis_queries, inference_queries, meaning_queries]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"{name} is registered twice")
            found[name] = query
    return found
