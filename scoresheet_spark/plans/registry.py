"""All named queries of the library and their SQL twins."""

from __future__ import annotations

from . import editing_queries, grading_queries, roster_queries, store_queries, vision_queries

MODULES = (roster_queries, grading_queries, vision_queries, editing_queries, store_queries)
FLAGSHIP = grading_queries.grading_responses


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
