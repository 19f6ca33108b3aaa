"""The driver's queries and the SQL that gives the same rows."""

from __future__ import annotations

from engram.plans import analytics, history, insights, relational, retrieval, sources, streams, upkeep, views
from engram.plans.registry import Query

FAMILIES = [retrieval.P, insights.P, analytics.P, relational.P, sources.P, upkeep.P, views.P, history.P, streams.P]


def queries() -> dict[str, Query]:
    return {k: f for p in FAMILIES for k, f in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in FAMILIES for k, s in p.sql.items()}
