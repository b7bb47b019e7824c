"""All registered queries over the reference data model, with their oracle SQL."""

from __future__ import annotations

from tidemark.plans import (  # noqa: F401
    activity_queries,
    audit_queries,
    browse_queries,
    policy_queries,
    evidence_queries,
    search_queries,
    state_queries,
    stream_queries,
    value_queries,
)
from tidemark.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
