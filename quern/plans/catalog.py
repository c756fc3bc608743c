"""All queries of the engine and their SQL twins."""

from __future__ import annotations

from quern.plans import facts, findings, retrieval, review, scripted, standards, structure  # noqa: F401
from quern.plans.common import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
