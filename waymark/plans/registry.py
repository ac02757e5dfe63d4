"""The driver's queries and their oracle statements."""

from __future__ import annotations

from waymark.plans.oracles import ORACLE_SQL
from waymark.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
