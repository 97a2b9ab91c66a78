"""All registered queries outside the llm subpackage, and their SQL."""

from __future__ import annotations

from attestra.plans import anomalies, comparisons, ledgers, profiles, sources, texts  # noqa: F401
from attestra.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
