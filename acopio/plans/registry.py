"""Queries over the driver's tables and the SQL that each must agree with."""

from __future__ import annotations

from acopio.plans import contracts, details, runs, suppliers, tenders, texts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (contracts, suppliers, tenders, runs, texts, details):
    QUERIES |= module.Q.queries
    ORACLE_SQL |= module.Q.sql
