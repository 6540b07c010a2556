"""The registered queries of the engine, by name, with SQL that gives the same rows."""

from __future__ import annotations

from . import guarding, ingest, records, relational, reports, search  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
